"""The catalogue's time-dependent rules as Structured Streaming operators; each works on a static table too."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import c
from ..operators.merge import upsert
from ..session import cut


#: Slots that a time to live is cut into.
SLOTS = 64


def late(df: DataFrame, watermark: str | None, ts: str = "ts") -> DataFrame:
    """Rows later than the watermark are dropped by the stateful operator that follows (and counted in its progress
    metric ``numRowsDroppedByWatermark``). A watermark has no meaning on a static table."""
    return df.withWatermark(ts, watermark) if watermark and df.isStreaming else df


def stream_dedupe(df: DataFrame, key: str = "hash", ttl: str = "7 days", ts: str = "ts", pos: str | None = None) -> DataFrame:
    """First row per key, and again the first one at least ``ttl`` after the last row that was kept.

    On a stream the state is the time of the last kept row, one per live key; rows count in the order of their batches, and
    inside a batch by time. A key whose time is over is forgotten by event time. On a table each row points at the first row of its key
    that is at least ``ttl`` later, found per key and slot of time, so that one busy key is many partitions; the rows reached from a
    key's first one are found by doubling the pointers: the rounds grow with the logarithm of time span / ttl. ``pos`` breaks ties. Rows without key are dropped.
    """
    rows = df.filter(c(key).isNotNull())
    if df.isStreaming:
        return _stream_dedupe(rows, key, ttl, ts)
    marks = [ts, pos] if pos else [ts]
    order = F.struct(*marks)
    events = rows.groupBy(key, ts).agg(F.min(order).alias("_at"))  # rows of one time are decided by their first
    due = events.select(key, (c(ts) + F.expr(f"INTERVAL {ttl}")).alias("_t"), c("_at").alias("_from"), F.lit(None).cast(events.schema["_at"].dataType).alias("_to"), F.lit(0).alias("_row"))
    there = events.select(key, c(ts).alias("_t"), F.lit(None).cast(events.schema["_at"].dataType).alias("_from"), c("_at").alias("_to"), F.lit(1).alias("_row"))
    # The next event of each is looked for in its slot, and else at the head of the key's next slot; a key has as many slots as the time span has.
    slot = F.floor(F.unix_micros(c("_t").cast("timestamp")) / F.lit(max(1, int(_seconds(df.sparkSession, ttl) * 1_000_000 / SLOTS)))).cast("long")
    near = due.unionByName(there).withColumn("_slot", slot)
    here = Window.partitionBy(key, "_slot").orderBy(c("_t").desc(), c("_row").desc()).rowsBetween(Window.unboundedPreceding, 0)
    heads = near.groupBy(key, "_slot").agg(F.min("_to").alias("_head"))
    later = heads.select(key, "_slot", F.last("_head", ignorenulls=True).over(Window.partitionBy(key).orderBy(c("_slot").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_next"))
    found = near.withColumn("_to", F.last("_to", ignorenulls=True).over(here)).filter("_row = 0").join(later, [key, "_slot"])
    jump = cut(found.withColumn("_to", F.coalesce("_to", "_next")).filter("_to IS NOT NULL").select(key, "_from", "_to"))
    kept = cut(rows.groupBy(key).agg(F.min(order).alias("_at")))
    while not jump.isEmpty():
        step = kept.join(jump.withColumnRenamed("_from", "_at"), [key, "_at"]).select(key, c("_to").alias("_at"))
        kept = cut(kept.unionByName(step).distinct())
        jump = cut(jump.join(jump.select(key, c("_from").alias("_to"), c("_to").alias("_far")), [key, "_to"]).select(key, "_from", c("_far").alias("_to")))
    return rows.withColumn("_at", order).join(kept, [key, "_at"], "left_semi").drop("_at")


def _seconds(spark: SparkSession, interval: str) -> float:
    return spark.sql(f"SELECT CAST(INTERVAL {interval} AS INTERVAL DAY TO SECOND) AS i").first()[0].total_seconds()


def _stream_dedupe(rows: DataFrame, key: str, ttl: str, ts: str) -> DataFrame:
    names, late = rows.columns, rows.sparkSession.range(1).select(F.expr(f"INTERVAL {ttl}").cast("interval day to second").alias("i")).first()[0]

    def kept(_, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.get[0] if state.exists else None, []
        arrived = pd.concat(list(batches)).sort_values(ts, kind="stable")
        for i, t in enumerate(arrived[ts]):
            if last is None or t >= last + late:
                out.append(i)
                last = t
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + late).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield arrived.iloc[out][names]

    return rows.withWatermark(ts, ttl).groupBy(key).applyInPandasWithState(kept, rows.schema, f"{ts} timestamp", "append", "EventTimeTimeout")


def rate_windows(df: DataFrame, key: str, size: str = "1 minute", slide: str | None = "10 seconds", limit: int = 15,
                 ts: str = "ts", watermark: str | None = None, over_only: bool = True) -> DataFrame:
    """Requests per key and (sliding) window; by default only the windows over the limit."""
    d = late(df, watermark, ts)
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    n = d.groupBy(win.alias("w"), key).agg(F.count("*").alias("n"))
    out = n.select(key, c("w.start").alias("window_start"), c("w.end").alias("window_end"), "n", (c("n") > limit).alias("over"))
    return out.filter("over") if over_only else out


def rolling_gates(df: DataFrame, missing: dict[str, Column], limits: dict[str, float], min_rows: int = 10, size: str = "1 day",
                  ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """Quality gates per tumbling window over arriving rows: share of missing values per field against its limit."""
    n = late(df, watermark, ts).groupBy(F.window(ts, size).alias("w")).agg(
        F.count("*").alias("n"), *[F.count_if(m).alias(f) for f, m in missing.items()])
    rows = [F.struct(F.lit("minRecords").alias("gate"), F.lit(float(min_rows)).alias("threshold"),
                     c("n").cast("double").alias("actual"), (c("n") >= min_rows).alias("passed"))]
    for f in missing:
        share = F.col(f) * 100.0 / F.col("n")
        rows.append(F.struct(F.lit(f).alias("gate"), F.lit(float(limits[f])).alias("threshold"),
                             F.round(share, 6).alias("actual"), (share <= limits[f]).alias("passed")))
    return n.select(c("w.start").alias("window_start"), F.inline(F.array(*rows)))


def idle_sessions(df: DataFrame, key: str, idle_seconds: int = 3600, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """Activity sessions per key: a closed session is a key that has been idle for longer than the gap.

    On a static table rows are first reduced to (key, slot) with slots as long as the gap. Rows of one slot are always of
    one session, so a very active key shrinks to at most time span / gap rows before sessions are formed.
    """
    if df.isStreaming:
        s = late(df, watermark, ts).groupBy(F.session_window(ts, f"{idle_seconds} seconds").alias("s"), key).agg(F.count("*").alias("n"))
        return s.select(key, c("s.start").alias("session_start"), c("s.end").alias("stale_at"), "n")
    gap = F.make_dt_interval(secs=F.lit(idle_seconds))
    slot = F.window(ts, f"{idle_seconds} seconds")
    slots = df.groupBy(key, slot.alias("_w")).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy("_lo")
    fresh = slots.withColumn("_new", F.coalesce(c("_lo") >= F.lag("_hi").over(w) + gap, F.lit(True)).cast("int"))
    s = fresh.withColumn("_s", F.sum("_new").over(w)).groupBy(key, "_s").agg(
        F.min("_lo").alias("session_start"), F.max("_hi").alias("_last"), F.sum("_n").alias("n"))
    return s.select(key, "session_start", (c("_last") + gap).alias("stale_at"), "n")


def run_counters(df: DataFrame, ok: Column) -> DataFrame:
    """Running totals of runs (complete mode on a stream)."""
    return df.groupBy().agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"))


# -- upsert table -------------------------------------------------------------------------------------------------

class UpsertTable:
    """Catalogue state as base versions plus one immutable change set per micro-batch.

    A change set is named by the query that wrote it and its batch, so a retry rewrites its own set and a query started anew adds to
    the others; ``_at``, the time of writing, orders the sets. ``current`` is one aggregate over the last base and the sets it
    does not hold yet; ``compact`` writes the next base together with the names of the sets in it. Columns that appear later are
    part of the state.
    """

    def __init__(self, root: str, key: str = "id", pos: str = "_pos"):
        self.root, self.key, self.pos = root.rstrip("/"), key, pos

    def append(self, batch: DataFrame, batch_id: int, query: str = "batch") -> None:
        at = int(time.time() * 1_000_000)
        batch.withColumn("_at", F.lit(at).cast("long")).write.mode("overwrite").parquet(f"{self.root}/changes/query={query}/batch={batch_id}")

    def _read(self, spark: SparkSession, part: str) -> DataFrame | None:
        try:
            return spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{part}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def version(self, spark: SparkSession) -> int | None:
        base = self._read(spark, "base")
        return None if base is None else base.agg(F.max("version")).first()[0]

    def changes(self, spark: SparkSession) -> DataFrame | None:
        """Change sets that are not in the last base."""
        rows, version = self._read(spark, "changes"), self.version(spark)
        if rows is None:
            return None
        rows = rows.withColumn("query", c("query").cast("string"))
        if version is None:
            return rows
        held = self._read(spark, "held").filter(c("version") <= version).select(c("query").cast("string").alias("query"), "batch").distinct()
        return rows.join(held, ["query", "batch"], "left_anti")

    def current(self, spark: SparkSession) -> DataFrame:
        """Latest state: later sets override earlier ones field by field, later rows win inside a set."""
        rows, version = self.changes(spark), self.version(spark)
        if rows is None:
            raise ValueError(f"no change set in {self.root}")
        fields = [x for x in rows.columns if x not in (self.key, self.pos, "query", "batch", "_at")]
        order = rows.withColumn(self.pos, F.struct("_at", self.pos))
        last = order.groupBy(self.key).agg(F.min(self.pos).alias("_first"), *[
            F.max_by(f, F.when(c(f).isNotNull(), c(self.pos))).alias(f) for f in fields])
        last = last.withColumn(self.pos, c(f"_first.{self.pos}")).drop("_first")
        if version is None:
            return last
        return upsert(self._read(spark, "base").filter(c("version") == version).drop("version"), last, key=self.key, pos=self.pos)

    def compact(self, spark: SparkSession) -> int:
        """The next base version. The names of its sets are written first and count only once the base is there."""
        version = (self.version(spark) or 0) + 1
        self.changes(spark).select("query", "batch").distinct().write.mode("overwrite").parquet(f"{self.root}/held/version={version}")
        self.current(spark).write.mode("overwrite").parquet(f"{self.root}/base/version={version}")
        return version


def stream_upsert(stream: DataFrame, table: UpsertTable, checkpoint: str, **trigger):
    """Start the continuous upsert of a stream into a table; the query's id, which its checkpoint keeps, names the change sets."""
    def write(df: DataFrame, batch: int) -> None:
        table.append(df, batch, df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
