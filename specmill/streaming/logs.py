"""Request logs and run histories: rules over arrival order and time, on tables by ranges and slots, on streams by state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..functions.text import c
from ..operators.reports import run_stats


def ranges(key: Column, bounds: list) -> Column:
    """Number of the range of ``key`` among rising ``bounds``, by a binary search; a null is in the first one."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key > F.lit(bounds[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(bounds))


def mark_late(df: DataFrame, watermark: str, order: str, ts: str = "ts", parts: int | None = None) -> DataFrame:
    """``df`` with the columns ``watermark`` and ``late``: which rows of a table a stream with such a watermark would drop.

    Rows arrive by the number ``order``, those of one number by time. A row's watermark is the latest time of the rows that arrived before
    it, less the interval ``watermark``; a row is late if its time is before that. So the rule is applied row by row, a stream
    applies it batch by batch and drops no more. The first row has no watermark; a row without time is never late and moves nothing; rows
    without ``order`` arrive first.

    The latest time so far is a prefix maximum: rows are dealt to ranges of ``order``, the maxima of the ranges before (one row
    per range) are put before a scan of each range. No task sees more than a range.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)] or [0.5], F.lit(10_000))).first()[0] or []
    rows = df.withColumn("_range", ranges(c(order), sorted(set(cuts))))
    tops = rows.groupBy("_range").agg(F.max(ts).alias("_top"))
    before = tops.select("_range", F.max("_top").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row per range
    here = Window.partitionBy("_range").orderBy(c(order).asc_nulls_first(), c(ts).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.max(ts).over(here), "_before")
    marked = rows.join(F.broadcast(before), "_range").withColumn("watermark", reached - F.expr(f"INTERVAL {watermark}"))
    return marked.withColumn("late", F.coalesce(c(ts) < c("watermark"), F.lit(False))).select(*df.columns, "watermark", "late")


def sliding_log(df: DataFrame, key: str, seconds: int = 60, limit: int = 15, ts: str = "ts", windows_per_slot: int = 10) -> DataFrame:
    """``df`` with ``n``, the requests of the key in the ``seconds`` up to each one, itself and those of the same moment included, and ``over``,
    whether they are more than ``limit``: the log that a limiter keeps, for every request.

    A request exactly ``seconds`` old does not count. A request without time has no ``n`` and is not over; requests without key are of
    one key. Repeated rows count each.

    A range frame per key would put a busy key into one task. So time is cut into slots of ``windows_per_slot`` windows, each (key, slot)
    is a partition of its own, and the requests of a slot's last window are also seen by the next one.
    """
    window, own = seconds * 1_000_000, df.columns
    rows = df.withColumn("_at", F.unix_micros(c(ts).cast("timestamp"))).withColumn("_key", c(key))
    length = window * windows_per_slot
    timed = rows.filter("_at IS NOT NULL").withColumn("_slot", F.floor(c("_at") / length).cast("long"))
    halo = timed.filter(c("_at") + window > (c("_slot") + 1) * length).select("_key", "_at", (c("_slot") + 1).alias("_slot"), F.lit(True).alias("_halo"))
    w = Window.partitionBy("_key", "_slot").orderBy("_at").rangeBetween(1 - window, 0)
    both = timed.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    counted = both.withColumn("n", F.count("*").over(w)).filter(~c("_halo")).select(*own, "n")
    untimed = df.filter(c(ts).isNull()).withColumn("n", F.lit(None).cast("long"))
    return counted.unionByName(untimed).withColumn("over", F.coalesce(c("n") > limit, F.lit(False)))


class DroppedRows(StreamingQueryListener):
    """Rows that watermarks have dropped, per run of a query: ``counts[run id]``. Added by ``spark.streams.addListener``."""

    def __init__(self):
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.counts[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.counts[run] = self.counts.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        pass


# -- run history ------------------------------------------------------------------------------------------------------

RUN = T.StructType([T.StructField("id", T.LongType()), T.StructField("start", T.TimestampType()), T.StructField("duration", T.DoubleType()), T.StructField("success", T.BooleanType())])
TOTALS = T.StructType([T.StructField("total", T.LongType()), T.StructField("successful", T.LongType()), T.StructField("failed", T.LongType())])
HISTORY = T.StructType([T.StructField("shard", T.IntegerType()), *TOTALS.fields, T.StructField("kept", T.LongType())])


class RunHistory(StatefulProcessor):
    """The last ``keep`` runs and the counters of one shard of the runs."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs, self.totals = handle.getListState("runs", RUN), handle.getValueState("totals", TOTALS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, good, bad = self.totals.get() if self.totals.exists() else (0, 0, 0)
        kept = list(self.runs.get()) if self.runs.exists() else []
        for part in rows:  # some at a time: never more than ``keep`` runs and a part are held
            success = part["success"].tolist()
            total, good, bad = total + len(part), good + sum(x is True for x in success), bad + sum(x is False for x in success)
            kept += list(zip(*(part[n].tolist() for n in RUN.names)))
            kept = sorted(kept, key=lambda r: (r[1] is not None and not pd.isna(r[1]), r[1], r[0]), reverse=True)[:self.keep]
        self.runs.put(kept)
        self.totals.update((total, good, bad))
        yield pd.DataFrame([(key[0], total, good, bad, len(kept))], columns=HISTORY.names)

    def close(self) -> None:
        pass


def run_history(runs: DataFrame, keep: int = 100, shards: int = 16) -> DataFrame:
    """Run counters and the last ``keep`` runs as the state of a stream of (id, start, duration, success): one row per shard that a batch
    touches (update mode), with its totals.

    Each shard keeps its own last runs, so that a batch of many runs is not one task; any of the last runs of all is among those of its
    shard. The history itself is read from the checkpoint, by ``read_run_history``. Needs the RocksDB state store provider
    (``spark.sql.streaming.stateStore.providerClass``). Runs without id or start are counted but come last; an unknown success counts
    in the total only.
    """
    known = runs.filter(c("start").isNotNull() | c("start").isNull()).select(
        F.pmod(F.xxhash64("id", "start"), F.lit(shards)).cast("int").alias("shard"), c("id").cast("long").alias("id"), c("start").cast("timestamp").alias("start"), c("duration").cast("double").alias("duration"), "success")
    return known.groupBy("shard").transformWithStateInPandas(RunHistory(keep), HISTORY, "Update", "None")


def read_run_history(spark: SparkSession, checkpoint: str, keep: int = 100) -> DataFrame:
    """(metric, value) as ``run_stats`` gives them, from the state that ``run_history`` has at the last batch of its checkpoint.

    At most ``keep`` runs per shard are read, however many the stream has seen.
    """
    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    runs = state("runs").select("list_element.*")
    last = run_stats(runs, keep).filter(c("metric").isin("kept", "keptSuccessful", "keptDuration", "lastRun"))
    totals = state("totals").select("value.*").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in TOTALS.names])
    return totals.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), c(n).cast("double").alias("value")) for n in TOTALS.names]))).unionByName(last)
