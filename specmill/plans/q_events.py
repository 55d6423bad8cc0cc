"""Run logs, latencies, extraction outcomes and the time-based rules over the event table."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.text import c, content_hash
from ..operators import reports
from ..session import shared_dir
from ..streaming import buckets, logs, streams
from . import inputs
from .q_linkage import _FILES, docs, files_for_ranking, ranked
from .registry import query


def events(spark, sf):
    return inputs.table(spark, sf, "events")


def ok():
    return c("event_type") != "error"


@query("a30_run_stats", """SELECT 'total' AS metric, CAST(count(*) AS DOUBLE) AS value FROM events UNION ALL SELECT 'successful', count(*) FROM events WHERE event_type <> 'error' UNION ALL SELECT 'failed', count(*) FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'kept', count(*) FROM l UNION ALL SELECT 'keptSuccessful', count(*) FROM l WHERE event_type <> 'error' UNION ALL SELECT 'keptDuration', round(sum(value), 4) FROM l UNION ALL SELECT 'lastRun', CAST(arg_max(event_id, (ts, event_id)) AS DOUBLE) FROM l""".replace(
    "SELECT 'total' AS metric", "WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT 'total' AS metric", 1))
def a30(spark, sf):
    e = events(spark, sf).select("event_id", "ts", "value", ok().alias("success"))
    return reports.run_stats(e, 100, id="event_id", start="ts", duration="value")


@query("a31_latency_summary", """WITH s AS (SELECT event_type, count(*) AS requests, count(*) FILTER (user_id % 7 <> 0) AS n, min(value) FILTER (user_id % 7 <> 0) AS min, max(value) FILTER (user_id % 7 <> 0) AS max, round(avg(value) FILTER (user_id % 7 <> 0), 6) AS avg,
    list(value ORDER BY value) FILTER (user_id % 7 <> 0) AS v FROM events GROUP BY event_type)
  SELECT event_type, requests, n, min, max, avg, v[CAST(floor(n * 0.5) AS INT) + 1] AS median, v[CAST(floor(n * 0.95) AS INT) + 1] AS p95, coalesce(v[CAST(floor(n * 0.99) AS INT) + 1], max) AS p99,
    round(n * 100.0 / requests, 4) AS success_rate, v[CAST(floor(n * 0.95) AS INT) + 1] <= 50 AS passed FROM s""")
def a31(spark, sf):
    return reports.latency_summary(events(spark, sf), ["event_type"], "value", c("user_id") % 7 != 0, 50.0)


@query("a32_extraction_report", docs("""SELECT k.status, count(s.status) AS n FROM (VALUES ('success'), ('failed'), ('skipped'), ('no_match')) k(status) LEFT JOIN st s ON s.status = k.status GROUP BY k.status UNION ALL SELECT 'total', count(*) FROM st""",
    _FILES + """, st AS (SELECT f.filename, CASE WHEN f.fpos % 50 = 0 THEN 'skipped' WHEN e.error IS NOT NULL THEN 'failed' WHEN f.filename NOT IN (SELECT filename FROM ranked) THEN 'no_match' ELSE 'success' END AS status
      FROM files f JOIN (SELECT filename, arg_min_null(error, _pos) AS error FROM docs GROUP BY filename) e USING (filename))"""))
def a32(spark, sf):
    files = files_for_ranking(spark, sf)
    log = reports.extraction_status(files, ranked(spark, sf), files.filter("_pos % 50 = 0"))
    return reports.extraction_report(log)


@query("t01_upsert_state", """SELECT id, arg_max(last_type, batch) AS last_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'u-' || CAST(user_id AS VARCHAR) AS id, event_id // 1000 AS batch, arg_max(event_type, event_id) AS last_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY id""")
def t01(spark, sf):
    e = events(spark, sf).select(F.concat(F.lit("u-"), c("user_id").cast("string")).alias("id"), c("event_id").alias("_pos"), "event_type")
    n = e.groupBy("id").agg(F.count("*").alias("n"))
    table = streams.UpsertTable(f"{shared_dir(spark)}/upsert-{uuid4().hex}")
    top = e.agg(F.max("_pos")).first()[0] or 0
    for batch in range(3):  # thirds of the events in arrival order, the first two folded into a base
        table.append(e.filter(F.floor(c("_pos") * 3 / (top + 1)) == batch), batch)
        if batch == 1:
            table.compact(spark)
    return table.current(spark).join(n, "id").select("id", c("event_type").alias("last_type"), "n")


@query("t02_dedupe_ttl", """WITH RECURSIVE e AS (SELECT event_id, ts, sha256(event_type || CAST(user_id % 10 AS VARCHAR)) AS k FROM events),
  first AS (SELECT k, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM e GROUP BY k),
  kept AS (SELECT k, event_id, ts FROM first UNION ALL
    SELECT k, event_id, ts FROM (SELECT e.k, e.event_id, e.ts, row_number() OVER (PARTITION BY e.k ORDER BY e.ts, e.event_id) AS r FROM kept JOIN e ON e.k = kept.k AND e.ts >= kept.ts + INTERVAL 7 DAY) WHERE r = 1)
  SELECT event_id FROM kept""")
def t02(spark, sf):
    e = events(spark, sf).withColumn("hash", content_hash(F.concat("event_type", (c("user_id") % 10).cast("string"))))
    return streams.stream_dedupe(e.select("event_id", "ts", "hash"), "hash", "7 days", pos="event_id").select("event_id")


@query("t03_rate_sliding", """SELECT event_type, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM (SELECT event_type, ts, time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL (10 * k) MINUTE AS w FROM events, range(0, 6) r(k))
  GROUP BY event_type, w HAVING count(*) > 5""")
def t03(spark, sf):
    r = streams.rate_windows(events(spark, sf), "event_type", "60 minutes", "10 minutes", 5)
    return r.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query("t03_rate_daily", """SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY user_id, date_trunc('day', ts) HAVING count(*) > 3""")
def t03_day(spark, sf):
    r = streams.rate_windows(events(spark, sf), "user_id", "1 day", None, 3)
    return r.select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


@query("t04_rolling_gates", """SELECT strftime(d, '%Y-%m-%d') AS day, g AS gate, CAST(CASE g WHEN 'minRecords' THEN 10 WHEN 'error' THEN 25 ELSE 40 END AS DOUBLE) AS threshold,
  round(CASE g WHEN 'minRecords' THEN n WHEN 'error' THEN e * 100.0 / n ELSE l * 100.0 / n END, 6) AS actual, CASE g WHEN 'minRecords' THEN n >= 10 WHEN 'error' THEN e * 100.0 / n <= 25 ELSE l * 100.0 / n <= 40 END AS passed
  FROM (SELECT date_trunc('day', ts) AS d, count(*) AS n, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (value < 10) AS l FROM events GROUP BY 1), (VALUES ('minRecords'), ('error'), ('low')) v(g)""")
def t04(spark, sf):
    g = streams.rolling_gates(events(spark, sf), {"error": c("event_type") == "error", "low": c("value") < 10}, {"error": 25, "low": 40})
    return g.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "gate", "threshold", "actual", "passed")


@query("t05_idle_sessions", """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS stale_at, count(*) AS n FROM (
  SELECT user_id, ts, sum(CASE WHEN ts < p + INTERVAL 1 DAY THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s""")
def t05(spark, sf):
    s = streams.idle_sessions(events(spark, sf), "user_id", 86400)
    return s.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), F.date_format("stale_at", "yyyy-MM-dd HH:mm:ss").alias("stale_at"), "n")


@query("t06_run_counters", "SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed FROM events")
def t06(spark, sf):
    return streams.run_counters(events(spark, sf), ok())


@query("t03_sliding_log", """SELECT a.event_id, count(*) AS n, count(*) > 5 AS "over" FROM events a JOIN events b ON b.event_type = a.event_type AND b.ts > a.ts - INTERVAL 1 HOUR AND b.ts <= a.ts GROUP BY a.event_id""")
def t03_log(spark, sf):
    return logs.sliding_log(events(spark, sf).select("event_id", "event_type", "ts"), "event_type", 3600, 5).select("event_id", "n", "over")


@query("t07_late_marks", """SELECT event_id, strftime(m - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS watermark, coalesce(ts < m - INTERVAL 1 HOUR, false) AS late FROM (
  SELECT event_id, ts, max(ts) OVER (ORDER BY event_id + CASE WHEN event_id % 7 = 0 THEN 400 ELSE 0 END, ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events)""")
def t07_marks(spark, sf):
    """Events of which each seventh arrives 400 places late."""
    e = events(spark, sf).select("event_id", "ts", (c("event_id") + F.when(c("event_id") % 7 == 0, 400).otherwise(0)).alias("arrived"))
    marked = logs.mark_late(e, "1 hour", "arrived")
    return marked.select("event_id", F.date_format("watermark", "yyyy-MM-dd HH:mm:ss").alias("watermark"), "late")


@query("t06_run_history", """WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT 'total' AS metric, CAST(count(*) AS DOUBLE) AS value FROM events
  UNION ALL SELECT 'successful', count(*) FROM events WHERE event_type <> 'error' UNION ALL SELECT 'failed', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'kept', count(*) FROM l
  UNION ALL SELECT 'keptSuccessful', count(*) FROM l WHERE event_type <> 'error' UNION ALL SELECT 'keptDuration', round(sum(value), 4) FROM l UNION ALL SELECT 'lastRun', CAST(arg_max(event_id, (ts, event_id)) AS DOUBLE) FROM l""")
def t06_history(spark, sf):
    """All events as a stream of runs in four files; the history is what its state holds at the end."""
    root, name = f"{shared_dir(spark)}/history-{uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    runs = events(spark, sf).select(c("event_id").alias("id"), c("ts").cast("timestamp").alias("start"), c("value").alias("duration"), ok().alias("success"))
    runs.repartitionByRange(4, "start").write.parquet(f"{root}/runs")
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/runs")
        logs.run_history(stream, 100).writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return logs.read_run_history(spark, f"{root}/state")


@query("t01_bucket_state", """SELECT id, arg_max(last_type, batch) AS last_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'u-' || CAST(user_id AS VARCHAR) AS id, event_id // 1000 AS batch, arg_max(event_type, event_id) AS last_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY id""")
def t01_buckets(spark, sf):
    e = events(spark, sf).select(F.concat(F.lit("u-"), c("user_id").cast("string")).alias("id"), c("event_id").alias("_pos"), "event_type")
    table = buckets.BucketTable(f"{shared_dir(spark)}/buckets-{uuid4().hex}", buckets=8)
    top = e.agg(F.max("_pos")).first()[0] or 0
    for batch in range(3):  # thirds of the events in arrival order
        table.append(e.filter(F.floor(c("_pos") * 3 / (top + 1)) == batch), batch)
    n = e.groupBy("id").agg(F.count("*").alias("n"))
    return table.current(spark).join(n, "id").select("id", c("event_type").alias("last_type"), "n")
