"""Arrival order, request logs and run histories against loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from specmill.operators import reports
from specmill.streaming import logs, streams

BEGIN = datetime(2024, 1, 1)


def requests(spark, n: int, users: int, seed: int, step: int = 7):
    rnd, at, rows = random.Random(seed), BEGIN, []
    for i in range(n):
        at += timedelta(seconds=rnd.choice([0, 0, 1, rnd.randrange(step * 2), rnd.random() * step]))
        rows.append((i, f"u{rnd.randrange(users)}", at))
    return rows, spark.createDataFrame(rows, "id long, user string, ts timestamp").repartition(5)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_late_rows(spark, parts):
    rnd = random.Random(parts)
    rows = [(i if i % 50 else i - 1, BEGIN + timedelta(minutes=i - rnd.choice([0, 0, 0, rnd.randrange(200)])) if i % 17 else None, "x") for i in range(400)] + [(None, BEGIN + timedelta(minutes=90), "first")]
    df = spark.createDataFrame(rows, "id long, ts timestamp, late_ string").repartition(4)
    got = sorted((r["id"] is not None, r["id"] or 0, r["ts"] is not None, r["ts"] or BEGIN, r["watermark"], r["late"]) for r in logs.mark_late(df, "1 hour", "id", parts=parts).collect())
    top, want = None, []
    for i, ts, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or BEGIN)):
        mark = top and top - timedelta(hours=1)
        want.append((i is not None, i or 0, ts is not None, ts or BEGIN, mark, bool(ts and mark and ts < mark)))
        top = max(filter(None, (top, ts)), default=None)
    assert [x[:4] + (x[4] and x[4].replace(tzinfo=None), x[5]) for x in got] == want and any(x[5] for x in want)
    assert logs.mark_late(df.limit(0), "1 hour", "id").collect() == []


@pytest.mark.parametrize("users,slot", [(1, 1), (1, 10), (6, 3)])
def test_sliding_log(spark, users, slot):
    rows, df = requests(spark, 900, users, users, step=7 if users == 1 else 1)
    want = {i: sum(u == v and ts - timedelta(seconds=60) < t <= ts for _, v, t in rows) for i, u, ts in rows}
    marked = logs.sliding_log(df, "user", 60, 15, windows_per_slot=slot)
    got = {r["id"]: (r["n"], r["over"]) for r in marked.collect()}
    assert got == {i: (n, n > 15) for i, n in want.items()} and any(n > 15 for n in want.values())
    odd = spark.createDataFrame([(1, None, BEGIN), (2, None, BEGIN), (3, "u", None)], "id long, user string, ts timestamp")
    assert sorted((r["id"], r["n"], r["over"]) for r in logs.sliding_log(odd, "user", 60, 1).collect()) == [(1, 2, True), (2, 2, True), (3, None, False)]


def test_a_busy_user_is_many_tasks(spark):
    _, df = requests(spark, 2_000, 1, 4, step=40)
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = [r["count"] for r in logs.sliding_log(df, "user").select("n", F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("count"), F.max("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert len(sizes) > 8 and max(sizes) < 600


def test_dropped_rows_are_kept_count_of(spark, tmp_path):
    mk = lambda rows: spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("ts"))
    src, listener = str(tmp_path / "late"), logs.DroppedRows()
    spark.streams.addListener(listener)
    try:
        runs = []
        for rows in ([("a", "2024-01-10 00:00:00"), ("b", "2024-01-10 01:00:00")], [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00")]):
            mk(rows).coalesce(1).write.mode("append").parquet(src)
            s = spark.readStream.schema("k string, ts timestamp").parquet(src)
            q = streams.rate_windows(s, "k", "1 hour", None, 0, watermark="1 hour").writeStream.format("parquet").outputMode("append") \
                .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            runs.append(str(q.runId))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        assert [listener.counts.get(r) for r in runs] == [0, 2]
    finally:
        spark.streams.removeListener(listener)


def test_run_history_follows_the_batches(spark, tmp_path):
    """The state is what the table form gives for the same rows, after every batch and after restarts."""
    rnd, src, ck = random.Random(9), str(tmp_path / "runs"), str(tmp_path / "ck")
    schema = "id long, start timestamp, duration double, success boolean"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        number = 0
        for size in (30, 1, 200, 90):  # more than the history keeps, runs out of order and at the same time
            rows = [(number + i, BEGIN + timedelta(minutes=rnd.randrange(3_000)), rnd.random(), rnd.random() < 0.7) for i in range(size)]
            number += size
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(schema).parquet(src)
            q = logs.run_history(stream, 100, shards=3).writeStream.format("noop").outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True).start()
            q.awaitTermination(240)
            key = lambda df: {r["metric"]: r["value"] for r in df.collect()}
            assert key(logs.read_run_history(spark, ck)) == pytest.approx(key(reports.run_stats(spark.read.parquet(src), 100)))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
