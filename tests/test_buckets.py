"""The bucketed table against a plain fold of its batches."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from specmill.streaming.buckets import BucketTable, Outdated
from specmill.streaming.streams import stream_upsert

SCHEMA = "id string, _pos long, model string, weight double"


def fold(batches):
    """Later batches override field by field, later rows win inside a batch."""
    state: dict = {}
    for rows in batches:
        for id, _, *values in sorted(rows, key=lambda r: r[1]):
            if id is not None:
                old = state.get(id, (None,) * len(values))
                state[id] = tuple(o if v is None else v for o, v in zip(old + (None,) * (len(values) - len(old)), values))
    return state


def rows_of(df, names=("model", "weight")):
    return {r["id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_batches_fold(spark, tmp_path):
    rnd, table, batches = random.Random(4), BucketTable(str(tmp_path / "t"), buckets=5), []
    for b in range(4):
        rows = [(rnd.choice([f"p-{rnd.randrange(40)}", None]) if i % 9 == 0 else f"p-{rnd.randrange(40)}", 1_000 * b + i, rnd.choice([None, f"m{b}{i}"]), rnd.choice([None, float(i)])) for i in range(30)]
        batches.append(rows)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert table.append(df, b, "first") == b + 1
        assert table.append(df, b, "first") == b + 1  # a retry
        assert rows_of(table.current(spark)) == fold(batches)
    assert rows_of(table.current(spark, 2)) == fold(batches[:2])


def test_other_buckets_keep_their_files(spark, tmp_path):
    table = BucketTable(str(tmp_path / "t"), buckets=16)
    table.append(spark.createDataFrame([(f"p-{i}", i, "a", 1.0) for i in range(300)], SCHEMA), 0)
    before = table.manifest(spark)["files"]
    stamps = {p: p.stat().st_mtime_ns for p in Path(tmp_path / "t" / "data").rglob("*.parquet")}
    table.append(spark.createDataFrame([("p-7", 999, "b", None)], SCHEMA), 1)
    after = table.manifest(spark)["files"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert all(p.stat().st_mtime_ns == t for p, t in stamps.items())
    assert rows_of(table.current(spark))["p-7"] == ("b", 1.0) and table.current(spark).count() == 300
    assert table.vacuum(spark) == 1 and table.versions(spark) == [2]
    assert table.current(spark).count() == 300 and not any(p.exists() for p in stamps if "_bucket=" + next(b for b in before if before[b] != after[b]) + "/" in str(p))


def test_queries_and_columns_that_come_later(spark, tmp_path):
    table = BucketTable(str(tmp_path / "t"), buckets=3)
    table.append(spark.createDataFrame([("a", 1, "x", 1.0), ("b", 2, "y", 2.0)], SCHEMA), 0, "first")
    table.append(spark.createDataFrame([("c", 3, "z", 3.0, 7), ("a", 4, None, None, 8)], SCHEMA + ", extra int"), 0, "second")  # its own numbers
    table.append(spark.createDataFrame([("a", 5, "w", None)], SCHEMA), 1, "first")
    table.append(spark.createDataFrame([], SCHEMA), 2, "first")
    assert rows_of(table.current(spark), ("model", "weight", "extra")) == {"a": ("w", 1.0, 8), "b": ("y", 2.0, None), "c": ("z", 3.0, 7)}
    assert table.manifest(spark)["applied"] == {"first": 2, "second": 0}
    assert BucketTable(str(tmp_path / "t"), buckets=99).manifest(spark)["buckets"] == 3


def test_a_second_writer_begins_anew(spark, tmp_path, monkeypatch):
    one, two = BucketTable(str(tmp_path / "t"), buckets=2), BucketTable(str(tmp_path / "t"), buckets=2)
    publish, raced = BucketTable._publish, []

    def late(self, spark_, manifest):
        if self is one and not raced:  # the other writer is there first
            raced.append(1)
            two.append(spark.createDataFrame([("b", 1, "two", None)], SCHEMA), 0, "two")
        publish(self, spark_, manifest)

    monkeypatch.setattr(BucketTable, "_publish", late)
    assert one.append(spark.createDataFrame([("a", 1, "one", None)], SCHEMA), 0, "one") == 2
    assert rows_of(one.current(spark)) == {"a": ("one", None), "b": ("two", None)}
    monkeypatch.undo()
    with pytest.raises(Outdated):
        one._publish(spark, one.manifest(spark))


def test_a_stream_reaches_the_state_of_its_batches(spark, tmp_path):
    table, src, batches = BucketTable(str(tmp_path / "t"), buckets=4), str(tmp_path / "in"), []
    for b in range(3):
        rows = [(f"p-{i % 11}", 100 * b + i, f"m{b}-{i}" if i % 2 else None, float(i)) for i in range(20)]
        batches.append(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        stream_upsert(stream, table, str(tmp_path / "ck")).awaitTermination(120)
        assert rows_of(table.current(spark)) == fold(batches)
    assert table.current(spark).filter(F.col("id").isNull()).count() == 0
    with pytest.raises(ValueError):
        BucketTable(str(tmp_path / "none")).current(spark)
