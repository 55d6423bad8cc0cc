"""Threshold-scaled sketches of descriptions: every shingle hash below a fixed fraction of the range."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .grams import WORD, Table, hash64

WORDS, FRACTION, BYTES, MOST_RANGES = 5, 1 / 2, 6, 10_000
_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
COMPARED = T.StructType([T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
                         T.StructField("fingerprint", T.BinaryType()), T.StructField("edited_fingerprint", T.BinaryType()),
                         T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def table() -> Table:
    return Table(lambda w: (hash64(w),), 1)


def _limit(fraction: float) -> np.uint64:
    return np.uint64(int(fraction * (1 << 8 * BYTES)))


def sketch(text: str | None, words: Table, fraction: float = FRACTION) -> np.ndarray:
    """Sorted 48-bit hashes of the distinct five-word shingles of a whole text, those below ``fraction`` of the range.

    A text of one to four words is one shingle. The threshold is the same for all texts, so the union of two sketches is the sketch of
    both texts' shingles, and a sketch of a lower fraction is a part of it. A text of few shingles may have no hash below.
    """
    w = words.rows(WORD.findall((text or "").lower()))[:, 0]
    if not len(w):
        return np.empty(0, dtype=np.uint64)
    size = min(WORDS, len(w))
    h = np.zeros(len(w) - size + 1, dtype=np.uint64) + np.uint64(size)
    for i in range(size):
        h = (h + w[i:len(w) - size + 1 + i]) * _MULTIPLIER
        h ^= h >> np.uint64(31)
    h = (h * _MIX) >> np.uint64(64 - 8 * BYTES)
    return np.unique(h[h < _limit(fraction)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller text's shingles in the other, estimated from the hashes of both sketches.

    1 for two sketches without hashes, 0 if just one has none: such texts have no words, or few.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def packed(hashes: np.ndarray) -> bytes:
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES:].tobytes()


def fingerprint(catalog: DataFrame, id: str = "id", description: str = "description", fraction: float = FRACTION) -> DataFrame:
    """One row (id, fingerprint) per record: its sketch as sorted six-byte numbers. No shuffle.

    A null or empty description has an empty fingerprint; equal descriptions have equal ones. Other columns are ignored.
    """
    @F.pandas_udf("binary")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = table()
        for texts in batches:
            yield pd.Series([packed(sketch(t, words, fraction)) for t in texts], dtype=object)

    return catalog.select(F.col(id).alias("id"), found(F.col(description)).alias("fingerprint"))


def _cuts(rows: DataFrame, per_part: int) -> tuple[list[tuple], tuple]:
    """Places that part the records into ranges of about ``per_part``, and the last place; a place is (has an id, id, inverted hash), rising.

    Eight records per range are drawn by hash. There are at most MOST_RANGES ranges, so the list is bounded.
    """
    place = F.struct(F.col("name").isNotNull().cast("int").alias("some"), F.coalesce("name", F.lit("" if dict(rows.dtypes)["name"] == "string" else 0)).alias("name"), F.bitwise_not("hash").alias("hash"))
    n, top = rows.agg(F.count("*"), F.max(place)).first()
    parts = max(1, min(MOST_RANGES, n // per_part))
    share = min(1.0, 8 * parts / max(1, n))
    if parts == 1:
        return [], tuple(top or ())
    drawn = rows.where(F.pmod(F.xxhash64("name", "hash", F.lit(19)), F.lit(1 << 30)) < int(share * (1 << 30))).select(place.alias("place")).collect()
    return sorted({tuple(r[0]) for r in drawn})[8::8], tuple(top)


def compare_with_next(catalog: DataFrame, id: str = "id", description: str = "description", fraction: float = FRACTION,
                      per_part: int = 2_000) -> DataFrame:
    """Each record's fingerprint against its edited description and against the next record, by descending id.

    The edited description has the last third (of the code points, rounded down) replaced by as much of the next record's beginning
    as there is; after the last record comes the first. One row per record: id (as it is), n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (estimated containment, 0 to 1). Whole numbers are ordered as such, other ids as texts.

    The records are dealt to ranges of (id, hash of the description) once; the first record of each range also goes to the range
    before, so neighbours meet without a global sort or a second shuffle, and a range is read as a stream.

    A null description is empty. Records without id come last; records with the same id, or none, are in the order of a hash of the
    description, and only wholly equal ones always share a range. A single record is its own next one. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = catalog.select(F.col(id).alias("id"), F.coalesce(F.col(description), F.lit("")).alias("description"))
    whole = isinstance(rows.schema["id"].dataType, T.IntegralType)
    rows = rows.withColumn("name", F.col("id").cast("long" if whole else "string")).withColumn("hash", F.xxhash64("description"))
    cuts, top = _cuts(rows, per_part)
    found = set(cuts)

    @F.pandas_udf("array<struct<part:int,guest:boolean>>")
    def ranges(names: pd.Series, hashes: pd.Series) -> pd.Series:
        out = []
        for x, h in zip(names, hashes):
            x = (0, 0 if whole else "", ~h) if x is None else (1, int(x) if whole else x, ~h)
            part = len(cuts) - bisect_left(cuts, x)
            row = [{"part": part, "guest": False}]
            if x in found:
                row.append({"part": part - 1, "guest": True})
            if x == top:
                row.append({"part": len(cuts), "guest": True})
            out.append(row)
        return pd.Series(out, dtype=object)

    # Names as texts: a null among integers would make them floating-point numbers, too coarse for large ids.
    dealt = rows.select("*", F.inline(ranges(F.col("name").cast("string"), F.col("hash"))))
    ordered = dealt.repartition("part").sortWithinPartitions("part", "guest", F.desc_nulls_last("name"), "hash").select("part", "guest", "id", "description")
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *COMPARED.fields])
    target = to_arrow_schema(schema)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = table(), None

        def one(row, own, text, following):
            n = len(text)
            edited = text[:n - n // 3] + following[0][:n // 3]
            changed = sketch(edited, words, fraction)
            return (row, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), packed(own), packed(changed), likeness(own, changed), likeness(own, following[1]))

        for b in batches:
            out = []
            for part, guest, row, text in zip(*(c.to_pylist() for c in b.columns)):
                if guest and (last is None or last[0] != part):
                    continue  # the range has got its following record, or has no record itself
                own = sketch(text, words, fraction)
                if last is not None and last[0] == part:
                    out.append(one(last[1], last[3], last[2], (text, own)))
                last = None if guest else (part, row, text, own)
            cols = list(zip(*out)) if out else [[]] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)

    return ordered.mapInArrow(compared, schema)
