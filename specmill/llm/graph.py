"""Joins and components that stay on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import written

WORDS = 1 << 18


def free(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores after it until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def _place(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key, F.lit(29))
    return F.pmod(h, F.lit(WORDS)).cast("int"), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")


def maybe_in(rows: DataFrame, key: str, members: DataFrame, member: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` parted into those whose key may be in ``members`` and those whose key is not, without a shuffle of ``rows``.

    The members are marked in a table of 2**24 bits, held as at most 2**18 rows of 64 bits: that is all that is broadcast, whatever
    the number of members. With very many of them the marks tell nothing any more and all rows are in the first part. Null keys
    are in the second. The rows keep their columns, whatever their names.
    """
    w, b, m = free(rows.columns, "word", "bit", "marks")
    word, bit = _place(F.col(f"`{member}`"))
    marks = members.where(F.col(f"`{member}`").isNotNull()).select(word.alias(w), bit.alias(b)).groupBy(w).agg(F.bit_or(F.expr(f"shiftleft(1L, {b})")).alias(m))
    word, bit = _place(F.col(f"`{key}`"))
    looked = rows.withColumn(w, F.when(F.col(f"`{key}`").isNotNull(), word)).withColumn(b, bit).join(F.broadcast(marks), w, "left")
    hit = F.expr(f"coalesce(shiftrightunsigned({m}, {b}) & 1L, 0L) = 1L")
    return looked.where(hit).drop(w, b, m), looked.where(~hit).drop(w, b, m)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``links`` (a, b): the smallest node that can be reached.

    Alternating large-star and small-star steps: each step points nodes at the smallest neighbour, by a partially aggregated minimum
    and an equi-join. Each round is a written table; the rounds end when nothing changes, after about the logarithm of the longest
    path. No group is collected anywhere.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = now
