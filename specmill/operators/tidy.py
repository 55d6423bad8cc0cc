"""One aggregation, many report lines: turn a wide one-row result into (name, value ...) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, rows: list[dict[str, Column]], keep: list[str] | None = None) -> DataFrame:
    """Explode a fixed list of structs built from the columns of each input row."""
    items = F.array(*[F.struct(*[v.alias(k) for k, v in r.items()]) for r in rows])
    return df.select(*(keep or []), F.inline(items))


def metrics(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    return lines(df, [{"metric": F.lit(k), "value": v.cast("double")} for k, v in named.items()])


def pairs(df: DataFrame, named: dict[str, Column], key: str = "facet", value: str = "value",
          keep: list[str] | None = None) -> DataFrame:
    """Unpivot several text columns of every row, NULLs dropped."""
    return lines(df, [{key: F.lit(k), value: v.cast("string")} for k, v in named.items()], keep).filter(
        F.col(value).isNotNull())


_ENTRY = "array<struct<section:string,key:string,sub:string,v:bigint,one:bigint>>"


def entry(section: str, key: Column | str, value: Column | int = 1, sub: Column | None = None) -> Column:
    """One entry of ``tally``; ``key`` is a column, or a text itself."""
    text = F.lit(key) if isinstance(key, str) else key
    return F.struct(F.lit(section).alias("section"), text.cast("string").alias("key"), (F.lit(None) if sub is None else sub).cast("string").alias("sub"),
                    (F.lit(value) if isinstance(value, int) else value).cast("long").alias("v"), F.lit(1).cast("long").alias("one"))


def tally(df: DataFrame, entries: list[Column], fixed: list[tuple[str, str]] = ()) -> DataFrame:
    """(section, key, sub, n, of) over all entries of all rows, from one scan: ``n`` adds up the entries' values, ``of`` counts them.

    ``entries`` are arrays of ``entry`` structs, or null for none. Sections and keys in ``fixed`` are there with 0 even where no row has them.
    """
    lists = [F.coalesce(e.cast(_ENTRY), F.array().cast(_ENTRY)) for e in entries]
    rows = df.select(F.inline(F.concat(*lists)))
    if fixed:
        zeros = df.sparkSession.createDataFrame(list(fixed), "section string, key string")
        rows = rows.unionByName(zeros.selectExpr("section", "key", "CAST(NULL AS STRING) AS sub", "0L AS v", "0L AS one"))
    return rows.groupBy("section", "key", "sub").agg(F.sum("v").alias("n"), F.sum("one").alias("of"))


def with_zeros(counts: DataFrame, keys: list[tuple], names: list[str], count: str = "n") -> DataFrame:
    """Left join on a fixed key list so that empty buckets show zero; the key list is a literal, hence tiny."""
    spark = counts.sparkSession
    full = spark.createDataFrame(keys, ", ".join(f"{n} string" for n in names))
    return (full.join(counts, names, "left")
            .withColumn(count, F.coalesce(F.col(count), F.lit(0)).cast("long")))


def limited(df: DataFrame, k: int | None) -> DataFrame:
    return df if k is None else df.limit(k)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """First k rows per group (all of them without k), numbered; Spark prunes each map task to k rows per group before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(w))
    return out if k is None else out.filter(F.col(rank) <= k)
