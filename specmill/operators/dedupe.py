"""Duplicate detection and order-aware merging of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import dedupe_key
from ..functions.text import c, js_trim, truthy
from ..functions.web import url_key
from .facets import has_list
from .normalize import score
from .tidy import limited

FROM_FIRST = ["id", "url", "lastUpdated", "createdAt", "scrapedAt"]


def dedupe_fold(df: DataFrame, key: Column | None = None, recompute: bool = True, mode: str = "fixed",
                media: str = "inline", pos: str = "_pos") -> DataFrame:
    """Merge rows with the same key as a left fold in input order, without folding: every rule is an aggregate with
    partial aggregation, so a key that owns a third of the table costs one partial row per map task.

    Identity fields come from the first row; texts keep the longest (earlier on ties); lists become their ordered
    union; anything else the first non-NULL value. List elements are reduced to distinct (key, element) before they
    meet. Media lists (structs) are united the same way and counted (``n_<list>``); with ``mode='compat'`` they are put one after the
    other, equal items too, as objects are never equal there. A record's lists are one row, so a key
    with very many distinct items makes a large row: ``media='rows'`` leaves the media to ``fold_media``, which keeps one row per item.
    ``recompute`` rescores the merged record; otherwise the derived fields follow the same rules as any other field.
    """
    keyed = df.withColumn("_key", key if key is not None else dedupe_key(mode=mode))
    aggs, lists, structs = [], [], []
    for f in df.schema.fields:
        n = f.name
        if n == pos:
            continue
        if isinstance(f.dataType, T.ArrayType):
            (structs if isinstance(f.dataType.elementType, T.StructType) else lists).append(n)
            aggs.append(F.max(c(n).isNotNull()).alias(f"_has_{n}"))
        elif n in FROM_FIRST:
            aggs.append(F.min_by(n, pos).alias(n))
        elif isinstance(f.dataType, T.StringType):
            aggs.append(F.max_by(n, F.when(c(n).isNotNull(), F.struct(F.length(n), -c(pos)))).alias(n))
        else:
            aggs.append(F.min_by(n, F.when(c(n).isNotNull(), c(pos))).alias(n))
    aggs += [F.sum(F.when(c(n).isNotNull(), F.size(n)).otherwise(0)).alias(f"n_{n}") for n in structs if f"n_{n}" not in df.columns]
    out = keyed.groupBy("_key").agg(F.min(pos).alias(pos), F.count("*").alias("_merged"), *aggs)
    unions = lists + (structs if media == "inline" else [])
    if unions:
        out = out.join(_list_unions(keyed, unions, pos, structs if mode == "compat" else []), "_key", "left")
        empty = {n: F.array().cast(df.schema[n].dataType) for n in unions}
        out = out.withColumns({n: F.when(F.col(f"_has_{n}"), F.coalesce(F.col(f"_u_{n}"), empty[n])) for n in unions})
    out = out.drop(*[x for x in out.columns if x.startswith(("_has_", "_u_"))])
    return score(out) if recompute else out


def _list_unions(keyed: DataFrame, names: list[str], pos: str, repeated: list[str]) -> DataFrame:
    """Ordered distinct elements per key for several list columns, all elements of ``repeated`` ones: columns of one element type share one pass."""
    by_type: dict[str, list[str]] = {}
    for n in names:
        by_type.setdefault(keyed.schema[n].dataType.simpleString(), []).append(n)
    parts = None
    for group in by_type.values():
        items = F.flatten(F.array(*[_tagged(n, keyed.schema[n].dataType) for n in group]))
        found = keyed.select("_key", pos, F.inline(items)).filter("_e is not null")
        again = group[0] in repeated
        first = found.select("_key", "_f", "_e", F.struct(pos, "_i").alias("_at")) if again else found.groupBy("_key", "_f", "_e").agg(F.min(F.struct(pos, "_i")).alias("_at"))
        sets = first.groupBy("_key").agg(*[
            F.transform(F.array_sort(F.collect_list(F.when(c("_f") == n, F.struct("_at", "_e")))), lambda x: x["_e"]).alias(f"_u_{n}")
            for n in group])
        parts = sets if parts is None else parts.join(sets, "_key", "full")
    return parts


def _tagged(name: str, dtype: T.DataType) -> Column:
    """List elements with their column name and index; an absent list gives none."""
    return F.transform(F.coalesce(c(name), F.array().cast(dtype)),
                       lambda e, i: F.struct(F.lit(name).alias("_f"), i.alias("_i"), e.alias("_e")))


def fold_media(df: DataFrame, column: str, key: Column | None = None, mode: str = "fixed", pos: str = "_pos") -> DataFrame:
    """Media items of every merged record as rows (key, position, item), in merge order by (position, i): all of them, equal ones too."""
    keyed = df.withColumn("_key", key if key is not None else dedupe_key(mode=mode))
    return keyed.select(c("_key").alias("key"), pos, F.posexplode(column).alias("i", "item"))


def _grouped(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of more than one row by URL, and those by vendor + model where no member is in a URL group."""
    rows = df.select("id", F.when(truthy("url"), url_key("url")).alias("_url"),
                     F.lower(F.concat_ws("|", F.coalesce("manufacturer", F.lit("")), F.coalesce("model", F.lit("")))).alias("_model"))
    urls = (rows.filter(c("_url").isNotNull()).groupBy("_url").agg(F.count("*").alias("n")).filter("n > 1"))
    marked = rows.join(urls.select("_url", F.lit(True).alias("_dup")), "_url", "left")
    models = (marked.groupBy("_model").agg(F.count("*").alias("n"), F.count("_dup").alias("_covered"))
              .filter("n > 1 and _covered = 0"))
    return urls, models


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Groups of more than one row by URL, then by vendor + model where no member is in a URL group."""
    urls, models = _grouped(df)
    return (urls.select(F.lit("url").alias("type"), c("_url").alias("key"), "n")
            .unionByName(models.select(F.lit("model").alias("type"), c("_model").alias("key"), "n")))


def model_groups(df: DataFrame) -> DataFrame:
    """Groups (key, n) of rows with the same vendor and model, none of which shares its URL with another row."""
    return _grouped(df)[1].select(c("_model").alias("key"), "n")


def best_key() -> Column:
    return F.concat_ws("|", F.coalesce("manufacturer", F.lit("")), F.lower(js_trim(F.coalesce("model", F.lit("")))))


def richness() -> Column:
    parts = [truthy(f) for f in ("loadCapacity", "liftingSpeed", "motorPower")] + [has_list("images"), has_list("pdfs")]
    return sum((p.cast("int") for p in parts), F.lit(0))


def dedupe_best(df: DataFrame, key: Column | None = None, score_col: Column | None = None) -> DataFrame:
    """One row per key: the richest, the earliest among equals; ``first_pos`` is where the key first appeared."""
    key = key if key is not None else best_key()
    s = score_col if score_col is not None else richness()
    rows = df.select(key.alias("_key"), F.struct(s.alias("s"), (-c("_pos")).alias("p")).alias("_o"), "_pos",
                     F.struct(*df.columns).alias("_row"))
    return (rows.groupBy("_key").agg(F.max_by("_row", "_o").alias("_row"), F.min("_pos").alias("first_pos"))
            .select("_row.*", "first_pos"))


def duplicate_models(df: DataFrame, k: int | None = None) -> DataFrame:
    return limited(df.groupBy(best_key().alias("key")).agg(F.count("*").alias("n"), F.min("_pos").alias("first_pos"))
            .filter("n > 1").orderBy(F.col("n").desc(), "first_pos"), k)


def dedupe_links(links: DataFrame, by: list[str], pos: str = "pos", keep: str = "last") -> DataFrame:
    """One row per key: the last (or first) value at the first position."""
    rest = [x for x in links.columns if x not in by and x != pos]
    pick = F.max_by if keep == "last" else F.min_by
    return links.groupBy(*by).agg(F.min(pos).alias(pos), pick(F.struct(*rest), pos).alias("_v")).select(*by, pos, "_v.*")


def merge_classes(a, b) -> Column:
    """Existing names first, then the new ones that differ in more than case."""
    a, b = F.coalesce(c(a), F.array().cast("array<string>")), F.coalesce(c(b), F.array().cast("array<string>"))
    low = F.transform(a, F.lower)
    return F.concat(a, F.filter(b, lambda x: ~F.array_contains(low, F.lower(x))))


def dedupe_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, after and removed, then the vendor counts of the result."""
    both = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(F.lit(0).alias("b"), F.lit(1).alias("a")))
    n = both.agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    head = n.select(F.inline(F.array(*[F.struct(F.lit("records").alias("section"), F.lit(k).alias("key"), v.alias("n"))
                                       for k, v in (("before", c("b")), ("after", c("a")), ("removed", c("b") - c("a")))])))
    vendors = after.groupBy("manufacturer").agg(F.count("*").alias("n")).select(
        F.lit("manufacturer").alias("section"), c("manufacturer").alias("key"), "n")
    return head.unionByName(vendors)
