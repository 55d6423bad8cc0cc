"""Joining catalogues: merge, upsert, delete, resume, and the fill rules of enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mining import best_dimension, best_weight
from ..functions.text import c, truthy
from ..schema import CONFIDENCE_FIELDS, ENRICHABLE
from .dedupe import merge_classes
from .tidy import top_k

MERGE_FILL = ["images", "variableSpeedControl", "tuningParameters"]


def union_catalogs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def minus_keys(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


delete_ids = minus_keys


def pending(files: DataFrame, done: DataFrame, key: str = "filename") -> DataFrame:
    """Files not yet in the extraction table."""
    return minus_keys(files, done, key)


def array_merge(a, b) -> Column:
    return F.array_distinct(F.concat(c(a), c(b)))


def map_fill(a, b) -> Column:
    """Map a plus the entries of b whose key a lacks."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(c(a), none), F.coalesce(c(b), none)
    return F.map_concat(a, F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)))


def map_keys_union(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.explode(F.map_keys(col)).alias("key")).distinct()


def all_documents(df: DataFrame, prefix: str = "/media/pdfs/") -> Column:
    """Linked documents first, then local copies whose address is rebuilt from the file name."""
    cols = [("pdfs", "remote"), ("downloadedPDFs", "local")]

    def as_docs(column, origin):
        def one(d):
            url = d["url"] if origin == "remote" else F.concat(F.lit(prefix), F.substring_index(d["localPath"], "/", -1))
            return F.struct(url.alias("url"), d["title"].alias("title"), d["type"].alias("type"), F.lit(origin).alias("origin"))

        empty = F.array().cast("array<struct<url:string,title:string,type:string,origin:string>>")
        return F.coalesce(F.transform(column, one), empty)

    return F.concat(*[as_docs(f, o) for f, o in cols])


def _empty(df: DataFrame, x: str, col: Column | None = None) -> Column:
    t, v = df.schema[x].dataType, col if col is not None else c(x)
    if isinstance(t, T.ArrayType):
        return v.isNull() | (F.size(v) == 0)
    if isinstance(t, T.StringType):
        return v.isNull() | (v == "")
    return v.isNull()


def merge_catalogs(base: DataFrame, other: DataFrame, fill=tuple(MERGE_FILL), key: str = "id", pos: str = "_pos") -> DataFrame:
    """Base rows stay and get their empty ``fill`` fields from ``other``; unknown ids are appended once, later rows of
    the same id fill the first. ``_merge`` says base, updated or added; ``_updated`` marks filled media, also on added
    rows. One full outer join on the id after a per-id aggregate of ``other``.
    """
    fill = [f for f in fill if f in other.columns]
    rest = [x for x in other.columns if x not in fill and x not in (key, pos)]
    aggs = [F.min_by(F.struct(*rest), pos).alias("_first"), F.min(pos).alias("_opos"), F.count("*").alias("_on")]
    aggs += [F.min_by(f, F.when(~_empty(other, f), c(pos))).alias(f"_o_{f}") for f in fill]
    aggs += [F.min_by(_empty(other, fill[0]), pos).alias("_late")] if fill else []
    o = other.groupBy(key).agg(*aggs)
    j = base.withColumn("_in_base", F.lit(True)).join(o, key, "full")
    known = F.coalesce("_in_base", F.lit(False))
    out = {}
    for x in base.columns:
        if x in (key, pos):
            continue
        if x in fill:
            out[x] = F.when(known & ~_empty(base, x), c(x)).otherwise(F.coalesce(F.col(f"_o_{x}"), c(x)))
        elif x in rest:
            out[x] = F.when(known, c(x)).otherwise(F.col(f"_first.{x}"))
    first = fill[0] if fill else None
    got = F.col(f"_o_{first}").isNotNull() if first else F.lit(False)
    filled = F.when(known, got & _empty(base, first)).otherwise(got & c("_late")) if first else F.lit(False)
    flags = {"_updated": filled, "_other_rows": F.coalesce("_on", F.lit(0)),
             "_merge": F.when(~known, "added").when(filled, "updated").otherwise("base"),
             pos: F.when(known, c(pos)).otherwise(c("_opos"))}
    cols = [key, *[v.alias(k) for k, v in out.items()], *[v.alias(k) for k, v in flags.items()]]
    return j.select(*cols)


def merge_counts(merged: DataFrame) -> DataFrame:
    added = F.count_if(c("_merge") == "added")
    updated = F.count_if("_updated")
    return merged.agg(added.alias("added"), updated.alias("updated"),
                      (F.sum("_other_rows") - added - updated).alias("skipped"), F.count("*").alias("total"))


def upsert(base: DataFrame, updates: DataFrame, now=None, key: str = "id", pos: str = "_pos") -> DataFrame:
    """Non-NULL update fields override, the last update of an id wins per field; new ids are inserted.
    With ``now`` given, touched rows get ``lastUpdated`` and new rows ``createdAt``."""
    fields = [x for x in updates.columns if x not in (key, pos)]
    u = updates.groupBy(key).agg(F.min(pos).alias("_upos"), *[
        F.max_by(f, F.when(c(f).isNotNull(), c(pos))).alias(f"_u_{f}") for f in fields])
    j = base.withColumn("_old", F.lit(True)).join(u, key, "full")
    cols = [c(key), F.coalesce(pos, "_upos").alias(pos)]
    stamps = {"lastUpdated", "createdAt"} if now is not None else set()
    for x in base.columns:
        if x not in (key, pos) and x not in stamps:
            cols.append((F.coalesce(f"_u_{x}", x) if x in fields else c(x)).alias(x))
    for x in fields:
        if x not in base.columns and x not in stamps:
            cols.append(F.col(f"_u_{x}").alias(x))
    if now is not None:
        t = F.lit(now).cast("timestamp")
        old = lambda n: F.col(n).cast("timestamp") if n in base.columns else F.lit(None).cast("timestamp")
        cols.append(F.when(c("_upos").isNotNull(), t).otherwise(old("lastUpdated")).alias("lastUpdated"))
        cols.append(F.when(c("_old").isNull(), t).otherwise(old("createdAt")).alias("createdAt"))
    return j.select(*cols)


def insert_new(base: DataFrame, updates: DataFrame, key: str = "id", pos: str = "_pos") -> DataFrame:
    """Insert only unknown ids (their first row); known ones stay untouched."""
    fresh = minus_keys(updates, base, key)
    rest = [x for x in updates.columns if x != key]
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*rest), pos).alias("_r")).select(key, "_r.*")
    return union_catalogs(base, first)


def last_per_key(rows: DataFrame, key: str, pos: str = "_pos") -> DataFrame:
    """One row per key: the last by ``pos``; without such a column the greatest by its fields, so the choice is fixed."""
    rest = [x for x in rows.columns if x not in (key, pos)]
    kept = [x for x in rest if not isinstance(rows.schema[x].dataType, T.MapType)]  # maps have no order
    order = F.struct(pos, *kept) if pos in rows.columns else F.struct(*kept)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def _both(df: DataFrame, ext: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    ext = last_per_key(ext, key)
    fields = [x for x in ext.columns if x != key]
    return df.join(ext.select(key, *[c(f).alias(f"_x_{f}") for f in fields]), key, "left"), fields


def _stamped(df: DataFrame, changed: Column, now, provider: str | None) -> DataFrame:
    """With ``now``: enriched flag, time and provider on the rows that an extraction has reached."""
    if now is None:
        return df
    old = lambda n, t: c(n).cast(t) if n in df.columns else F.lit(None).cast(t)
    new = {"llmEnriched": F.when(changed, F.lit(True)).otherwise(old("llmEnriched", "boolean")),
           "llmEnrichedDate": F.when(changed, F.lit(now).cast("timestamp")).otherwise(old("llmEnrichedDate", "timestamp"))}
    if provider is not None:
        new["llmProvider"] = F.when(changed, F.lit(provider)).otherwise(old("llmProvider", "string"))
    return df.withColumns(new)


def fill_from(df: DataFrame, ext: DataFrame, fields=tuple(ENRICHABLE), key: str = "id", now=None, provider: str | None = None) -> DataFrame:
    """Fill empty fields from the last extraction of an id and list what was filled in ``_enrichedFields``.

    With ``now`` rows that got a value are stamped (``llmEnriched``, ``llmEnrichedDate``, ``llmProvider``)."""
    j, have = _both(df, ext, key)
    use = [f for f in fields if f in have and f in df.columns]
    gives = {f: ~_empty(df, f, F.col(f"_x_{f}")) for f in use}
    lacks = {f: (c(f).isNull() if isinstance(df.schema[f].dataType, T.ArrayType) else _empty(df, f)) for f in use}
    out = {f: F.when(gives[f] & lacks[f], F.col(f"_x_{f}")).otherwise(c(f)) for f in use}
    out["_enrichedFields"] = F.array_compact(F.array(*[F.when(gives[f] & lacks[f], F.lit(f)) for f in use]))
    if "classification" in use:
        x = F.col("_x_classification")
        out["classification"] = F.when(x.isNull(), c("classification")).when(
            _empty(df, "classification"), x).otherwise(merge_classes("classification", x))
    if "safetyFeatures" in have and "safetyFeatures" in df.columns:
        out["safetyFeatures"] = map_fill("safetyFeatures", "_x_safetyFeatures")
    return _stamped(j.withColumns(out), F.size("_enrichedFields") > 0, now, provider).drop(*[f"_x_{f}" for f in have])


def _take_new(empty: Column, new: Column, new_conf: Column, old_conf: Column) -> Column:
    return new.isNotNull() & (empty | F.coalesce((new_conf > 0.8) & (old_conf < 0.8), F.lit(False)))


def merge_confident(df: DataFrame, ext: DataFrame, fields=tuple(CONFIDENCE_FIELDS), min_confidence: float | None = None,
                    key: str = "id", now=None, provider: str | None = None) -> DataFrame:
    """New values replace empty fields, or all fields when the new confidence is above 0.8 and the old one below.

    With ``now`` the rows that an extraction reached are stamped."""
    if min_confidence is not None:
        ext = ext.filter(c("confidence") > min_confidence)
    j, have = _both(df, ext, key)
    use = [f for f in fields if f in have and f in df.columns]
    conf = F.col("_x_confidence")
    out = {f: F.when(_take_new(_empty(df, f), F.col(f"_x_{f}"), conf, c("confidence")), F.col(f"_x_{f}")).otherwise(c(f))
           for f in use}
    out["confidence"] = F.when(F.coalesce(conf != 0, F.lit(False)), F.greatest(F.coalesce("confidence", F.lit(0.0)), conf)
                               ).otherwise(c("confidence"))
    return _stamped(j.withColumns(out), conf.isNotNull(), now, provider).drop(*[f"_x_{f}" for f in have])


def enrich_in_order(df: DataFrame, exts: DataFrame, fields: list[str], per_kind: int, min_confidence: float = 0.5,
                    key: str = "id") -> DataFrame:
    """Apply image, document and text extractions in that order with the confidence rule.

    ``exts`` holds (id, kind, pos, confidence, fields). The first ``per_kind`` image and document extractions count (by position,
    before the confidence test) and the first text extraction, text only when load or speed is still missing. The few steps become
    columns of one row per id, so no row-by-row folding is needed.
    """
    r = top_k(exts, [key, "kind"], [c("pos")], per_kind, "_r")
    steps = [("image", i) for i in range(1, per_kind + 1)] + [("pdf", i) for i in range(1, per_kind + 1)] + [("text", 1)]
    val = F.struct("confidence", *fields)
    wide = r.groupBy(key).agg(*[
        F.max(F.when((c("kind") == k) & (c("_r") == i) & (c("confidence") > min_confidence), val)).alias(f"_s{n}")
        for n, (k, i) in enumerate(steps)])
    out = df.join(wide, key, "left")
    for n, (k, _) in enumerate(steps):
        x = f"_s{n}"
        on = F.col(x).isNotNull()
        if k == "text":
            on = on & truthy("description") & (~truthy("loadCapacity") | ~truthy("liftingSpeed"))
        conf = F.when(on, F.col(f"{x}.confidence"))
        new = {f: F.when(on, F.col(f"{x}.{f}")) for f in fields}
        cols = {f: F.when(_take_new(_empty(df, f), v, conf, c("confidence")), v).otherwise(c(f)) for f, v in new.items()}
        cols["confidence"] = F.when(conf.isNotNull(), F.greatest(F.coalesce("confidence", F.lit(0.0)), conf)).otherwise(
            c("confidence"))
        out = out.withColumns(cols)
    return out.drop(*[f"_s{n}" for n in range(len(steps))])


def override_from(df: DataFrame, ext: DataFrame, text: str = "description", key: str = "id") -> DataFrame:
    """Every extracted value replaces the present one, provided the text is at least 20 characters long."""
    j, have = _both(df, ext, key)
    ok = F.coalesce(F.length(F.trim(text)) >= 20, F.lit(False))
    out = {f: (F.when(ok & F.col(f"_x_{f}").isNotNull(), F.col(f"_x_{f}")).otherwise(c(f)) if f in df.columns
               else F.when(ok, F.col(f"_x_{f}"))) for f in have}
    return j.withColumns(out).drop(*[f"_x_{f}" for f in have])


def promote(ext: DataFrame, now=None) -> DataFrame:
    """Extractions with a capacity become catalogue rows: id from vendor and title, marked as extracted."""
    safe = F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]", "-"), "-+", "-")
    vendor = F.regexp_replace(F.lower("manufacturer"), r"\s+", "-")
    out = ext.filter(truthy("loadCapacity") & (c("error").isNull() if "error" in ext.columns else F.lit(True)))
    out = out.withColumns({"id": F.concat_ws("-", vendor, safe), "model": c("title"), "pdfExtracted": F.lit(True)})
    return out.withColumn("lastUpdated", F.lit(now).cast("timestamp")) if now is not None else out


def fill_sizes(df: DataFrame, mined: DataFrame, links: DataFrame) -> DataFrame:
    """Fill size and weight from mined texts. ``mined`` holds (key, key_pos, dimensions, weights); ``links`` (id, key).
    Per product the first key with a usable value wins."""
    best = mined.select("key", "key_pos", best_dimension("dimensions").alias("d"), best_weight("weights").alias("w"))
    per = links.join(best, "key").groupBy("id").agg(
        F.min_by("d", F.when(c("d").isNotNull(), c("key_pos"))).alias("_d"),
        F.min_by("w", F.when(c("w").isNotNull(), c("key_pos"))).alias("_w"))
    j = df.join(per, "id", "left")
    d, w = F.coalesce("dimensions", F.lit("")), F.coalesce("weight", F.lit(""))
    need_d = d.contains("Not specified") | d.contains("Not visible") | (F.length(d) < 5)
    need_w = w.contains("Not specified") | (F.length(w) < 3)
    return j.withColumns({"dimensions": F.when(need_d & c("_d").isNotNull(), c("_d")).otherwise(c("dimensions")),
                          "weight": F.when(need_w & c("_w").isNotNull(), c("_w")).otherwise(c("weight"))}).drop("_d", "_w")
