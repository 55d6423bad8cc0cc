"""Profile reports over the catalogue, its documents, run logs and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units
from ..functions.text import c, truthy
from ..functions.values import pct
from ..session import cut
from .facets import class_stats, has_list
from .rules import is_stale
from .tidy import entry, limited, lines, metrics, pairs, tally, top_k, with_zeros


def _filled(f: str) -> Column:
    return has_list(f) if f in ("classification", "images", "pdfs", "voltageOptions", "downloadedPDFs") else truthy(f)


STATS_FIELDS = ["loadCapacity", "liftingSpeed", "motorPower", "classification", "series", "url"]


def stats_report(df: DataFrame) -> DataFrame:
    """(section, key, n, pct): totals, vendor / class / capacity counts and completeness of six fields.

    One scan: each row gives its vendor with the model, its classes, its capacity bucket and its fields as entries; totals and distinct
    vendors and models come from the counts of these.
    """
    bucket = units.capacity_bucket(units.search_capacity("loadCapacity"), "tight")
    own = F.array(entry("model", c("manufacturer"), 1, c("model")), *[entry("completeness", f, _filled(f).cast("int")) for f in STATS_FIELDS])
    fixed = [("completeness", f) for f in STATS_FIELDS] + [("summary", k) for k in ("totalRecords", "uniqueModels", "manufacturers")]
    counts = tally(df, [own, _class_entries("classification"), F.when(bucket.isNotNull(), F.array(entry("capacity", bucket)))], fixed)
    per = counts.groupBy("section", "key").agg(F.sum("n").alias("n"), F.sum("of").alias("of"), F.count("*").alias("models"))
    line = lambda section, key, n: F.struct(section.alias("section"), key.alias("key"), n.alias("n"), c("of").alias("of"))
    vendor = [line(F.lit("manufacturer"), c("key"), c("n")), *[line(F.lit("summary"), F.lit(k), n) for k, n in (
        ("totalRecords", c("n")), ("uniqueModels", c("models")), ("manufacturers", F.lit(1).cast("long")))]]
    found = per.select(F.inline(F.when(c("section") == "model", F.array(*vendor)).otherwise(F.array(line(c("section"), c("key"), c("n"))))))
    out = found.groupBy("section", "key").agg(F.sum("n").alias("n"), F.sum("of").alias("of")).filter((c("section") != "manufacturer") | truthy("key"))
    return out.select("section", "key", "n", F.when(c("section") == "completeness", F.coalesce(pct("n", "of"), F.lit(0.0))).alias("pct"))


def _class_entries(section: str) -> Column:
    return F.transform("classification", lambda x: entry(section, x))


def top_vendors(df: DataFrame, k: int | None = None) -> DataFrame:
    return limited(df.groupBy("manufacturer").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "manufacturer"), k)


HEALTH_FIELDS = ["loadCapacity", "liftingSpeed", "motorPower", "weight", "dimensions", "images", "pdfs", "classification"]
HEALTH_CRITICAL = ["loadCapacity", "liftingSpeed", "classification"]


def health_report(df: DataFrame, now, vendors: int | None = None) -> DataFrame:
    """(item, n, pct) with field counts, stale rows, health score, the recommendations that apply (n = 1), and the rows of each
    vendor (with ``vendors`` of that many, largest first)."""
    row = df.agg(F.count("*").alias("t"), F.count_if(is_stale(now)).alias("stale"),
                 *[F.count_if(_filled(f)).alias(f) for f in HEALTH_FIELDS])
    share = lambda f: F.try_divide(c(f).cast("double"), c("t"))
    health = F.floor(sum((share(f) for f in HEALTH_CRITICAL), F.lit(0.0)) / 3 * 100 + 0.5)
    row = row.withColumn("health", health)
    low = c("health") < 50
    advice = {"scrape capacity": low & (share("loadCapacity") < 0.5), "scrape images": low & (share("images") < 0.3),
              "rescrape stale": low & (share("stale") > 0.3)}
    one = lambda k, n, p: {"item": F.lit(k), "n": n.cast("long"), "pct": p}
    none = F.lit(None).cast("double")
    largest = top_vendors(df, vendors).select(F.concat(F.lit("vendor: "), F.coalesce("manufacturer", F.lit(""))).alias("item"), "n", none.alias("pct"))
    fixed = lines(row, [one(f, c(f), pct(f, "t")) for f in HEALTH_FIELDS]
                  + [one("total", c("t"), none), one("stale", c("stale"), pct("stale", "t")), one("health", c("health"), none)]
                  + [one(f"advice: {k}", F.coalesce(v, F.lit(False)).cast("long"), none) for k, v in advice.items()])
    return fixed.unionByName(largest)


def inventory_stats(df: DataFrame) -> DataFrame:
    """(section, key, n, pct): vendors, product types, and capacity ranges read from the first integer of any unit."""
    kg = F.when(truthy("loadCapacity"), units.first_integer("loadCapacity"))
    named = {"manufacturer": c("manufacturer"), "capacity": units.capacity_bucket(kg, "tight"), "total": F.lit("rows")}
    if "productType" in df.columns:
        named["productType"] = F.when(truthy("productType"), c("productType"))
    n = pairs(df, named, "section", "key").groupBy("section", "key").agg(F.count("*").alias("n"))
    total = n.filter("section = 'total'").agg(F.max("n")).scalar()
    caps = with_zeros(n.filter("section = 'capacity'"), [("capacity", b.replace(" kg", "kg")) for b in units.CAPACITY_BUCKETS],
                      ["section", "key"]).withColumn("pct", pct("n", total))
    return n.filter("section != 'capacity'").withColumn("pct", F.lit(None).cast("double")).unionByName(caps)


def summary(df: DataFrame) -> DataFrame:
    row = df.groupBy("manufacturer").agg(F.count("*").alias("n"), *[F.count_if(_filled(f)).alias(f) for f in
                                                                    ("images", "pdfs", "loadCapacity", "liftingSpeed")])
    out = row.agg(F.sum("n").alias("total"), F.count("*").alias("manufacturers"), F.sum("images").alias("withImages"),
                  F.sum("pdfs").alias("withPdfs"), F.sum("loadCapacity").alias("withCapacity"), F.sum("liftingSpeed").alias("withSpeed"))
    share = {f"{k}Pct": pct(k, "total") for k in ("withImages", "withPdfs", "withCapacity", "withSpeed")}
    return metrics(out.withColumns(share), {k: c(k) for k in [*out.columns, *share]})


def merged_distributions(df: DataFrame) -> DataFrame:
    """Category, speed type, source and capacity counts of a merged catalogue (a missing capacity counts as 0)."""
    kg = F.coalesce(F.nullif(c("loadCapacityKg"), F.lit(0.0)), F.lit(None)) if "loadCapacityKg" in df.columns else F.lit(None).cast("double")
    cap = F.coalesce(kg, F.when(truthy("loadCapacity"), units.leading_integer("loadCapacity")).otherwise(0.0))
    p = pairs(df, {"category": F.coalesce(F.nullif(c("category"), F.lit("")), F.lit("Unknown")),
                   "speedType": F.coalesce(F.nullif(c("speedType"), F.lit("")), F.lit("Unknown")),
                   "source": F.when(c("source") == "personality", "personality").otherwise("web"),
                   "capacity": units.capacity_bucket(cap)}, "section", "key")
    n = p.groupBy("section", "key").agg(F.count("*").alias("n"))
    fixed = [("capacity", b) for b in units.CAPACITY_BUCKETS] + [("source", "web"), ("source", "personality")]
    zeroed = with_zeros(n.filter(c("section").isin("capacity", "source")), fixed, ["section", "key"])
    return zeroed.unionByName(n.filter(~c("section").isin("capacity", "source")))


def missing_capacity(df: DataFrame) -> DataFrame:
    """Rows without a capacity per vendor, and how many of them have a URL."""
    v = F.coalesce(F.nullif(c("manufacturer"), F.lit("")), F.lit("Unknown"))
    return (df.filter(~truthy("loadCapacity")).groupBy(v.alias("manufacturer"))
            .agg(F.count("*").alias("n"), F.count_if(truthy("url")).alias("with_url")))


def missing_capacity_members(df: DataFrame) -> DataFrame:
    """The rows behind ``missing_capacity`` with vendor rank (largest first), one row per member instead of one list."""
    v = F.coalesce(F.nullif(c("manufacturer"), F.lit("")), F.lit("Unknown"))
    rows = df.filter(~truthy("loadCapacity")).select(v.alias("manufacturer"), "_pos", "id", "model",
                                                     F.when(truthy("url"), "Y").otherwise("N").alias("has_url"),
                                                     F.coalesce(F.size("pdfs"), F.lit(0)).alias("n_pdfs"))
    n = rows.groupBy("manufacturer").agg(F.count("*").alias("group_size"))
    return rows.join(n, "manufacturer")


COVERAGE = ["loadCapacity", "liftingSpeed", "motorPower", "voltageOptions", "classification", "dutyCycle"]


def coverage(df: DataFrame, k: int | None = None) -> DataFrame:
    """(section, key, n): signals, classes, vendors with a capacity (with k the first k of each), from one scan."""
    done = F.coalesce(c("pdfExtracted"), F.lit(False)) if "pdfExtracted" in df.columns else F.lit(False)
    flags = {"total": F.lit(True), **{f: _filled(f) for f in COVERAGE}, "pdfExtracted": done, "missingCapacity": ~truthy("loadCapacity")}
    signals = F.array(*[entry("signals", x, F.coalesce(f, F.lit(False)).cast("int")) for x, f in flags.items()])
    vendor = F.when(truthy("loadCapacity"), F.array(entry("vendors", c("manufacturer"))))
    out = tally(df, [signals, _class_entries("classes"), vendor], [("signals", x) for x in flags]).select("section", "key", "n")
    if k is None:
        return out
    ranked = top_k(out.filter("section <> 'signals'"), ["section"], [c("n").desc(), c("key")], k).drop("rank")
    return out.filter("section = 'signals'").unionByName(ranked)


def doc_coverage(df: DataFrame) -> DataFrame:
    cap, links, local = truthy("loadCapacity"), has_list("pdfs"), has_list("downloadedPDFs")
    done = F.coalesce(c("pdfExtracted"), F.lit(False)) if "pdfExtracted" in df.columns else F.lit(False)
    row = df.agg(F.count_if(cap & local).alias("capacityWithDocs"), F.count_if(links & ~done).alias("linksNotExtracted"),
                 F.count_if(~cap).alias("missingCapacity"), F.count_if(~cap & links).alias("missingWithLinks"),
                 F.count_if(~cap & local).alias("missingDownloaded"), F.count_if(~cap & links & ~local).alias("needDownload"),
                 F.count_if(cap).alias("withCapacity"))
    head = lines(row, [{"section": F.lit("counts"), "key": F.lit(x), "n": c(x)} for x in row.columns])
    vend = df.filter(cap & local).groupBy("manufacturer").agg(F.count("*").alias("n"))
    return head.unionByName(vend.select(F.lit("vendors").alias("section"), c("manufacturer").alias("key"), "n"))


def media_by_vendor(files: DataFrame, df: DataFrame) -> DataFrame:
    """(section, key, n): document files per vendor, total files, products with documents."""
    per = files.groupBy("vendor").agg(F.count("*").alias("n"))
    out = per.select(F.lit("vendor").alias("section"), c("vendor").alias("key"), "n")
    total = per.agg(F.lit("total").alias("section"), F.lit("files").alias("key"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    have = df.agg(F.lit("total").alias("section"), F.lit("productsWithPdfs").alias("key"), F.count_if(has_list("pdfs")).alias("n"))
    return out.unionByName(total).unionByName(have)


def run_stats(runs: DataFrame, keep: int, id: str = "id", start: str = "start", success: str = "success",
              duration: str = "duration") -> DataFrame:
    """Totals over all runs, and over the last ``keep`` runs that the history retains."""
    tot = runs.agg(F.count("*").alias("total"), F.count_if(success).alias("successful"), F.count_if(~c(success)).alias("failed"))
    last = runs.orderBy(c(start).desc(), c(id).desc()).limit(keep).agg(
        F.count("*").alias("kept"), F.count_if(success).alias("keptSuccessful"),
        F.round(F.sum(duration), 4).alias("keptDuration"), F.max_by(id, F.struct(start, id)).cast("double").alias("lastRun"))
    return metrics(tot, {k: c(k) for k in tot.columns}).unionByName(metrics(last, {k: c(k) for k in last.columns}))


def latency_summary(df: DataFrame, by: list[str], value: str, ok: Column, threshold: float = 100.0) -> DataFrame:
    """Min, max, mean, median, p95, p99 (value at index floor(n*p)), success rate and verdict per key.

    Percentiles are exact and found by counting, never by collecting a key: values are counted per (key, value), the counts are
    range-partitioned by key and value, so that a hot key with a long tail is spread evenly, and only the ranges that hold a
    wanted index are looked into.
    """
    from pyspark.sql import Window

    rows = df.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if(ok).alias("n"), F.min(F.when(ok, c(value))).alias("min"),
                               F.max(F.when(ok, c(value))).alias("max"), F.avg(F.when(ok, c(value))).alias("avg"))
    counts = df.filter(ok).groupBy(*by, value).agg(F.count("*").alias("_c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(counts.repartitionByRange(parts, *by, value).withColumn("_b", F.spark_partition_id()))
    sums = placed.groupBy(*by, "_b").agg(F.sum("_c").alias("_s")).join(rows.select(*by, "n"), by)
    w = Window.partitionBy(*by).orderBy("_b")  # at most one row per range and key
    cum = sums.withColumn("_hi", F.sum("_s").over(w)).withColumn("_lo", c("_hi") - c("_s"))
    wants = F.array(*[F.struct(F.lit(q).alias("q"), F.floor(c("n") * p).alias("at"))
                      for q, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))])
    hit = (cum.withColumn("_w", F.explode(wants)).filter((c("_w.at") >= c("_lo")) & (c("_w.at") < c("_hi")))
           .select(*by, "_b", "_lo", c("_w.q").alias("_q"), c("_w.at").alias("_at")))
    inside = placed.join(hit.select(*by, "_b").distinct(), [*by, "_b"], "left_semi")
    wi = Window.partitionBy(*by, "_b").orderBy(value)
    near = inside.withColumn("_run", F.sum("_c").over(wi)).join(hit, [*by, "_b"])
    at = lambda q: F.min(F.when((c("_q") == q) & (c("_lo") + c("_run") > c("_at")), c(value)))
    q = near.groupBy(*by).agg(at("median").alias("median"), at("p95").alias("p95"), at("p99").alias("p99"))
    return rows.join(q, by, "left").select(
        *by, "requests", "n", "min", "max", F.round("avg", 6).alias("avg"), "median", "p95", F.coalesce("p99", "max").alias("p99"),
        F.round(F.try_divide(c("n") * 100.0, c("requests")), 4).alias("success_rate"),
        F.coalesce(c("p95") <= threshold, F.lit(False)).alias("passed"))


def extraction_report(log: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Files per outcome: success, failed, no_match, skipped, with the total."""
    n = log.groupBy("status").agg(F.count("*").alias("n"))
    full = with_zeros(n, [(s,) for s in ("success", "failed", "skipped", "no_match")], ["status"])
    return full.unionByName(log.agg(F.lit("total").alias("status"), F.count("*").alias("n")))


def extraction_status(files: DataFrame, ranked: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Outcome per file: skipped when already done, failed on error, no_match without a product, else success."""
    hit = ranked.select("filename").distinct().withColumn("_hit", F.lit(True))
    out = files.join(hit, "filename", "left")
    if done is not None:
        out = out.join(done.select("filename").distinct().withColumn("_done", F.lit(True)), "filename", "left")
    skipped = F.coalesce(c("_done"), F.lit(False)) if done is not None else F.lit(False)
    return out.withColumn("status", F.when(skipped, "skipped").when(c("error").isNotNull(), "failed")
                          .when(c("_hit").isNull(), "no_match").otherwise("success")).drop("_hit", "_done")


def hot_urls(df: DataFrame, more_than: int = 3) -> DataFrame:
    return (df.filter(truthy("url")).groupBy("url").agg(F.count("*").alias("n")).filter(c("n") > more_than))
