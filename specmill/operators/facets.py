"""Counts and value lists behind the catalogue's facets and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units
from ..functions.text import c, truthy
from ..functions.values import display_presence, has_complete_specs, has_value
from ..schema import TIERS
from .tidy import lines, metrics, pairs, with_zeros


def has_list(name: str):
    return F.coalesce(F.size(name) > 0, F.lit(False))


def vendor_stats(df: DataFrame) -> DataFrame:
    """Rows and distinct models per vendor.

    Counting models after a (vendor, model) pre-aggregation spreads a hot vendor over many tasks.
    """
    per_model = df.groupBy("manufacturer", "model").agg(F.count("*").alias("_n"))
    return (per_model.groupBy("manufacturer").agg(F.sum("_n").alias("count"), F.count(F.when(truthy("model"), 1)).alias("models"))
            .withColumnRenamed("manufacturer", "name"))


def class_stats(df: DataFrame) -> DataFrame:
    return (df.select(F.explode("classification").alias("name")).groupBy("name").agg(F.count("*").alias("count")))


def capacity_range_stats(df: DataFrame) -> DataFrame:
    kg = units.search_capacity("loadCapacity")
    return df.agg(F.coalesce(F.min(kg), F.lit(0.0)).alias("min"), F.coalesce(F.max(kg), F.lit(0.0)).alias("max"))


def presence_flags() -> dict:
    return {
        "loadCapacity": units.search_capacity("loadCapacity").isNotNull(),
        "liftingSpeed": truthy("liftingSpeed"),
        "motorPower": truthy("motorPower"),
        "classification": F.col("classification").isNotNull(),
        "hasImages": has_list("images"),
        "hasCompleteSpecs": has_complete_specs("c"),
    }


def presence_ratios(df: DataFrame) -> DataFrame:
    flags = presence_flags()
    row = df.agg(*[F.coalesce(F.avg(f.cast("double")), F.lit(0.0)).alias(n) for n, f in flags.items()])
    return metrics(row, {n: F.col(n) for n in flags})


def facet_pairs(df: DataFrame) -> DataFrame:
    """(facet, value) of every row, all facets in one pass."""
    known = lambda n: F.when(truthy(n) & (c(n) != "Unknown"), c(n))
    one = pairs(df, {
        "manufacturer": c("manufacturer"), "dutyCycle": F.when(truthy("dutyCycle"), c("dutyCycle")),
        "category": known("category"), "speedType": known("speedType"),
        "tier": F.when(truthy("dataQualityTier"), c("dataQualityTier")).otherwise("minimal")})
    return one.unionByName(df.select(F.lit("classification").alias("facet"), F.explode("classification").alias("value")))


def facet_values(df: DataFrame) -> DataFrame:
    """Distinct values per facet; tiers from best to worst, everything else in binary order."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("value"))
    return facet_pairs(df).distinct().orderBy(
        "facet", F.when(F.col("facet") == "tier", rank).otherwise(0), "value")


def facet_counts(df: DataFrame) -> DataFrame:
    """Rows per tier, capacity bucket and speed bucket, empty buckets included."""
    p = pairs(df, {
        "tier": F.when(truthy("dataQualityTier"), c("dataQualityTier")).otherwise("minimal"),
        "capacity": units.capacity_bucket(units.search_capacity("loadCapacity")),
        "speed": units.speed_bucket(units.search_speed("liftingSpeed"))}, value="bucket")
    keys = ([("tier", t) for t in TIERS] + [("capacity", b) for b in units.CAPACITY_BUCKETS]
            + [("speed", b) for b in units.SPEED_BUCKETS])
    return with_zeros(p.groupBy("facet", "bucket").agg(F.count("*").alias("n")), keys, ["facet", "bucket"])


def index_sizes(df: DataFrame) -> DataFrame:
    """How many distinct keys each lookup would hold. Rows are reduced to one per id first, with a flag per lookup."""
    flags = {"hasImages": has_list("images"), "hasCompleteSpecs": has_complete_specs("c"), "parsedCapacities": truthy("loadCapacity"), "parsedSpeeds": truthy("liftingSpeed")}
    ids = df.filter(c("id").isNotNull()).groupBy("id").agg(*[F.max(F.coalesce(x, F.lit(False))).alias(n) for n, x in flags.items()])
    row = ids.agg(F.count("*").alias("byId"), *[F.count_if(n).alias(n) for n in flags])
    counted = lines(row, [{"index": F.lit(n), "size": c(n)} for n in row.columns])
    values = F.concat(F.array(F.struct(F.lit("byManufacturer").alias("index"), c("manufacturer").alias("key"))),
                      F.transform(F.coalesce("classification", F.array().cast("array<string>")), lambda x: F.struct(F.lit("byClassification").alias("index"), F.lower(x).alias("key"))))
    named = df.select(F.inline(values)).filter("key IS NOT NULL").distinct().groupBy("index").agg(F.count("*").alias("size"))
    return counted.filter("size > 0").unionByName(named)


def db_stats(df: DataFrame) -> DataFrame:
    """Totals, distinct vendors and classes, capacity range, presence ratios and the newest date.

    One scan: each row gives itself, its vendor and its classes; what is counted of the latter are the groups they make.
    """
    kg, flags = units.search_capacity("loadCapacity"), presence_flags()
    own = {"kg": kg, "ms": F.unix_millis(F.col("lastUpdated").cast("timestamp")), **{n: f.cast("int") for n, f in flags.items()}}
    kinds = {n: "double" if n == "kg" else "bigint" if n == "ms" else "int" for n in own}
    shape = "array<struct<kind:string,value:string," + ",".join(f"`{n}`:{t}" for n, t in kinds.items()) + ">>"

    def item(kind: str, value: Column, full: bool = False) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), *[(v if full else F.lit(None)).cast(kinds[n]).alias(n) for n, v in own.items()])

    classes = F.coalesce(F.transform("classification", lambda x: item("classifications", x)).cast(shape), F.array().cast(shape))
    vendor = F.when(F.col("manufacturer").isNotNull(), F.array(item("manufacturers", F.col("manufacturer")))).otherwise(F.array().cast(shape)).cast(shape)
    groups = df.select(F.inline(F.concat(F.array(item("rows", F.lit(""), True)).cast(shape), vendor, classes))).groupBy("kind", "value").agg(
        F.count("*").alias("n"), F.min("kg").alias("lo"), F.max("kg").alias("hi"), F.max("ms").alias("ms"), *[F.avg(n).alias(n) for n in flags])
    mine = lambda n: F.max(F.when(c("kind") == "rows", F.col(n)))
    main = groups.agg(mine("n").alias("totalRecords"), mine("lo").alias("capacityMin"), mine("hi").alias("capacityMax"), mine("ms").alias("lastUpdatedMs"), *[mine(n).alias(n) for n in flags],
                      *[F.count_if(c("kind") == k).alias(k) for k in ("manufacturers", "classifications")])
    names = ["totalRecords", "capacityMin", "capacityMax", "lastUpdatedMs", *flags, "manufacturers", "classifications"]
    return metrics(main, {k: F.coalesce(F.col(k), F.lit(0)) for k in names})


FIELD_FLAGS = ["loadCapacity", "liftingSpeed", "motorPower", "weight", "dimensions", "classification", "images", "pdfs",
               "url"]


def field_completeness(df: DataFrame) -> DataFrame:
    def present(f):
        if f in ("classification", "images", "pdfs"):
            return display_presence(f)
        return truthy(f) & (c(f) != "-") if f == "url" else has_value(f, "d", "text", f)

    row = df.agg(F.count("*").alias("_t"), *[F.count_if(F.coalesce(present(f), F.lit(False))).alias(f) for f in FIELD_FLAGS])
    total = F.greatest(F.col("_t"), F.lit(1))
    return lines(row, [{"field": F.lit(f), "count": F.col(f), "pct": F.round(F.col(f) * 100.0 / total, 1)}
                       for f in FIELD_FLAGS])


def distributions(df: DataFrame) -> DataFrame:
    mpm = F.nullif(F.regexp_extract("liftingSpeed", r"(?i)(\d+(?:\.\d+)?)\s*m/min", 1), F.lit("")).try_cast("double")
    p = pairs(df, {"capacity": units.capacity_bucket(units.search_capacity("loadCapacity")),
                   "power": units.power_bucket("motorPower"), "speed": units.speed_bucket(mpm, "page")}, value="bucket")
    return p.groupBy("facet", "bucket").agg(F.count("*").alias("n"))


def processing_report(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows read, kept and skipped, then vendor, capacity and class distributions."""
    kept = truthy("model") & truthy("manufacturer")
    totals = raw.agg(F.count("*").alias("total"), F.count_if(kept).alias("processed"))
    head = lines(totals, [{"section": F.lit("records"), "key": F.lit(k), "n": v} for k, v in
                          (("total", F.col("total")), ("processed", F.col("processed")),
                           ("skipped", F.col("total") - F.col("processed")))])
    p = pairs(processed, {"manufacturer": c("manufacturer"),
                          "capacity": units.capacity_bucket(units.search_capacity("loadCapacity"))}, "section", "key")
    p = p.unionByName(processed.select(F.lit("classification").alias("section"), F.explode("classification").alias("key")))
    return head.unionByName(p.groupBy("section", "key").agg(F.count("*").alias("n")))


def home_facets(df: DataFrame, vendors: int = 5, classes: int = 6) -> DataFrame:
    """First vendors by name and top classes by count; the rest summed up as one line each."""
    def head(counts, order, k, kind):
        # the ranked head is k rows, so joining it back marks the rest without a global window
        top = counts.orderBy(*order).limit(k)
        rest = counts.join(F.broadcast(top.select("name")), "name", "left_anti").agg(
            F.lit(kind).alias("facet"), F.lit("(others)").alias("name"), F.count("*").alias("count"))
        return top.select(F.lit(kind).alias("facet"), "name", "count").unionByName(rest)

    v = vendor_stats(df).select("name", "count")
    return head(v, [F.collate(F.col("name"), "UNICODE")], vendors, "manufacturer").unionByName(
        head(class_stats(df), [F.col("count").desc(), F.col("name")], classes, "classification"))
