"""Names, slugs, ids and file names: how records are keyed and recognised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .text import NUM, WS, any_of, c, extract, js_trim, lookup, number

# fixed values: vendor slug in image file names -> vendor name
VENDOR_SLUGS = {
    "abus-kransysteme": "ABUS Kransysteme",
    "budgit": "Budgit Hoists",
    "chainmaster": "Chainmaster",
    "coffing": "Coffing Hoists",
    "demag": "Demag",
    "donati": "Donati Sollevamenti",
    "elephant": "Elephant Lifting Products",
    "gorbel": "Gorbel",
    "hitachi": "Hitachi",
    "jdn": "J.D. Neuhaus",
    "kito": "Kito",
    "liftingsafety": "LiftingSafety",
    "planeta": "PLANETA-Hebetechnik",
    "rm-materials": "R&M Materials Handling",
    "stahl": "Stahl CraneSystems",
    "street-crane": "Street Crane",
    "swf": "SWF Krantechnik",
    "swf-krantechnik": "SWF Krantechnik",
    "tiger": "Tiger Lifting",
    "tiger-lifting": "Tiger Lifting",
    "txk": "TXK",
    "yale": "Yale Hoists",
}

# fixed values: vendors of the entertainment industry
ENTERTAINMENT = [
    "Lodestar", "Liftket", "Kinesys", "Prolyft", "EXE", "Chainmaster", "GIS", "Movecat", "WiMotion",
    "Atlanta Rigging Systems", "Prostar", "Varistar", "LoadGuard", "Evo", "Summit Steel", "Flying by Foy",
]


def slug(x, mode: str = "strip", max_len: int | None = None) -> Column:
    """strip: runs become '-', ends stripped; runs: ends kept; chars: one '-' per character;
    joined: runs of '-' collapsed after the caller joined its parts with '--'."""
    x = F.lower(c(x))
    if mode == "strip":
        out = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    elif mode == "runs":
        out = F.regexp_replace(x, "[^a-z0-9]+", "-")
    elif mode == "chars":
        out = F.regexp_replace(x, "[^a-z0-9]", "-")
    elif mode == "joined":
        out = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]", "-"), "-+", "-")
    else:
        raise ValueError(f"unknown slug mode {mode}")
    return F.substring(out, 1, max_len) if max_len else out


def vendor_model_id(manufacturer="manufacturer", model="model", mode: str = "chars") -> Column:
    return slug(F.concat(F.coalesce(c(manufacturer), F.lit("unknown")), F.lit("--"),
                         F.coalesce(c(model), F.lit("unknown"))), mode)


def numbered(df: DataFrame, key: str, out: str, pos: str = "_pos") -> DataFrame:
    """0-based number of each row among the rows with the same key, in position order.

    Rows are cut into position ranges first and numbered per (range, key); the counts of the ranges before are added
    afterwards. A key that owns a third of the rows is thus spread over all ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = cut(df.repartitionByRange(n, pos).withColumn("_part", F.spark_partition_id()))
    local = split.withColumn("_rn", F.row_number().over(Window.partitionBy("_part", key).orderBy(pos)) - 1)
    sizes = split.groupBy(key, "_part").agg(F.count("*").alias("_c"))  # at most one row per range and key
    before = F.sum("_c").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(key, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (local.join(sizes, [key, "_part"]).withColumn(out, F.col("_rn") + F.col("_before"))
            .drop("_part", "_rn", "_before"))


def unique_id(df: DataFrame, base: str, out: str = "unique_id", pos: str = "_pos") -> DataFrame:
    """base, then base-1, base-2 ... for its further rows in arrival order; ``base`` must not be NULL.

    The first row of a base keeps it. A further row takes the next counter whose id is no other row's base, so the result is
    unique. Which counters a base must pass over comes from the bases that end in a number; only those are looked up.
    """
    n = numbered(df, base, "_n", pos)
    parts = F.regexp_extract(F.col(base), r"(?s)^(.*)-([1-9][0-9]*)$", 1), F.regexp_extract(F.col(base), r"(?s)^(.*)-([1-9][0-9]*)$", 2).try_cast("bigint")
    taken = df.select(parts[0].alias("_of"), parts[1].alias("_t")).filter("_t IS NOT NULL").distinct()
    # the m-th free counter lies beyond the taken t_j (j from 0) exactly when t_j - j <= m
    steps = taken.groupBy("_of").agg(F.array_sort(F.collect_list("_t")).alias("_ts")).select("_of", F.transform("_ts", lambda t, j: t - j).alias("_steps"))
    more = n.filter("_n > 0").join(steps, F.col(base) == F.col("_of"), "left")
    passed = F.coalesce(F.size(F.filter("_steps", lambda t: t <= F.col("_n"))), F.lit(0))
    again = more.withColumn(out, F.concat_ws("-", base, F.col("_n") + passed)).drop("_of", "_steps")
    return n.filter("_n = 0").withColumn(out, F.col(base)).unionByName(again).drop("_n")


def dedupe_key(manufacturer="manufacturer", model="model", mode: str = "fixed") -> Column:
    """``vendor:model`` key. ``fixed`` works on white space; ``compat`` on runs of the letter *s*, where only the
    word ``model`` can ever be removed."""
    m = F.lower(js_trim(F.coalesce(c(manufacturer), F.lit(""))))
    t = F.lower(js_trim(F.coalesce(c(model), F.lit(""))))
    gap, dash, runs = (("s+", "s*-s*", "s+") if mode == "compat"
                       else (f"{WS}+", f"{WS}*-{WS}*", f"{WS}+"))
    t = F.aggregate(F.split(m, gap), t,
                    lambda acc, w: F.when(acc.startswith(w), js_trim(F.substr(acc, F.length(w) + 1))).otherwise(acc))
    t = F.regexp_replace(F.regexp_replace(t, dash, "-"), runs, " ")
    for word in ("electric chain hoist", "chain hoist", "hoist", "series", "model"):
        t = F.regexp_replace(t, word, "")
    return F.concat(m, F.lit(":"), js_trim(t))


def device_numbers(name, mode: str = "compat") -> dict[str, Column]:
    """Load and speed written in a device name. ``compat`` keeps mm/s figures unconverted; ``fixed`` converts."""
    kg = number(name, f"(?i){NUM}{WS}*kg")
    m = number(name, f"(?i){NUM}{WS}*m/?(?:min|pm)")
    mm = number(name, f"(?i){NUM}{WS}*mm/?(?:s|ps)")
    if mode == "fixed":
        mm = F.round(mm * 60 / 1000, 6)
    return {"loadCapacityKg": kg, "liftingSpeedMpm": F.coalesce(m, mm),
            "liftingSpeedFpm": number(name, f"(?i){NUM}{WS}*fpm")}


def num_or_null(x) -> Column:
    """Numeric prefix; 0 and unparsable become NULL."""
    v = number(x, f"^{WS}*" + r"([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)")
    return F.nullif(v, F.lit(0.0))


def model_from_name(name) -> Column:
    t = F.regexp_replace(c(name), rf"^\[\d+-\d+\]{WS}*", "")
    t = js_trim(F.regexp_replace(t, rf"(?is)\d+(?:\.\d+)?{WS}*kg.*$", ""))
    t = F.regexp_replace(t, rf"{WS}*-{WS}*\[.*\]$", "")
    return js_trim(F.regexp_replace(t, f"{WS}+", " "))


def search_query(name, manufacturer, suffix: str = "electric chain hoist specifications") -> Column:
    return F.concat_ws(" ", c(manufacturer), model_from_name(name), F.lit(suffix))


def device_category(name, model) -> Column:
    n, m = F.lower(F.coalesce(c(name), F.lit(""))), F.lower(F.coalesce(c(model), F.lit("")))
    return (F.when(n.contains("trolley") | m.contains("trolley"), "Beam Trolley")
            .when(n.contains("winch") | m.contains("winch"), "Winch")
            .when(n.contains("revolve") | n.contains("turntable") | n.contains("rotator"), "Revolve/Turntable")
            .when(n.contains("fly"), "Flying System")
            .otherwise("Electric Chain Hoist"))


def speed_type(name, lo, hi) -> Column:
    n = F.lower(F.coalesce(c(name), F.lit("")))
    return (F.when(n.contains("varispeed") | n.contains("variable") | n.contains("varistar"), "Variable Speed")
            .when(n.contains("fixed speed") | n.contains("fixspeed"), "Fixed Speed")
            .when(c(lo).isNotNull() & c(hi).isNotNull() & (c(lo) != c(hi)), "Variable Speed")
            .otherwise("Unknown"))


def is_entertainment(manufacturer, names=tuple(ENTERTAINMENT)) -> Column:
    low = F.lower(F.coalesce(c(manufacturer), F.lit("")))
    return any_of([low.contains(n.lower()) for n in names])


def _cap(x) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))


def parse_media_name(name, mode: str = "typed") -> Column:
    """Struct(vendor, product, type, index) read from a media file name.

    typed: ``vendor_product_type_index``, at least three parts, product keeps inner '_'; titled: positional with
    defaults, vendor capitalised; plain: positional, '-' becomes a blank; image: ``vendor_page_N.ext`` with the
    vendor slug dictionary; id: vendor and product joined by '-'. An index beyond 64 bits is NULL.
    """
    f = c(name)
    struct = lambda v, p, t, i: F.struct(v.alias("vendor"), p.alias("product"), t.alias("type"), i.alias("index"))
    none = F.lit(None).cast("string")
    no_int = F.lit(None).cast("bigint")
    if mode == "image":
        pat = r"^([^_]+)_([^_]+)_(\d+)\.(\w+)$"
        vendor = lookup(F.regexp_extract(f, pat, 1), VENDOR_SLUGS)
        return F.when(vendor.isNotNull(), struct(vendor, extract(f, pat, 2), F.lower(extract(f, pat, 4)),
                                                 extract(f, pat, 3).try_cast("bigint")))
    parts = F.split(F.regexp_replace(f, r"\.pdf$", ""), "_")
    n = F.size(parts)
    at = lambda i: F.try_element_at(parts, F.lit(i))
    blanked = lambda x: F.replace(x, F.lit("-"), F.lit(" "))
    if mode == "typed":
        return F.when(n >= 3, struct(at(1), F.array_join(F.slice(parts, 2, F.greatest(n - 3, F.lit(0))), "_"),
                                     at(-2), F.regexp_extract(at(-1), r"^(\d+)", 1).try_cast("bigint")))
    if mode == "titled":
        return F.when(n >= 2, struct(_cap(blanked(at(1))), blanked(at(2)), F.coalesce(F.nullif(at(3), F.lit("")), F.lit("document")),
                                     F.regexp_extract(F.coalesce(at(4), F.lit("0")), r"^(\d+)", 1).try_cast("bigint"))
                      ).otherwise(struct(F.lit("Unknown"), at(1), F.lit("document"), F.lit(0).cast("bigint")))
    if mode == "plain":
        return struct(blanked(at(1)), blanked(at(2)), at(3), F.regexp_extract(at(4), r"^(\d+)", 1).try_cast("bigint"))
    if mode == "id":
        return F.when(n >= 2, struct(at(1), F.concat_ws("-", at(1), at(2)), none, no_int))
    raise ValueError(f"unknown media name mode {mode}")


def match_key(x) -> Column:
    """Vendor key for matching: letters and digits only, company suffixes dropped wherever they occur."""
    k = F.regexp_replace(F.lower(F.coalesce(c(x), F.lit(""))), "[^a-z0-9]", "")
    return F.regexp_replace(k, "gmbh|ag|ltd|inc|llc|corp", "")


def match_confidence(manufacturer, model, file_vendor, file_slug, extracted_model) -> Column:
    one = lambda cond, w: F.when(F.coalesce(cond, F.lit(False)), w).otherwise(0.0)
    low = lambda x: F.lower(c(x))
    s = (F.lit(0.5) + one(low(manufacturer) == low(file_vendor), 0.2) + one(low(file_slug).contains(low(model)), 0.2)
         + one((c(extracted_model) != "") & low(model).contains(low(extracted_model)), 0.1))
    return F.least(F.round(s, 6), F.lit(1.0))
