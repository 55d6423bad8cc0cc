"""Filtering, sorting, paging, navigation, suggestions and lookups over a processed catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units
from ..functions.text import c, has, truthy
from ..functions.values import has_complete_specs
from ..schema import TIERS
from ..session import cut
from .tidy import limited, top_k

TEXT_SEARCH = ["manufacturer", "model", "series", "loadCapacity"]


#: Search values that a table may hold as columns, so that filters on them reach its files.
SEARCH_COLUMNS = {
    "_kg": lambda: units.search_capacity("loadCapacity"), "_speed": lambda: units.search_speed("liftingSpeed"),
    "_bucket": lambda: units.capacity_bucket(units.search_capacity("loadCapacity")),
    **{f"_{n}": lambda n=n: F.lower(n) for n in ("manufacturer", "model", "series", "loadCapacity", "name", "category", "speedType")},
}


def with_search_columns(df: DataFrame) -> DataFrame:
    """The catalogue with its search numbers, buckets and lower-case texts, for storing. Filters use them where they are there."""
    made = {n: f() for n, f in SEARCH_COLUMNS.items() if n.lstrip("_") in df.columns or n in ("_kg", "_bucket", "_speed")}
    return df.withColumns(made)


def _value(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else SEARCH_COLUMNS[name]()


def _and(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _class_is(value: str, fold: bool = False) -> Column:
    if fold:
        return F.coalesce(F.exists("classification", lambda x: F.lower(x) == value.lower()), F.lit(False))
    return F.coalesce(F.array_contains("classification", value), F.lit(False))


def filter_catalog(df: DataFrame, manufacturer=None, model=None, classification=None, min_capacity=None,
                   max_capacity=None) -> DataFrame:
    """Case-insensitive substring filters plus an inclusive capacity range (rows without a capacity fail it)."""
    for n, v in (("manufacturer", manufacturer), ("model", model)):
        if v:
            df = df.filter(_value(df, f"_{n}").contains(v.lower()))  # NULL fails, and the test can reach the files
    conds = []
    if classification:
        conds.append(F.coalesce(F.exists("classification", lambda x: F.lower(x).contains(classification.lower())),
                                F.lit(False)))
    out = df.filter(_and(conds))
    return capacity_range(out, min_capacity, max_capacity) if (min_capacity, max_capacity) != (None, None) else out


def text_search(df: DataFrame, q: str | None) -> DataFrame:
    return df.filter(text_match(q)) if q else df


def text_match(q: str) -> Column:
    cols = [has(n, q) for n in TEXT_SEARCH] + [has(F.array_join("classification", " "), q)]
    return reduce(lambda a, b: a | b, cols)


def capacity_range(df: DataFrame, lo=None, hi=None) -> DataFrame:
    """Inclusive range with optional ends; a row without a capacity fails (a comparison with NULL is not true)."""
    kg = _value(df, "_kg")
    if lo is not None and hi is not None:
        return df.filter(kg.between(lo, hi))
    if lo is not None:
        return df.filter(kg >= lo)
    return df.filter(kg <= hi if hi is not None else kg.isNotNull())


def vendors_in(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(F.col("manufacturer").isin(*names))


def any_class(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(any_of("classification", names))


def any_of(col, values: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(c(col), F.array(*[F.lit(v) for v in values])), F.lit(False))


def facet_filter(df: DataFrame, q=None, manufacturer=None, capacity=None, classification=None, category=None,
                 speedType=None, dutyCycle=None, dataQuality=None, compat: bool = False) -> DataFrame:
    """Conjunction of exact facets. ``compat`` keeps the two special cases of single-facet access: a lone class
    facet ignores case, and a lone tier facet counts rows without a tier as minimal."""
    conds = []
    tier = dataQuality[5:] if dataQuality and dataQuality.startswith("tier-") else None
    only = lambda mine: compat and not any(v for v in (q, manufacturer, capacity, classification, tier) if v is not mine)
    if q:
        conds.append(text_match(q))
    for name, v in (("manufacturer", manufacturer), ("category", category), ("speedType", speedType),
                    ("dutyCycle", dutyCycle)):
        if v:
            conds.append(F.col(name) == v)
    if capacity:
        df = df.filter(_value(df, "_bucket") == capacity)
    if classification:
        conds.append(_class_is(classification, fold=only(classification)))
    if dataQuality == "complete":
        conds.append(has_complete_specs("c"))
    elif dataQuality == "hasImages":
        conds.append(F.coalesce(F.size("images") > 0, F.lit(False)))
    elif tier:
        t = F.col("dataQualityTier")
        conds.append((F.when(truthy(t), t).otherwise("minimal") if only(tier) else t) == tier)
    return df.filter(_and(conds))


def facet_count(df: DataFrame, **facets) -> DataFrame:
    return facet_filter(df, **facets).agg(F.count("*").alias("count"))


def device_filter(df: DataFrame, manufacturer=None, category=None, speedType=None, entertainment_only=False) -> DataFrame:
    conds = [has("manufacturer", manufacturer)] if manufacturer else []
    conds += [F.lower(n) == v.lower() for n, v in (("category", category), ("speedType", speedType)) if v]
    if entertainment_only:
        conds.append(F.col("entertainmentIndustry"))
    return df.filter(_and(conds))


def device_page_filter(df: DataFrame, manufacturer=None, category=None, speedType=None, q=None) -> DataFrame:
    conds = [F.col(n) == v for n, v in (("manufacturer", manufacturer), ("category", category),
                                        ("speedType", speedType)) if v]
    if q:
        conds.append(has("name", q) | has("manufacturer", q) | has("model", q))
    return df.filter(_and(conds))


def export_filter(df: DataFrame, manufacturer=None, classification=None) -> DataFrame:
    conds = [has("manufacturer", manufacturer)] if manufacturer else []
    if classification:
        conds.append(_class_is(classification.lower()))
    return df.filter(_and(conds))


def by_tier(df: DataFrame, tier: str) -> DataFrame:
    tier = tier.lower()
    if tier not in TIERS:
        raise ValueError(f"Invalid tier. Valid values: {', '.join(TIERS)}")
    t = F.col("dataQualityTier")
    return df.filter(F.when(truthy(t), t).otherwise("minimal") == tier)


def by_capacity_bucket(df: DataFrame, bucket: str) -> DataFrame:
    if bucket not in units.CAPACITY_BUCKETS:
        raise ValueError(f"Invalid bucket. Valid values: {', '.join(units.CAPACITY_BUCKETS)}")
    return df.filter(_value(df, "_bucket") == bucket)


def sort_key(by: str, collate: bool = False) -> Column:
    """Key of a search sort: parsed numbers (missing 0), class list joined, other text with '' for missing."""
    if by in ("loadCapacity", "capacity") and not (collate and by == "loadCapacity"):
        return F.coalesce(units.search_capacity("loadCapacity"), F.lit(0.0))
    if by in ("liftingSpeed", "speed") and not (collate and by == "liftingSpeed"):
        return F.coalesce(units.search_speed("liftingSpeed"), F.lit(0.0))
    if by in ("dataCompleteness", "capacityKg", "speedMMin", "confidence"):
        return F.coalesce(F.col(by).cast("double"), F.lit(0.0))
    if by == "classification":
        text = F.coalesce(F.array_join("classification", " "), F.lit(""))
    else:
        text = F.coalesce(F.col(by).cast("string"), F.lit(""))
    return F.collate(text, "UNICODE") if collate else text


def sort_order(by: str | None, order: str = "asc", collate: bool = False, pos: str = "_pos") -> list[Column]:
    """Stable order: the requested key, then input position."""
    if not by:
        return [F.col(pos).asc()]
    k = sort_key(by, collate)
    return [k.desc() if order == "desc" else k.asc(), F.col(pos).asc()]


def sort_catalog(df: DataFrame, by: str | None, order: str = "asc", collate: bool = False) -> DataFrame:
    return df.orderBy(*sort_order(by, order, collate))


def page_args(page, limit, default_limit: int) -> tuple[int, int]:
    return int(page or 0) or 1, int(limit or 0) or default_limit


def paginate(df: DataFrame, page=1, limit=50, by: str | None = None, order: str = "asc", collate: bool = False,
             default_limit: int = 50, mode: str = "compat", after: tuple | None = None) -> DataFrame:
    """One page of the sorted result. Page or limit 0 fall back to 1 and the default; in ``compat`` a negative page counts from the
    end, in ``strict`` it is rejected.

    The first page is a top-k of ``limit`` rows, and so is any page given by ``after``: the (sort key, position) of the row before
    it, or just the position without ``by``. Of other page numbers the first and last row are found first, by counting keys
    (``page_bounds``); the page is then a filter on the rows. Neither shuffles the rows. Positions must be unique.
    """
    page, limit = page_args(page, limit, default_limit)
    if mode == "strict" and (page < 1 or limit < 1):
        raise ValueError("page and limit must be positive")
    if limit < 0:
        raise ValueError("limit must not be negative")
    sorting = sort_order(by, order, collate)
    if after is not None:
        k, pos = after if by else (0, after[-1] if isinstance(after, (tuple, list)) else after)
        key = sort_key(by, collate) if by else F.lit(0)
        return df.filter(_beyond(key, (k, pos), order == "desc")).orderBy(*sorting).limit(limit)
    if page == 1:
        return df.orderBy(*sorting).limit(limit)
    key, desc = sort_key(by, collate) if by else F.lit(0), order == "desc"
    skip = (page - 1) * limit if page > 0 else -page * limit
    first = nth_key(df.select(key.alias("_k"), "_pos"), skip, desc, back=page < 0) if limit else None
    if first is None:
        return df.filter(F.lit(False))
    rows = df.filter(_beyond(key, first, desc, back=page < 0) | (key == F.lit(first[0])) & (F.col("_pos") == first[1]))
    if page < 0:
        rows = rows.orderBy(*(_page_order(key, desc, back=True) if by else [F.col("_pos").desc()])).limit(limit)
    return rows.orderBy(*sorting).limit(limit)


def _page_order(key: Column, desc: bool, back: bool = False) -> list[Column]:
    return [key.desc() if desc != back else key.asc(), F.col("_pos").desc() if back else F.col("_pos").asc()]


def _beyond(key: Column, place: tuple, desc: bool, back: bool = False) -> Column:
    """Rows after the (key, position) ``place`` in the order of a page, or with ``back`` before it."""
    k = F.lit(place[0])
    further = key < k if desc != back else key > k
    return further | (key == k) & (F.col("_pos") < place[1] if back else F.col("_pos") > place[1])


#: Keys that a task may sort to skip them, and keys that are drawn to narrow the search for a place.
TOP, DRAWN = 10_000, 10_000


def nth_key(keys: DataFrame, skip: int, desc: bool = False, back: bool = False) -> tuple | None:
    """(key, position) of the row after ``skip`` ones in order, or None. ``keys`` has ``_k`` and ``_pos``.

    While more than TOP rows are to be skipped, a place a little before the wanted one is drawn, or a little after it if that lies near the
    beginning, and the rows up to there are counted: what is left to search shrinks to a few hundredths each time. Which
    places are drawn does not matter for the result. Only counts and the first TOP keys leave a task, and no row is shuffled.
    """
    order = _page_order(F.col("_k"), desc, back)
    n = None if skip <= TOP else keys.count()
    turn = 0
    while skip > TOP:
        if skip >= n:
            return None
        share = min(1.0, DRAWN / n)
        chosen = F.pmod(F.xxhash64("_pos", F.lit(turn)), F.lit(1 << 30)) < int(share * (1 << 30))
        drawn = keys.filter(chosen).orderBy(*order).limit(4 * DRAWN).collect()
        turn += 1
        guess, spread = skip / n * len(drawn), 3 * len(drawn) ** 0.5 + 1
        at = int(guess - spread)
        low = at >= 0
        if not low and (at := int(guess + spread)) >= len(drawn):
            break
        place = (drawn[at]["_k"], drawn[at]["_pos"])
        further = _beyond(F.col("_k"), place, desc, back)
        upto = n - keys.filter(further).count()
        if low and upto <= skip:
            keys, n, skip = keys.filter(further), n - upto, skip - upto
        elif not low and upto > skip:
            keys, n = keys.filter(~further), upto
    found = keys.orderBy(*order).offset(skip).limit(1).collect()
    return (found[0]["_k"], found[0]["_pos"]) if found else None


def page_info(df: DataFrame, page=1, limit=50, default_limit: int = 50) -> DataFrame:
    page, limit = page_args(page, limit, default_limit)
    n = df.agg(F.count("*").alias("total"))
    return n.select("total", F.lit(page).alias("page"), F.lit(limit).alias("limit"),
                    F.ceil(F.col("total") / limit).cast("long").alias("pages")).withColumns({
                        "has_next": F.lit(page) < F.col("pages"), "has_prev": F.lit(page > 1)})


def navigate(df: DataFrame, id: str, by: str | None = None, order: str = "asc", collate: bool = False) -> DataFrame:
    """Previous, next, position and total for one item of a filtered result.

    One pass: rows are compared with the item's own sort key, so nothing is sorted. An item outside the result has
    position 1, no previous, and the first row as next.
    """
    rows = df.select("id", "_pos", (sort_key(by, collate) if by else F.lit(0)).alias("_k"))
    me = rows.filter(F.col("id") == id).agg(F.min_by(F.struct("_k", "_pos"), "_pos")).scalar()
    r = rows.withColumn("_me", me)
    me_k, me_p = F.col("_me._k"), F.col("_me._pos")
    ahead_k = F.col("_k") > me_k if order == "desc" else F.col("_k") < me_k
    before = ahead_k | ((F.col("_k") == me_k) & (F.col("_pos") < me_p))
    after = F.coalesce(~before & (F.col("_pos") != me_p), F.lit(True))
    before = F.coalesce(before, F.lit(False))
    key = F.struct("_k", "_pos") if order != "desc" else None
    if key is not None:
        prev, nxt = F.max_by(F.when(before, F.col("id")), F.when(before, key)), \
            F.min_by(F.when(after, F.col("id")), F.when(after, key))
    else:  # descending key, ascending position
        neg = F.struct("_k", (-F.col("_pos")).alias("_n"))
        prev, nxt = F.min_by(F.when(before, F.col("id")), F.when(before, neg)), \
            F.max_by(F.when(after, F.col("id")), F.when(after, neg))
    return r.agg(prev.alias("prev_id"), nxt.alias("next_id"),
                 (F.count_if(before) + 1).alias("position"), F.count("*").alias("total"))


def ranked(df: DataFrame, order: list[Column], rn: str = "position") -> DataFrame:
    """Global row numbers without a single-task window.

    Rows are range-partitioned by the order, numbered inside each partition, and shifted by the sizes of the
    partitions before; that size table has one row per partition. The ranges are checkpointed so that every reader
    sees the same split.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy(*order)
    local = split.withColumn("_rn", F.row_number().over(w))
    sizes = split.groupBy("_part").agg(F.count("*").alias("_n"))
    # bounded: at most one row per shuffle partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1))).alias("_before"))
    return (local.join(F.broadcast(before), "_part")
            .withColumn(rn, (F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_rn", "_before"))


def navigate_all(df: DataFrame, by: str | None = None, order: str = "asc") -> DataFrame:
    """Batch navigation: id, position, prev_id, next_id for every row of the result."""
    keyed = df.select("id", "_pos", (sort_key(by) if by else F.lit(0)).alias("_k"))
    o = [F.col("_k").desc() if order == "desc" else F.col("_k").asc(), F.col("_pos").asc()]
    r = ranked(keyed, o)
    w = Window.partitionBy("_part").orderBy("position")
    edges = r.groupBy("_part").agg(F.min_by("id", "position").alias("_first"), F.max_by("id", "position").alias("_last"))
    we = Window.orderBy("_part")  # bounded: one row per shuffle partition
    edges = edges.select("_part", F.lag("_last").over(we).alias("_prev"), F.lead("_first").over(we).alias("_next"))
    return (r.withColumns({"prev_id": F.lag("id").over(w), "next_id": F.lead("id").over(w)})
            .join(F.broadcast(edges), "_part")
            .select("id", "position", F.coalesce("prev_id", "_prev").alias("prev_id"),
                    F.coalesce("next_id", "_next").alias("next_id")))


def suggest(df: DataFrame, q: str, limit: int | None = None, max_models: int | None = None) -> DataFrame:
    """Completions: vendors, classes and distinct models, in that order; all of them unless the caller sets limits."""
    q = (q or "").lower().strip()
    schema = "type string, value string, label string, count long, type_rank int"
    if len(q) < 2:
        return df.sparkSession.createDataFrame([], schema).drop("type_rank")
    line = lambda kind, value, label, count, rank: [F.lit(kind).alias("type"), value.alias("value"),
                                                    label.alias("label"), count.alias("count"), F.lit(rank).alias("type_rank")]
    col = F.col
    vendors = (df.filter(has("manufacturer", q)).groupBy("manufacturer").agg(F.count("*").alias("n"))
               .select(*line("manufacturer", col("manufacturer"), col("manufacturer"), col("n"), 0)))
    cls = df.select(F.explode("classification").alias("cls")).filter(has("cls", q))
    per = cls.groupBy("cls").agg(F.count("*").alias("n"))
    classes = (per.withColumn("n", F.sum("n").over(Window.partitionBy(F.lower("cls"))))
               .select(*line("classification", col("cls"), F.upper("cls"), col("n"), 1)))
    models = (limited(df.filter(has("model", q) | has("series", q)).groupBy("manufacturer", "model")
                      .agg(F.min_by("id", "_pos").alias("id"), F.min("_pos").alias("_pos")).orderBy("_pos"), max_models)
              .select(*line("product", col("id"), F.concat_ws(" ", "manufacturer", "model"),
                            F.lit(None).cast("long"), 2)))
    both = vendors.unionByName(classes).unionByName(models)
    tie = F.when(col("type_rank") == 2, F.lit(None).cast("string")).otherwise(col("value"))
    return limited(both.orderBy("type_rank", F.col("count").desc(), tie, F.collate(col("label"), "UNICODE")), limit).drop("type_rank")


def get(df: DataFrame, id: str) -> DataFrame:
    """Row by id; the last one when an id repeats. Empty result when unknown."""
    return df.filter(F.col("id") == id).orderBy(F.col("_pos").desc()).limit(1)


def get_device(df: DataFrame, manufacturer_id: str, product_id: str) -> DataFrame:
    return (df.filter((F.col("manufacturerId") == manufacturer_id) & (F.col("productId") == product_id))
            .orderBy("_pos").limit(1))


def compare(df: DataFrame, ids: list[str]) -> DataFrame:
    """Requested ids in request order (unknown ones dropped)."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids, 1)), "request_pos int, id string")
    hits = df.filter(F.col("id").isin(*ids)) if ids else df.limit(0)
    last = hits.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("_pos").desc())))
    return F.broadcast(wanted).join(last.filter("_r = 1").drop("_r"), "id").orderBy("request_pos")


def compare_table(df: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """Transposed comparison: one line per field, one column per item."""
    c = compare(df, ids)
    long = c.select("request_pos", F.inline(F.array(*[
        F.struct(F.lit(i).alias("field_pos"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
        for i, f in enumerate(fields)])))
    return (long.groupBy("field_pos", "field").pivot("request_pos", list(range(1, len(ids) + 1)))
            .agg(F.first("value")).orderBy("field_pos"))


def similar(df: DataFrame, id: str, k: int = 5) -> DataFrame:
    """First k other items of the same vendor."""
    vendor = df.filter(F.col("id") == id).agg(F.max_by("manufacturer", "_pos")).scalar()
    return df.filter((F.col("manufacturer") == vendor) & (F.col("id") != id)).orderBy("_pos").limit(k)


def similar_all(df: DataFrame, k: int = 5) -> DataFrame:
    """First k other items of the same vendor, for every item at once: (id, rank, similar_id).

    Any item's list comes out of its vendor's first k+1 rows, so only those are kept per vendor and joined back.
    """
    head = top_k(df.select("manufacturer", "id", "_pos"), ["manufacturer"], [F.col("_pos")], k + 1, "_r")
    heads = head.groupBy("manufacturer").agg(F.array_sort(F.collect_list(F.struct("_r", "id"))).alias("_h"))
    rest = F.slice(F.filter("_h", lambda x: x["id"] != F.col("id")), 1, k)
    return (df.select("id", "manufacturer").join(heads, "manufacturer")
            .select("id", F.posexplode(rest).alias("_i", "_s"))
            .select("id", (F.col("_i") + 1).alias("rank"), F.col("_s.id").alias("similar_id")))


def similar_devices(df: DataFrame, k: int = 5) -> DataFrame:
    """Devices with the same vendor name but another vendor id, first k per (vendor, vendor id)."""
    head = top_k(df.select("manufacturer", "manufacturerId", "productId", "_pos"), ["manufacturer", "manufacturerId"],
                 [F.col("_pos")], k, "_r")
    heads = head.groupBy("manufacturer").agg(
        F.array_sort(F.collect_list(F.struct("_pos", "manufacturerId", "productId"))).alias("_h"))
    ids = df.select("manufacturer", "manufacturerId").distinct().join(heads, "manufacturer")
    other = F.slice(F.filter("_h", lambda x: x["manufacturerId"] != F.col("manufacturerId")), 1, k)
    return (ids.select("manufacturer", "manufacturerId", F.posexplode(other).alias("_i", "_s"))
            .select("manufacturer", "manufacturerId", (F.col("_i") + 1).alias("rank"),
                    F.concat_ws("-", "_s.manufacturerId", "_s.productId").alias("similar_id")))


def order_media(df: DataFrame, slug: str = "page", index: str = "index") -> DataFrame:
    return df.orderBy(F.collate(F.col(slug), "UNICODE"), index)
