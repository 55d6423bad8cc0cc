"""Record processing, duplicates, merges and set operations."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions.names import dedupe_key, unique_id
from ..functions.text import c
from ..operators import dedupe, merge, rules
from ..operators.normalize import process_catalog
from ..operators.search import SEARCH_COLUMNS, with_search_columns
from ..session import source_key, stored
from ..sources import seeds, writers
from . import inputs
from .oracle import cat, raw
from .registry import query


def process(spark, sf):
    return process_catalog(inputs.raw_catalog(spark, sf))


def catalog(spark, sf):
    """The processed catalogue. It is the table all later queries work on, so it is written once and then scanned with
    pushed filters and pruned columns; sorting by vendor inside each file makes the row-group statistics useful."""
    return search_catalog(spark, sf).drop(*SEARCH_COLUMNS)


def search_catalog(spark, sf):
    """The stored catalogue with the columns that searches filter on."""
    made_from = source_key(*(inputs.table(spark, sf, t) for t in ("part", "lineitem")))
    name = "catalog-" + hashlib.sha1(f"{sf} {made_from}".encode()).hexdigest()[:12]
    return stored(spark, name, lambda: with_search_columns(process(spark, sf)).sortWithinPartitions("manufacturer", "_pos"))


FLAT = """_pos, id, manufacturer, model, series, loadCapacity, liftingSpeed, motorPower, array_to_string(cls, '|') AS classes,
  quietOperation, capacityKg, speedMMin, dataCompleteness, hasCompleteSpecs, source, sourceUrl, dataQualityTier"""


@query("f01_process_catalog", cat(f"SELECT {FLAT} FROM catalog"))
def f01(spark, sf):
    return process(spark, sf).select(
        "_pos", "id", "manufacturer", "model", "series", "loadCapacity", "liftingSpeed", "motorPower",
        F.array_join("classification", "|").alias("classes"), "quietOperation", "capacityKg", "speedMMin", "dataCompleteness",
        "hasCompleteSpecs", "source", "sourceUrl", "dataQualityTier")


@query("s19_field_presence", cat("""SELECT id,
  concat_ws('|', CASE WHEN has_cap THEN 'loadCapacity' END, CASE WHEN has_speed THEN 'liftingSpeed' END,
            CASE WHEN has_power THEN 'motorPower' END, CASE WHEN has_cls THEN 'classification' END) AS populated,
  concat_ws('|', CASE WHEN NOT has_cap THEN 'loadCapacity' END, CASE WHEN NOT has_speed THEN 'liftingSpeed' END,
            CASE WHEN NOT has_power THEN 'motorPower' END, CASE WHEN NOT has_cls THEN 'classification' END) AS missing
  FROM catalog"""))
def s19(spark, sf):
    return catalog(spark, sf).select("id", F.array_join("populatedFields", "|").alias("populated"),
                                     F.array_join("missingFields", "|").alias("missing"))


def _key_sql(ws: str) -> str:
    # vendor words are stripped from the model start one after the other; the views have at most two words
    m = "lower(trim(manufacturer))"
    w = f"string_split_regex({m}, '{ws}+')"
    strip = lambda t, i: f"CASE WHEN starts_with({t}, coalesce({w}[{i}], '')) THEN trim(substr({t}, len(coalesce({w}[{i}], '')) + 1)) ELSE {t} END"
    return m, w, strip


def dedupe_sql(mode: str) -> str:
    """CTE ``keyed``: catalog rows with their key."""
    ws = "s" if mode == "compat" else r"\s"
    m, w, strip = _key_sql(ws)
    t = "lower(trim(model))"
    tail = "t3"
    for word in ("electric chain hoist", "chain hoist", "hoist", "series", "model"):
        tail = f"replace({tail}, '{word}', '')"
    return f"""k0 AS (SELECT *, {t} AS t0 FROM catalog), k1 AS (SELECT *, {strip('t0', 1)} AS t1 FROM k0),
      k2 AS (SELECT *, {strip('t1', 2)} AS t2 FROM k1), k2b AS (SELECT *, {strip('t2', 3)} AS t2b FROM k2),
      k3 AS (SELECT *, regexp_replace(regexp_replace(t2b, '{ws}*-{ws}*', '-', 'g'), '{ws}+', ' ', 'g') AS t3 FROM k2b),
      keyed AS (SELECT *, {m} || ':' || trim({tail}) AS key FROM k3)"""


for _mode in ("fixed", "compat"):
    @query(f"s24_dedupe_key_{_mode}", cat("SELECT id, key FROM keyed", dedupe_sql(_mode)))
    def s24(spark, sf, mode=_mode):
        return catalog(spark, sf).select("id", dedupe_key(mode=mode).alias("key"))


@query("s12_unique_id", cat("""SELECT _pos, CASE WHEN n > 0 THEN base || '-' || CAST(n AS VARCHAR) ELSE base END AS unique_id
  FROM (SELECT _pos, base, row_number() OVER (PARTITION BY base ORDER BY _pos) - 1 AS n
        FROM (SELECT _pos, regexp_replace(lower(manufacturer || '--' || model), '[^a-z0-9]', '-', 'g') AS base FROM catalog))"""))
def s12(spark, sf):
    from ..functions.names import vendor_model_id

    return unique_id(catalog(spark, sf).select("_pos", vendor_model_id().alias("base")), "base").select("_pos", "unique_id")


_FOLD = """SELECT key, min(_pos) AS _pos, count(*) AS merged, arg_min_null(id, _pos) AS id, arg_min_null(url, _pos) AS url,
  arg_max(loadCapacity, (len(loadCapacity), -_pos)) AS loadCapacity,
  arg_max(motorPower, (len(motorPower), -_pos)) AS motorPower,
  arg_max(series, (len(series), -_pos)) AS series,
  arg_min(confidence, _pos) FILTER (confidence IS NOT NULL) AS confidence,
  CAST(sum(n_images) AS BIGINT) AS n_images
  FROM keyed GROUP BY key"""
_FOLD_CLASSES = """SELECT key, string_agg(c, '|' ORDER BY first_at) AS classes FROM (
  SELECT key, c, min(_pos * 1000 + i) AS first_at FROM (SELECT key, _pos, unnest(cls) AS c, generate_subscripts(cls, 1) AS i FROM keyed)
  GROUP BY key, c) GROUP BY key"""


@query("d01_dedupe_fold", cat(f"""SELECT f.*, coalesce(g.classes, '') AS classes,
   CAST(floor(0.5 + 70.0 * (cap + spd + pow + (g.classes IS NOT NULL)::INT + dut) / 5 + 30.0 * (vol + wgt + ip + ser) / 4) AS INT) AS dataCompleteness
  FROM ({_FOLD}) f LEFT JOIN ({_FOLD_CLASSES}) g USING (key)
  JOIN (SELECT key, max(has_cap::INT) cap, max(has_speed::INT) spd, max(has_power::INT) pow, max(has_duty::INT) dut,
               max(has_volt::INT) vol, max(has_weight::INT) wgt, max(has_ip::INT) ip, max(has_series::INT) ser
        FROM keyed GROUP BY key) h USING (key)""", dedupe_sql("fixed")))
def d01(spark, sf):
    d = dedupe.dedupe_fold(catalog(spark, sf))
    return d.select(c("_key").alias("key"), "_pos", c("_merged").alias("merged"), "id", "url", "loadCapacity", "motorPower", "series",
                    "confidence", "n_images", F.array_join("classification", "|").alias("classes"), "dataCompleteness")


@query("d01_dedupe_fold_compat", cat("""SELECT key, min(_pos) AS _pos, arg_min(dataCompleteness, _pos) AS dataCompleteness,
  arg_max(dataQualityTier, (len(dataQualityTier), -_pos)) AS dataQualityTier,
  arg_max(liftingSpeed, (len(liftingSpeed), -_pos)) AS liftingSpeed, CAST(sum(n_pdfs) AS BIGINT) AS n_pdfs
  FROM keyed GROUP BY key""", dedupe_sql("compat")))
def d01_compat(spark, sf):
    d = dedupe.dedupe_fold(catalog(spark, sf), recompute=False, mode="compat")
    return d.select(c("_key").alias("key"), "_pos", "dataCompleteness", "dataQualityTier", "liftingSpeed", "n_pdfs")


@query("d01_fold_structs_compat", cat("""SELECT key, coalesce(string_agg('/img/' || CAST(i AS VARCHAR) || '.jpg', '|' ORDER BY _pos, i) FILTER (i <= n_images), '') AS images, CAST(sum(n_images) / 3 AS BIGINT) AS n
  FROM keyed, range(1, 4) r(i) GROUP BY key""", dedupe_sql("compat")))
def d01_structs(spark, sf):
    """Every record's first image is the same one."""
    d = catalog(spark, sf).withColumn("images", F.transform("images", lambda x, i: x.withField("url", F.concat(F.lit("/img/"), (i + 1).cast("string"), F.lit(".jpg"))).withField("alt", F.lit(None).cast("string"))))
    folded = dedupe.dedupe_fold(d.drop("n_images"), recompute=False, mode="compat")
    return folded.select(c("_key").alias("key"), F.coalesce(F.array_join(F.col("images.url"), "|"), F.lit("")).alias("images"), c("n_images").alias("n"))


@query("d01_fold_media", cat("""SELECT key, _pos, CAST(i - 1 AS INT) AS i, '/img/' || id || '-' || CAST(i AS VARCHAR) || '.jpg' AS image_url
  FROM keyed, range(1, 4) r(i) WHERE i <= n_images""", dedupe_sql("fixed")))
def d01_media(spark, sf):
    return dedupe.fold_media(catalog(spark, sf), "images").select("key", "_pos", "i", c("item.url").alias("image_url"))


_URLKEY = "regexp_replace(lower(url), '/$', '')"


@query("d02_duplicate_groups", cat("""SELECT 'url' AS type, u AS key, n FROM urls
  UNION ALL SELECT 'model', mk, n FROM (SELECT mk, count(*) AS n, count(d.u) AS covered FROM rows_ r LEFT JOIN urls d ON r.u = d.u GROUP BY mk)
  WHERE n > 1 AND covered = 0""", f"""rows_ AS (SELECT id, CASE WHEN coalesce(url, '') <> '' THEN {_URLKEY} END AS u,
    lower(manufacturer || '|' || model) AS mk FROM catalog),
  urls AS (SELECT u, count(*) AS n FROM rows_ WHERE u IS NOT NULL GROUP BY u HAVING count(*) > 1)"""))
def d02(spark, sf):
    return dedupe.duplicate_groups(catalog(spark, sf))


@query("j16_model_groups", cat("""SELECT mk AS key, count(*) AS n FROM rows_ r GROUP BY mk HAVING count(*) > 1 AND NOT bool_or(u IS NOT NULL AND u IN (SELECT u FROM rows_ WHERE u IS NOT NULL GROUP BY u HAVING count(*) > 1))""",
                               f"""rows_ AS (SELECT id, CASE WHEN coalesce(url, '') <> '' THEN {_URLKEY} || '/' || CAST(_pos % 3 AS VARCHAR) END AS u, lower(manufacturer || '|') AS mk FROM catalog WHERE _pos % 5 = 0)"""))
def j16(spark, sf):
    """Vendors as groups, so that there are some, with a third of the pages told apart."""
    d = catalog(spark, sf).filter("_pos % 5 = 0").withColumn("url", F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.regexp_replace(F.lower("url"), "/$", ""), F.lit("/"), (c("_pos") % 3).cast("string"))))
    return dedupe.model_groups(d.withColumn("model", F.lit("")))


_SCORE = "((coalesce(loadCapacity,'')<>'')::INT + (coalesce(liftingSpeed,'')<>'')::INT + (coalesce(motorPower,'')<>'')::INT + (n_images>0)::INT + (n_pdfs>0)::INT)"
_UNCAT = """kept AS (SELECT r.* FROM raw r LEFT JOIN (SELECT url, count(*) AS uses FROM raw GROUP BY url) u ON r.url = u.url
  WHERE len(trim(model)) >= 3 AND lower(trim(model)) NOT IN ('s', 'hoists') AND NOT contains(lower(model), 'view all')
    AND NOT contains(lower(model), 'category') AND NOT (coalesce(r.url, '') <> '' AND u.uses > 10))"""


@query("d03_dedupe_best", raw(f"""SELECT id, manufacturer, model, first_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY manufacturer, lower(trim(model)) ORDER BY {_SCORE} DESC, _pos) AS rn,
         min(_pos) OVER (PARTITION BY manufacturer, lower(trim(model))) AS first_pos FROM kept) WHERE rn = 1""").replace(
             ")\nSELECT id", "), " + _UNCAT + "\nSELECT id", 1))
def d03(spark, sf):
    return dedupe.dedupe_best(rules.drop_category_pages(inputs.raw_catalog(spark, sf))).select("id", "manufacturer", "model", "first_pos")


@query("d04_duplicate_models", raw("""SELECT manufacturer || '|' || lower(trim(model)) AS key, count(*) AS n, min(_pos) AS first_pos
  FROM raw GROUP BY 1 HAVING count(*) > 1 """))
def d04(spark, sf):
    return dedupe.duplicate_models(inputs.raw_catalog(spark, sf))


@query("d05_dedupe_links", raw("""SELECT url, min(_pos) AS pos, arg_max(model, _pos) AS model, arg_max(series, _pos) AS series
  FROM raw WHERE url IS NOT NULL GROUP BY url"""))
def d05(spark, sf):
    r = inputs.raw_catalog(spark, sf).filter("url is not null").select("url", c("_pos").alias("pos"), "model", "series")
    return dedupe.dedupe_links(r, ["url"])


@query("d06_merge_classes", cat("""SELECT id, array_to_string(list_concat(cls,
  list_filter(['D8', 'New', 'ANSI'], lambda x: NOT list_contains(list_transform(cls, lambda y: lower(y)), lower(x)))), '|') AS merged FROM catalog"""))
def d06(spark, sf):
    new = F.array(F.lit("D8"), F.lit("New"), F.lit("ANSI"))
    return catalog(spark, sf).select("id", F.array_join(dedupe.merge_classes("classification", new), "|").alias("merged"))


@query("d07_dedupe_report", cat("""SELECT 'records' AS section, 'before' AS key, count(*) AS n FROM keyed
  UNION ALL SELECT 'records', 'after', count(DISTINCT key) FROM keyed
  UNION ALL SELECT 'records', 'removed', count(*) - count(DISTINCT key) FROM keyed
  UNION ALL SELECT 'manufacturer', m, count(*) FROM (SELECT key, arg_max(manufacturer, (len(manufacturer), -_pos)) AS m FROM keyed GROUP BY key) GROUP BY m""",
    dedupe_sql("fixed")))
def d07(spark, sf):
    before = catalog(spark, sf)
    return dedupe.dedupe_report(before, dedupe.dedupe_fold(before))


# -- merge and set operations -------------------------------------------------------------------------------------

def _base_update(spark, sf):
    r = inputs.raw_catalog(spark, sf)
    base = r.withColumn("images", F.when(c("_pos") % 4 == 0, F.slice("images", 1, 0)).otherwise(c("images")))
    upd = r.select("_pos", F.concat(F.when(c("_pos") % 3 == 1, "n-").otherwise(""), "id").alias("id"), F.concat("model", F.lit(" v2")).alias("model"),
                                          F.when(c("_pos") % 6 == 0, F.lit("9 kW")).alias("motorPower"), "weight", "images")
    twice = upd.unionByName(upd.filter("_pos % 9 = 0").select(
        (c("_pos") + 10000000).alias("_pos"), "id", F.concat("model", F.lit(" late")).alias("model"),
        F.lit(None).cast("string").alias("motorPower"), "weight", "images"))
    return base, twice


# both sides hold every row: a third of the updates have ids of their own, a quarter of the base rows lack their images
_UPD = """base AS (SELECT * REPLACE (CASE WHEN _pos % 4 = 0 THEN 0 ELSE n_images END AS n_images) FROM raw),
  upd0 AS (SELECT _pos, CASE WHEN _pos % 3 = 1 THEN 'n-' ELSE '' END || id AS id, model || ' v2' AS model, CASE WHEN _pos % 6 = 0 THEN '9 kW' END AS motorPower, weight, n_images FROM raw),
  upd AS (SELECT * FROM upd0 UNION ALL SELECT _pos + 10000000, id, model || ' late', NULL, weight, n_images FROM upd0 WHERE _pos % 9 = 0)"""


def _raw_more(body: str, more: str) -> str:
    from .oracle import RAW

    return f"WITH {RAW}, {more}\n{body}"


@query("j08_merge_catalogs", _raw_more("""SELECT coalesce(b.id, o.id) AS id, CASE WHEN b.id IS NULL THEN o.model ELSE b.model END AS model,
    CASE WHEN b.id IS NULL THEN o.img WHEN b.n_images > 0 THEN b.n_images ELSE coalesce(o.img, 0) END AS n_images,
    CASE WHEN b.id IS NULL THEN 'added' WHEN b.n_images = 0 AND o.img > 0 THEN 'updated' ELSE 'base' END AS merge_kind
  FROM base b FULL JOIN (SELECT id, arg_min(model, _pos) AS model, coalesce(arg_min(n_images, _pos) FILTER (n_images > 0), 0) AS img
                         FROM upd GROUP BY id) o ON b.id = o.id""", _UPD))
def j08(spark, sf):
    base, upd = _base_update(spark, sf)
    m = merge.merge_catalogs(base, upd)
    return m.select("id", "model", F.coalesce(F.size("images"), F.lit(0)).alias("n_images"), c("_merge").alias("merge_kind"))


@query("j08_merge_counts", _raw_more("""SELECT count(*) FILTER (b.id IS NULL) AS added,
    count(*) FILTER (b.n_images = 0 AND o.img > 0) AS updated,
    CAST(sum(coalesce(o.n, 0)) AS BIGINT) - count(*) FILTER (b.id IS NULL) - count(*) FILTER (b.n_images = 0 AND o.img > 0) AS skipped,
    count(*) AS total
  FROM base b FULL JOIN (SELECT id, count(*) AS n, coalesce(max(n_images), 0) AS img FROM upd GROUP BY id) o ON b.id = o.id""", _UPD))
def j08_counts(spark, sf):
    base, upd = _base_update(spark, sf)
    return merge.merge_counts(merge.merge_catalogs(base, upd))


@query("j09_upsert", _raw_more("""SELECT coalesce(b.id, u.id) AS id, coalesce(u.model, b.model) AS model, coalesce(u.motorPower, b.motorPower) AS motorPower,
    coalesce(u.weight, b.weight) AS weight, b.series AS series
  FROM base b FULL JOIN (SELECT id, arg_max(model, _pos) AS model, arg_max(motorPower, _pos) FILTER (motorPower IS NOT NULL) AS motorPower,
                                arg_max(weight, _pos) FILTER (weight IS NOT NULL) AS weight FROM upd GROUP BY id) u ON b.id = u.id""", _UPD))
def j09(spark, sf):
    base, upd = _base_update(spark, sf)
    return merge.upsert(base, upd.drop("images")).select("id", "model", "motorPower", "weight", "series")


@query("j09_insert_new", _raw_more("""SELECT id, model FROM base UNION ALL
  SELECT id, arg_min(model, _pos) FROM upd WHERE id NOT IN (SELECT id FROM base) GROUP BY id""", _UPD))
def j09_insert(spark, sf):
    base, upd = _base_update(spark, sf)
    return merge.insert_new(base, upd).select("id", "model")


@query("j10_delete_ids", raw("SELECT id, model FROM raw WHERE id NOT IN (SELECT id FROM raw WHERE n_images = 0)"))
def j10(spark, sf):
    r = inputs.raw_catalog(spark, sf)
    return merge.delete_ids(r, r.filter("size(images) = 0")).select("id", "model")


@query("u01_union_catalogs", _raw_more("""SELECT id, model, series, motorPower FROM base
  UNION ALL SELECT id, model, NULL, motorPower FROM upd""", _UPD))
def u01(spark, sf):
    base, upd = _base_update(spark, sf)
    return merge.union_catalogs(base, upd).select("id", "model", "series", "motorPower")


@query("u02_array_merge", cat("""SELECT id, array_to_string(list_concat(cls, list_filter(['d8', 'iso'], lambda x: NOT list_contains(cls, x))), '|') AS merged FROM catalog"""))
def u02(spark, sf):
    return catalog(spark, sf).select("id", F.array_join(merge.array_merge("classification", F.array(F.lit("d8"), F.lit("iso"))), "|").alias("merged"))


@query("u03_minus_keys", _raw_more("SELECT id, model FROM base WHERE id NOT IN (SELECT id FROM upd)", _UPD))
def u03(spark, sf):
    base, upd = _base_update(spark, sf)
    return merge.minus_keys(base, upd).select("id", "model")


@query("u05_map_keys_union", """SELECT DISTINCT CASE n WHEN 0 THEN event_type ELSE 'k' || CAST(user_id % 5 AS VARCHAR) END AS key
  FROM events, (VALUES (0), (1)) v(n)""")
def u05(spark, sf):
    e = inputs.table(spark, sf, "events")
    m = e.select(F.create_map(c("event_type"), c("value").cast("string"), F.concat(F.lit("k"), (c("user_id") % 5).cast("string")), c("props")).alias("m"))
    return merge.map_keys_union(m, "m")


@query("u06_all_documents", cat("""SELECT id, CAST(p AS INT) AS pos, url, origin FROM (
    SELECT id, i - 1 AS p, '/doc/' || id || '-' || CAST(i AS VARCHAR) || '.pdf' AS url, 'remote' AS origin FROM catalog, range(1, 4) r(i) WHERE i <= n_pdfs
    UNION ALL SELECT id, n_pdfs + i - 1, '/media/pdfs/' || id || '-' || CAST(i AS VARCHAR) || '.pdf', 'local' FROM catalog, range(1, 4) r(i) WHERE i <= n_downloads)"""))
def u06(spark, sf):
    d = catalog(spark, sf)
    return d.select("id", F.posexplode(merge.all_documents(d)).alias("pos", "d")).select("id", "pos", "d.url", "d.origin")


@query("j17_map_fill", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'view=a' ELSE 'view=b,' || event_type || '=a' END AS merged FROM events""")
def j17(spark, sf):
    e = inputs.table(spark, sf, "events")
    m = merge.map_fill(F.create_map(c("event_type"), F.lit("a")), F.create_map(F.lit("view"), F.lit("b")))
    v = F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    first = F.when(c("event_type") == "view", F.array_join(v, ",")).otherwise(F.concat(F.lit("view=b,"), c("event_type"), F.lit("="), F.try_element_at(m, c("event_type"))))
    return e.select("event_id", first.alias("merged"))


# -- seeds and flat exports ---------------------------------------------------------------------------------------

_SEED_VENDORS = "CASE CAST(substr(p_brand, 7) AS INT) % 4 WHEN 0 THEN 'kito' WHEN 1 THEN 'gorbel' WHEN 2 THEN 'demag' ELSE 'none' END"


@query("src7_seed_products", """WITH v AS (SELECT DISTINCT p_brand AS name, """ + _SEED_VENDORS + """ AS vendor_id FROM part),
  have AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size > 48),
  known(vendor_id, model, cap) AS (VALUES ('kito', 'ER2', '250-5000 kg'), ('kito', 'EQ', '500-20000 kg'), ('gorbel', 'GS Series', '250-2000 kg'),
    ('demag', 'DC-Pro', '125-2000 kg'), ('demag', 'DC-Com', '125-2000 kg'))
  SELECT k.vendor_id || '-' || replace(lower(k.model), ' ', '-') AS id, v.name AS manufacturer, k.model, k.cap AS loadCapacity,
         'http://' || lower(v.name) AS url, CAST(0.9 AS DOUBLE) AS confidence
  FROM v JOIN known k USING (vendor_id) WHERE v.name NOT IN (SELECT name FROM have)""")
def src7(spark, sf):
    p = inputs.table(spark, sf, "part")
    vendors = p.select(c("p_brand").alias("name"), F.expr(_SEED_VENDORS).alias("vendor_id"),
                       F.concat(F.lit("http://"), F.lower("p_brand")).alias("website")).distinct()
    have = p.filter("p_size > 48").select(c("p_brand").alias("manufacturer"))
    return seeds.seed_products(have, vendors).select("id", "manufacturer", "model", "loadCapacity", "url", "confidence")


_FLAT_MORE = """SELECT id, manufacturer, array_to_string(cls, '{sep}') AS classification, coalesce(voltage_raw, NULL) AS voltageOptions,
  array_to_string(list_transform(range(1, n_images + 1), lambda i: '/img/' || id || '-' || CAST(i AS VARCHAR) || '.jpg'), '{sep}') AS images,
  strftime(lastUpdated, '%Y-%m-%dT%H:%M:%S.000Z') AS lastUpdated"""


_FLAT_SQL = cat(_FLAT_MORE.format(sep=", ") + """,
  CASE WHEN protectionClass IS NOT NULL THEN protectionClass END AS certification_ip, CASE WHEN dutyCycle IS NOT NULL THEN dutyCycle END AS certification_duty,
  confidence AS priceValue, CASE WHEN confidence IS NOT NULL THEN 'EUR' END AS priceCurrency FROM catalog""")


def _with_maps(d):
    pairs = F.array_compact(F.array(F.when(c("protectionClass").isNotNull(), F.struct(F.lit("ip").alias("k"), c("protectionClass").alias("v"))),
                                    F.when(c("dutyCycle").isNotNull(), F.struct(F.lit("duty").alias("k"), c("dutyCycle").alias("v")))))
    d = d.withColumns({"certifications": F.map_from_entries(pairs),
                       "price": F.struct(c("confidence").alias("value"), F.when(c("confidence").isNotNull(), "EUR").alias("currency"))})
    return d.select("id", "manufacturer", "classification", "voltageOptions", "images", "lastUpdated", "certifications", "price")


@query("snk2_flatten_catalog", _FLAT_SQL)
def snk2(spark, sf):
    return writers.flatten_catalog(_with_maps(catalog(spark, sf)), map_keys={"certifications": ["duty", "ip"]})


@query("snk2_header_found", _FLAT_SQL)
def snk2_found(spark, sf):
    """The header's keys come from the rows."""
    d = _with_maps(catalog(spark, sf))
    return writers.flatten_catalog(d, map_keys=writers.header_keys(d))


@query("snk3_flatten_export", cat(_FLAT_MORE.format(sep="; ") + """,
  CASE WHEN coalesce(confidence, 0) = 0 THEN '' ELSE CAST(confidence AS VARCHAR) END AS priceValue FROM catalog"""))
def snk3(spark, sf):
    d = catalog(spark, sf).withColumn("price", F.struct(c("confidence").alias("value")))
    return writers.flatten_catalog(d.select("id", "manufacturer", "classification", "voltageOptions", "images", "lastUpdated", "price"),
                                   sep="; ", falsy_blank=True)


@query("snk4_flatten_media", cat("""SELECT id, array_to_string(cls, ', ') AS classification,
  array_to_string(list_transform(range(1, n_images + 1), lambda i: '/img/' || id || '-' || CAST(i AS VARCHAR) || '.jpg'), '; ') AS images FROM catalog"""))
def snk4(spark, sf):
    return writers.flatten_media(catalog(spark, sf).select("id", "classification", "images"))


@query("snk1_export_metadata", cat("""SELECT count(*) AS "totalRecords", '2.0' AS version FROM catalog
  WHERE contains(lower(manufacturer), 'brand#1') AND list_contains(cls, 'd8')"""))
def snk1(spark, sf):
    from ..operators.search import export_filter

    flt = {"manufacturer": "Brand#1", "classification": "D8"}
    return writers.export_meta(export_filter(catalog(spark, sf), **flt), None, flt).select("totalRecords", "version")


@query("snk7_retention", """SELECT snapshot_ts, rows, row_number() OVER (ORDER BY snapshot_ts DESC) AS rank,
  row_number() OVER (ORDER BY snapshot_ts DESC) <= 10 AS keep
  FROM (SELECT strftime(o_orderdate, '%Y-%m') AS snapshot_ts, count(*) AS rows FROM orders GROUP BY 1)""")
def snk7(spark, sf):
    o = inputs.table(spark, sf, "orders")
    manifest = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("snapshot_ts")).agg(F.count("*").alias("rows"))
    return writers.retention(manifest)


@query("s50_dates_and_sizes", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S') AS stamp,
  epoch_ms(o_orderdate) AS ms, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' ELSE 'large' END AS size
  FROM (SELECT *, o_orderkey % 1500 AS b FROM orders)""")
def s50(spark, sf):
    o = inputs.table(spark, sf, "orders")
    b = c("o_orderkey") % 1500
    return o.select("o_orderkey", writers.iso_date("o_orderdate").alias("iso"), writers.backup_stamp("o_orderdate").alias("stamp"),
                    writers.epoch_ms(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ms"),
                    F.when(b < 1024, writers.size_text(b)).otherwise("large").alias("size"))
