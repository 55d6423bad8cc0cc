"""Rules, brands, and links between products, documents and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import match_confidence, parse_media_name
from ..functions.text import c
from ..operators import linkage, merge
from . import inputs
from .oracle import RAW, f, raw
from .q_scalars import _ANY, _EST, MK
from .registry import query

_DOCS = f"docs AS (SELECT *, p[1] AS vendor, p[2] AS product FROM (SELECT *, string_split(replace(filename, '.pdf', ''), '_') AS p FROM ({inputs.DOCS_SQL})))"


def docs(body: str, more: str = "") -> str:
    return f"WITH {RAW}, {_DOCS}{', ' + more if more else ''}\n{body}"


def doc_files(spark, sf):
    d = inputs.doc_files(spark, sf).withColumn("m", parse_media_name("filename"))
    return d.withColumns({"vendor": c("m.vendor"), "product": c("m.product")}).drop("m")


_RULES = [("brand#4", "red", "1 kW"), ("brand#4", "", "2 kW"), ("brand#", "widget", "3 kW"), ("verlinde", "sr", "4 kW")]
_RULE_CASE = "CASE " + " ".join(f"WHEN contains(lower(manufacturer), '{a}') AND contains(lower(model), '{b}') THEN '{p}'" for a, b, p in _RULES) + " END"
_HAD = ("(coalesce(motorPower, '') <> '' AND NOT regexp_matches(trim(motorPower), "
        r"'(?i)^not\s*(specified|visible|available|applicable)|^n/?a$|^-$|^unknown$|^tbd$|^varies$|^see\s+spec|^contact'))")


@query("j03_fill_power", raw(f"""SELECT id, CASE WHEN had THEN motorPower WHEN known IS NOT NULL THEN known WHEN guess IS NOT NULL THEN guess || ' (estimated)'
    WHEN coalesce(motorPower, '') <> '' THEN '' ELSE motorPower END AS motorPower,
    CASE WHEN had THEN 'had' WHEN known IS NOT NULL THEN 'known' WHEN guess IS NOT NULL THEN 'estimated' ELSE 'unchanged' END AS status
  FROM (SELECT *, {_HAD} AS had, {_RULE_CASE} AS known, {f(_EST, f'nullif({_ANY}, 0)')} AS guess FROM raw)"""))
def j03(spark, sf):
    return linkage.fill_power(inputs.raw_catalog(spark, sf), _RULES).select("id", "motorPower", c("power_status").alias("status"))




# vendor texts differ by '#' against '-', so the link test writes the vendor the way the files do
@query("j05_link_docs", docs("""SELECT d.filename, r.id FROM (SELECT DISTINCT filename, replace(lower(vendor), '-', ' ') AS dv, replace(lower(product), '-', ' ') AS dp FROM docs) d
  JOIN (SELECT id, lower(replace(manufacturer, '#', ' ')) AS pv, lower(model) AS m, lower(series) AS s FROM raw) r
  ON (contains(pv, dv) OR contains(dv, pv)) AND (contains(m, dp) OR contains(dp, m) OR contains(s, dp) OR contains(dp, s))"""))
def j05(spark, sf):
    p = inputs.raw_catalog(spark, sf).withColumn("manufacturer", F.replace(c("manufacturer"), F.lit("#"), F.lit(" ")))
    return linkage.link_docs(p, doc_files(spark, sf).select("filename", "vendor", "product").distinct())


_FILES = f"""files AS (SELECT arg_min(_pos, _pos) AS fpos, filename, upper(substr(replace(vendor, '-', ' '), 1, 1)) || substr(replace(vendor, '-', ' '), 2) AS fv,
    replace(product, '-', ' ') AS slug, arg_min(ext_manufacturer, _pos) AS xm, lower(arg_min(ext_model, _pos)) AS em, lower(arg_min(ext_series, _pos)) AS es FROM docs GROUP BY filename, vendor, product),
  prods AS (SELECT id, _pos, manufacturer, lower(model) AS model, lower(series) AS series, {f(MK, 'manufacturer')} AS pk FROM raw),
  fk AS (SELECT *, {f(MK, 'fv')} AS fk, {f(MK, 'xm')} AS ek FROM files),
  pairs AS (SELECT f.filename, f.fpos, p.id, p._pos, least(round(0.5 + CASE WHEN lower(p.manufacturer) = lower(f.fv) THEN 0.2 ELSE 0 END + CASE WHEN contains(f.slug, p.model) THEN 0.2 ELSE 0 END
      + CASE WHEN f.em <> '' AND contains(p.model, f.em) THEN 0.1 ELSE 0 END, 6), 1.0) AS confidence
    FROM fk f JOIN prods p ON (contains(p.pk, f.fk) OR contains(f.fk, p.pk) OR (f.ek <> '' AND contains(p.pk, f.ek)))
      AND (contains(p.model, f.slug) OR contains(f.slug, p.model) OR (f.em <> '' AND (contains(p.model, f.em) OR contains(f.em, p.model)))
           OR (f.es <> '' AND (contains(p.series, f.es) OR contains(p.model, f.es))))),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY confidence DESC, _pos) AS rank FROM pairs)"""


def files_for_ranking(spark, sf):
    """One row per file name (the earliest), parsed and with its extraction."""
    d = inputs.doc_files(spark, sf).groupBy("filename").agg(F.min("_pos").alias("_pos"), *[
        F.min_by(x, "_pos").alias(x) for x in ("ext_manufacturer", "ext_model", "ext_series", "ext_capacity", "error")])
    m = parse_media_name("filename", "titled")
    return d.withColumn("m", m).withColumns({"vendor": c("m.vendor"), "slug": c("m.product")}).drop("m")


def ranked(spark, sf):
    return linkage.rank_matches(inputs.raw_catalog(spark, sf), files_for_ranking(spark, sf))


@query("j06_rank_matches", docs("SELECT filename, CAST(rank AS INT) AS rank, id, CAST(confidence AS DOUBLE) AS confidence FROM ranked WHERE rank <= 5", _FILES))
def j06(spark, sf):
    return ranked(spark, sf).select("filename", "rank", "id", "confidence")


@query("j06_best_match", docs("SELECT id, arg_min(filename, fpos) AS filename, CAST(arg_min(confidence, fpos) AS DOUBLE) AS confidence FROM ranked WHERE rank = 1 AND confidence >= 0.6 GROUP BY id", _FILES))
def j06_best(spark, sf):
    return linkage.best_match(ranked(spark, sf))


@query("s38_match_confidence", raw("""SELECT id, CAST(least(round(0.5 + CASE WHEN lower(manufacturer) = 'brand#4' THEN 0.2 ELSE 0 END + CASE WHEN contains('red widget hoist box', lower(model)) THEN 0.2 ELSE 0 END
  + CASE WHEN contains(lower(model), 'ring') THEN 0.1 ELSE 0 END, 6), 1.0) AS DOUBLE) AS confidence FROM raw"""))
def s38(spark, sf):
    return inputs.raw_catalog(spark, sf).select("id", match_confidence("manufacturer", "model", F.lit("BRAND#4"), F.lit("red widget hoist box"), F.lit("Ring")).alias("confidence"))


_IDS = """prod AS (SELECT p_partkey, replace(lower(p_brand), '#', '') || '-' || replace(p_name, ' ', '-') || CASE WHEN p_partkey % 4 = 0 THEN '-x' ELSE '' END AS id FROM part),
  pid AS (SELECT DISTINCT id FROM prod), key AS (SELECT DISTINCT replace(lower(p_brand), '#', '') || '-' || split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END AS key FROM part)"""


def _ids(spark, sf):
    p = inputs.table(spark, sf, "part")
    b = F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))
    ids = p.select(F.concat(b, F.lit("-"), F.replace(c("p_name"), F.lit(" "), F.lit("-")), F.when(c("p_partkey") % 4 == 0, "-x").otherwise("")).alias("id"))
    keys = p.select(F.concat(b, F.lit("-"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.when(c("p_partkey") % 3 == 0, "s").otherwise("")).alias("key"))
    return ids, keys


@query("j07_link_by_id", f"""WITH {_IDS} SELECT id, key FROM pid JOIN key ON id = key OR starts_with(id, key || '-') OR starts_with(key, split_part(id, '-', 1) || '-' || split_part(id, '-', 2))""")
def j07(spark, sf):
    return linkage.link_by_id(*_ids(spark, sf))


@query("j11_pending", docs("SELECT DISTINCT filename FROM docs WHERE filename NOT IN (SELECT filename FROM docs WHERE _pos % 30 = 0)"))
def j11(spark, sf):
    d = inputs.doc_files(spark, sf)
    return merge.pending(d, d.filter("_pos % 30 = 0")).select("filename").distinct()


# images of every part: page slug from the name, vendor as in the catalogue
_IMG = """imgs AS (SELECT DISTINCT manufacturer AS v, CASE _pos % 4 WHEN 0 THEN replace(split_part(model, ' ', 1), '#', '') || '-' || split_part(model, ' ', 2) WHEN 1 THEN split_part(model, ' ', 2) || '-zz-' || split_part(model, ' ', 1)
     WHEN 2 THEN 'page-' || split_part(model, ' ', 1) ELSE split_part(model, ' ', 2) END AS page, CAST(_pos % 2 AS INT) AS index FROM raw),
  im AS (SELECT *, '/media/images/' || page || '_' || CAST(index AS VARCHAR) || '.jpg' AS url FROM imgs),
  pr AS (SELECT id, manufacturer AS v, n_images, regexp_replace(regexp_replace(lower(model), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS ms, regexp_replace(id, '^[^-]+-', '') AS ds FROM raw),
  hit AS (SELECT p.id, i.url, i.page, i.index FROM pr p JOIN im i ON i.v = p.v WHERE contains(i.page, p.ms) OR contains(p.ms, i.page) OR contains(i.page, p.ds) OR contains(p.ds, i.page)
     OR len(list_filter(list_filter(string_split(i.page, '-'), lambda t: len(t) > 2), lambda t: len(list_filter(list_filter(string_split(p.ms, '-'), lambda u: len(u) > 2), lambda u: contains(u, t) OR contains(t, u))) > 0)) >= 2),
  spare AS (SELECT v, page, url, row_number() OVER (PARTITION BY v ORDER BY page) AS r FROM im WHERE index = 0)"""


def image_files(spark, sf):
    r = inputs.raw_catalog(spark, sf)
    w = lambda i: F.split_part("model", F.lit(" "), F.lit(i))
    n = c("_pos") % 4
    page = (F.when(n == 0, F.concat(F.replace(w(1), F.lit("#"), F.lit("")), F.lit("-"), w(2))).when(n == 1, F.concat(w(2), F.lit("-zz-"), w(1)))
            .when(n == 2, F.concat(F.lit("page-"), w(1))).otherwise(w(2)))
    d = r.select(c("manufacturer").alias("vendor"), page.alias("page"), (c("_pos") % 2).cast("int").alias("index")).distinct()
    return d.withColumn("url", F.concat(F.lit("/media/images/"), "page", F.lit("_"), c("index").cast("string"), F.lit(".jpg")))


@query("j04_link_images", f"""WITH {RAW}, {_IMG} SELECT id, url, page, index, 'match' AS how FROM hit
  UNION ALL SELECT p.id, s.url, s.page, CAST(0 AS INT), 'fallback' FROM pr p JOIN spare s ON s.v = p.v WHERE s.r <= 3 AND p.n_images = 0 AND p.id NOT IN (SELECT id FROM hit)""")
def j04(spark, sf):
    return linkage.link_images(inputs.raw_catalog(spark, sf), image_files(spark, sf))
