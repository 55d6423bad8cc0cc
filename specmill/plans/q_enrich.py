"""Enrichment merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mining
from ..functions.text import c
from ..operators import linkage, merge
from . import inputs
from .oracle import RAW
from .q_linkage import _IDS, _ids
from .registry import query

_EXT = """ext AS (SELECT CASE WHEN _pos % 3 = 1 THEN 'other-' ELSE '' END || id AS id, CASE WHEN _pos % 2 = 0 THEN 'new ' || id END AS loadCapacity, '3 kW' AS motorPower, CASE WHEN _pos % 4 = 0 THEN 'x' END AS dutyCycle,
   CASE WHEN _pos % 5 = 0 THEN 0.9 WHEN _pos % 5 = 1 THEN 0.7 ELSE 0.4 END AS confidence FROM raw)"""


def more(body: str, ctes: str = _EXT) -> str:
    return f"WITH {RAW}, {ctes}\n{body}"


def extractions(spark, sf):
    r = inputs.raw_catalog(spark, sf)
    n = c("_pos") % 5
    own = F.concat(F.when(c("_pos") % 3 == 1, "other-").otherwise(""), "id")  # a third belongs to no row
    return r.select(own.alias("id"), F.when(c("_pos") % 2 == 0, F.concat(F.lit("new "), "id")).alias("loadCapacity"), F.lit("3 kW").alias("motorPower"),
                    F.when(c("_pos") % 4 == 0, "x").alias("dutyCycle"), F.when(n == 0, 0.9).when(n == 1, 0.7).otherwise(0.4).alias("confidence"))


@query("e02_fill_from", more("""SELECT r.id, CASE WHEN coalesce(r.loadCapacity, '') = '' AND x.loadCapacity IS NOT NULL THEN x.loadCapacity ELSE r.loadCapacity END AS loadCapacity,
  CASE WHEN coalesce(r.motorPower, '') = '' AND x.motorPower IS NOT NULL THEN x.motorPower ELSE r.motorPower END AS motorPower,
  concat_ws('|', CASE WHEN coalesce(r.loadCapacity, '') = '' AND x.loadCapacity IS NOT NULL THEN 'loadCapacity' END, CASE WHEN coalesce(r.motorPower, '') = '' AND x.motorPower IS NOT NULL THEN 'motorPower' END,
            CASE WHEN coalesce(r.dutyCycle, '') = '' AND x.dutyCycle IS NOT NULL THEN 'dutyCycle' END) AS filled FROM raw r LEFT JOIN ext x ON r.id = x.id"""))
def e02(spark, sf):
    out = merge.fill_from(inputs.raw_catalog(spark, sf), extractions(spark, sf))
    return out.select("id", "loadCapacity", "motorPower", F.array_join("_enrichedFields", "|").alias("filled"))


_TAKE = "(x.{0} IS NOT NULL AND (coalesce(r.{0}, '') = '' OR (x.confidence > 0.8 AND coalesce(r.confidence < 0.8, false))))"


@query("e04_merge_confident", more(f"""SELECT r.id, CASE WHEN {_TAKE.format('loadCapacity')} THEN x.loadCapacity ELSE r.loadCapacity END AS loadCapacity,
  CASE WHEN {_TAKE.format('motorPower')} THEN x.motorPower ELSE r.motorPower END AS motorPower,
  CASE WHEN x.confidence IS NOT NULL THEN greatest(coalesce(r.confidence, 0), x.confidence) ELSE r.confidence END AS confidence
  FROM raw r LEFT JOIN (SELECT * FROM ext WHERE confidence > 0.5) x ON r.id = x.id"""))
def e04(spark, sf):
    out = merge.merge_confident(inputs.raw_catalog(spark, sf), extractions(spark, sf), min_confidence=0.5)
    return out.select("id", "loadCapacity", "motorPower", "confidence")


@query("e07_override_from", more("""SELECT r.id, CASE WHEN len(trim(r.model)) >= 20 AND x.loadCapacity IS NOT NULL THEN x.loadCapacity ELSE r.loadCapacity END AS loadCapacity,
  CASE WHEN len(trim(r.model)) >= 20 AND x.motorPower IS NOT NULL THEN x.motorPower ELSE r.motorPower END AS motorPower FROM raw r LEFT JOIN ext x ON r.id = x.id"""))
def e07(spark, sf):
    return merge.override_from(inputs.raw_catalog(spark, sf), extractions(spark, sf), text="model").select("id", "loadCapacity", "motorPower")


@query("e05_promote", f"""WITH docs AS ({inputs.DOCS_SQL}) SELECT 'brand#x-' || regexp_replace(regexp_replace(lower(filename), '[^a-z0-9]', '-', 'g'), '-+', '-', 'g') AS id, filename AS model, ext_capacity AS "loadCapacity"
  FROM docs WHERE error IS NULL""")
def e05(spark, sf):
    d = inputs.doc_files(spark, sf).select(F.lit("Brand#X").alias("manufacturer"), c("filename").alias("title"), c("ext_capacity").alias("loadCapacity"), "error")
    return merge.promote(d).select("id", "model", "loadCapacity")


@query("e06_enrich_in_order", more("""SELECT id, power, cap FROM s3""", """x AS (SELECT id, loadCapacity AS c0, motorPower AS p0, confidence AS q0, liftingSpeed AS sp, model AS descr, _pos FROM raw),
  s1 AS (SELECT *, CASE WHEN _pos % 2 = 0 AND (coalesce(p0, '') = '' OR coalesce(q0 < 0.8, false)) THEN 'img' ELSE p0 END AS p1, CASE WHEN _pos % 2 = 0 THEN greatest(coalesce(q0, 0), 0.9) ELSE q0 END AS q1 FROM x),
  s2 AS (SELECT *, CASE WHEN _pos % 3 = 0 AND coalesce(p1, '') = '' THEN 'pdf' ELSE p1 END AS p2, CASE WHEN _pos % 3 = 0 THEN greatest(coalesce(q1, 0), 0.6) ELSE q1 END AS q2 FROM s1),
  s3 AS (SELECT id, p2 AS power, CASE WHEN (coalesce(c0, '') = '' OR coalesce(sp, '') = '') AND coalesce(c0, '') = '' THEN 'text' ELSE c0 END AS cap FROM s2)"""))
def e06(spark, sf):
    r = inputs.raw_catalog(spark, sf)
    none = F.lit(None).cast("string")
    row = lambda d, kind, pos, conf, p, cap: d.select("id", F.lit(kind).alias("kind"), F.lit(pos).alias("pos"), F.lit(conf).alias("confidence"), p.alias("motorPower"), cap.alias("loadCapacity"))
    exts = (row(r.filter("_pos % 2 = 0"), "image", 1, 0.3, F.lit("weak"), none).unionByName(row(r.filter("_pos % 2 = 0"), "image", 2, 0.9, F.lit("img"), none))
            .unionByName(row(r.filter("_pos % 2 = 0"), "image", 3, 0.99, F.lit("third"), F.lit("third")))
            .unionByName(row(r.filter("_pos % 3 = 0"), "pdf", 1, 0.6, F.lit("pdf"), none)).unionByName(row(r, "text", 1, 0.7, none, F.lit("text"))))
    base = r.withColumn("description", c("model"))
    out = merge.enrich_in_order(base, exts, ["motorPower", "loadCapacity"], 2)
    return out.select("id", c("motorPower").alias("power"), c("loadCapacity").alias("cap"))


_D = r"""mined AS (SELECT key, min(doc_pos) AS p, arg_min(d, doc_pos) AS d, arg_min(w, doc_pos) AS w FROM (SELECT replace(lower(p_brand), '#', '') || '-' || split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END AS key,
   p_partkey AS doc_pos, CAST(p_size AS VARCHAR) || ' x 20 x 30 cm' AS d, CAST(p_size + 100 AS VARCHAR) || ' kg' AS w FROM part) GROUP BY key),
  link AS (SELECT id, key FROM pid JOIN key ON id = key OR starts_with(id, key || '-') OR starts_with(key, split_part(id, '-', 1) || '-' || split_part(id, '-', 2))),
  best AS (SELECT id, arg_min(d, p) FILTER (len(d) > 10) AS d, arg_min(w, p) AS w FROM link JOIN mined USING (key) GROUP BY id)"""


@query("e03_fill_sizes", f"""WITH {_IDS}, {_D} SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 AND b.d IS NOT NULL THEN b.d ELSE CASE p_partkey % 3 WHEN 0 THEN 'Not specified' WHEN 1 THEN NULL ELSE '10 x 10 x 10' END END AS dimensions,
  CASE WHEN p_partkey % 2 = 0 AND b.w IS NOT NULL THEN b.w ELSE CASE p_partkey % 2 WHEN 0 THEN '-' ELSE '77 kg' END END AS weight
  FROM prod LEFT JOIN best b USING (id)""")
def e03(spark, sf):
    p = inputs.table(spark, sf, "part")
    ids, keys = _ids(spark, sf)
    b = F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))
    pid = F.concat(b, F.lit("-"), F.replace(c("p_name"), F.lit(" "), F.lit("-")), F.when(c("p_partkey") % 4 == 0, "-x").otherwise(""))
    key = F.concat(b, F.lit("-"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.when(c("p_partkey") % 3 == 0, "s").otherwise(""))
    text = F.concat(F.lit("Size "), c("p_size").cast("string"), F.lit(" x 20 x 30 cm, weight "), (c("p_size") + 100).cast("string"), F.lit(" kg"))
    docs = p.select(key.alias("key"), c("p_partkey").alias("doc_pos"), text.alias("text"))
    m = docs.select("key", "doc_pos", F.filter(mining.mine_dimensions("text"), lambda x: ~F.lower(x).contains("size")).alias("dimensions"),
                    F.filter(mining.mine_weights("text"), lambda x: ~F.lower(x).contains("weight")).alias("weights"))
    first = m.groupBy("key").agg(F.min("doc_pos").alias("key_pos"), F.min_by("dimensions", "doc_pos").alias("dimensions"), F.min_by("weights", "doc_pos").alias("weights"))
    base = p.select("p_partkey", pid.alias("id"), F.when(c("p_partkey") % 3 == 0, "Not specified").when(c("p_partkey") % 3 == 2, "10 x 10 x 10").alias("dimensions"),
                    F.when(c("p_partkey") % 2 == 0, "-").otherwise("77 kg").alias("weight"))
    return merge.fill_sizes(base, first, linkage.link_by_id(ids, keys)).select("p_partkey", "dimensions", "weight")
