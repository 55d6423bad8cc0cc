"""Rule filters: products or not, empty records, stale records, candidates for another visit."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import c, match_label
from ..operators import rules
from . import inputs
from .oracle import RAW, raw
from .registry import query


def _q(s: str) -> str:
    return s.replace("'", "''")


def _re2(p: str) -> str:
    """The lookaheads are redundant after the kept types were tested, and DuckDB has none."""
    return re.sub(r"\(\?!.*?\)$", "", p)


def anym(x: str, patterns) -> str:
    return f"regexp_matches({x}, '(?i){_q('|'.join('(?:' + _re2(p) + ')' for p in patterns))}')"


def case(x: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){_q(_re2(p))}') THEN '{_q(match_label(p))}'" for p in patterns) + " END"


_PATH = r"CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#\s]+') THEN regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+', ''), '#.*$', '') END"
# the test models carry words of several rule lists
VARIED = """varied AS (SELECT * REPLACE (CASE _pos % 12 WHEN 0 THEN replace(model, ' Hoist', '') WHEN 1 THEN 'Contact us' WHEN 2 THEN replace(model, 'Hoist', 'Conveyor')
     WHEN 3 THEN 'x' WHEN 4 THEN replace(model, 'Hoist', 'crane') WHEN 5 THEN 'Products' WHEN 6 THEN 'wire rope hoists' WHEN 7 THEN 'Hand' WHEN 8 THEN 'category pages' ELSE model END AS model) FROM raw)"""


def varied(spark, sf):
    r = inputs.raw_catalog(spark, sf)
    n, m = c("_pos") % 12, c("model")
    sub = lambda w: F.replace(m, F.lit("Hoist"), F.lit(w))
    return r.withColumn("model", F.when(n == 0, F.replace(m, F.lit(" Hoist"), F.lit(""))).when(n == 1, "Contact us").when(n == 2, sub("Conveyor"))
                        .when(n == 3, "x").when(n == 4, sub("crane")).when(n == 5, "Products").when(n == 6, "wire rope hoists").when(n == 7, "Hand")
                        .when(n == 8, "category pages").otherwise(m))


def var(body: str, more: str = "") -> str:
    return f"WITH {RAW}, {VARIED}{', ' + more if more else ''}\n{body}"


_TEXT = "lower(concat_ws(' ', model, '', coalesce(series, ''), ''))"
_CHECK = f"""checked AS (SELECT *, {case('full_path', rules.SKIP_URLS)} AS url_hit, {case('trim(model)', rules.SKIP_MODELS)} AS model_hit, {anym('txt', rules.KEEP_TYPES)} AS kept,
    {case('txt', rules.DROP_TYPES)} AS drop_hit FROM (SELECT *, {_PATH} AS full_path, {_TEXT} AS txt FROM varied)),
  judged AS (SELECT *, CASE WHEN url_hit IS NOT NULL THEN 'URL matches skip pattern: ' || url_hit END AS r1,
    CASE WHEN coalesce(model, '') = '' THEN 'No model name provided' WHEN len(trim(model)) < 2 THEN 'Model name too short'
         WHEN model_hit IS NOT NULL THEN 'Model matches skip pattern: ' || model_hit END AS r2,
    CASE WHEN NOT kept AND drop_hit IS NOT NULL THEN 'Matches non-hoist pattern: ' || drop_hit END AS r3,
    CASE WHEN url <> '' AND url_hit IS NULL AND full_path IN ('', '/') THEN 'Homepage URL - may not be product-specific' END AS w1,
    CASE WHEN NOT kept AND drop_hit IS NULL THEN 'Product type uncertain - may not be a hoist' END AS w2 FROM checked)"""


@query("f11_validate_records", var("SELECT id, r1 IS NULL AND r2 IS NULL AND r3 IS NULL AS valid, concat_ws('|', r1, r2, r3) AS reasons, concat_ws('|', w1, w2) AS warnings FROM judged", _CHECK))
def f11(spark, sf):
    return rules.validate_records(varied(spark, sf)).select("id", "valid", F.array_join("reasons", "|").alias("reasons"), F.array_join("warnings", "|").alias("warnings"))


@query("f11_validate_strict", var("""SELECT id, r1 IS NULL AND r2 IS NULL AND r3 IS NULL AND coalesce(manufacturer, '') <> '' AND len(trim(model)) >= 2
   AND (coalesce(loadCapacity, '') <> '' OR coalesce(liftingSpeed, '') <> '' OR coalesce(motorPower, '') <> '') AS valid FROM judged""", _CHECK))
def f11_strict(spark, sf):
    return rules.validate_records(varied(spark, sf), strict=True).select("id", "valid")


@query("f12_split_valid", var("SELECT id, r1 IS NULL AND r2 IS NULL AND r3 IS NULL AS kept FROM judged", _CHECK))
def f12(spark, sf):
    good, bad = rules.split_valid(varied(spark, sf))
    return good.select("id", F.lit(True).alias("kept")).unionByName(bad.select("id", F.lit(False).alias("kept")))


@query("f13_invalid_by_reason", var("""SELECT reason, manufacturer, model, CAST(sample AS INT) AS sample, n FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY _pos) AS sample,
  count(*) OVER (PARTITION BY reason) AS n FROM (SELECT *, coalesce(r1, r2, r3) AS reason FROM judged) WHERE reason IS NOT NULL) WHERE sample <= 3""", _CHECK))
def f13(spark, sf):
    return rules.invalid_by_reason(varied(spark, sf), 3)


_SET = lambda x: f"(coalesce({x}, '') <> '')"
_KNOWN = lambda x: f"(coalesce({x}, '') NOT IN ('', 'Unknown'))"
_FILLED = lambda x: f"(trim(coalesce({x}, '')) <> '')"


@query("f14_empty_records", raw(f"""SELECT id, NOT ({_KNOWN('loadCapacity')} OR {_KNOWN('liftingSpeed')} OR {_KNOWN('motorPower')} OR n_images > 0) AS signals,
  {_SET('loadCapacity')}::INT + {_SET('liftingSpeed')}::INT + {_SET('motorPower')}::INT + {_SET('weight')}::INT + (n_images > 0)::INT + (n_pdfs > 0)::INT < 3 AS useful,
  NOT ({_FILLED('loadCapacity')} OR {_FILLED('liftingSpeed')} OR {_FILLED('motorPower')} OR {_FILLED('dutyCycle')} OR {_FILLED('weight')} OR coalesce(classification_raw, '') <> '') AS specs FROM raw"""))
def f14(spark, sf):
    r = inputs.raw_catalog(spark, sf)
    return r.select("id", *[rules.is_empty(r, k).alias(k) for k in ("signals", "useful", "specs")])


@query("f15_non_products", var(f"""SELECT id, CASE WHEN len(trim(model)) < 3 THEN 'too short' ELSE coalesce({case('trim(model)', rules.AGGRESSIVE)},
  CASE WHEN lower(trim(model)) IN ('s','hoists','products','trolleys','cranes','equipment') THEN 'generic word' END) END AS reason FROM varied"""))
def f15(spark, sf):
    return rules.non_product_reason(varied(spark, sf)).select("id", "reason")


@query("f15_drop_non_products", var(f"""SELECT id FROM varied WHERE len(trim(model)) >= 3 AND NOT {anym('trim(model)', rules.AGGRESSIVE)}
  AND lower(trim(model)) NOT IN ('s','hoists','products','trolleys','cranes','equipment')"""))
def f15_drop(spark, sf):
    return rules.drop_non_products(varied(spark, sf)).select("id")


@query("f16_final_cleanup", var(f"SELECT id, {case('trim(model)', rules.FINAL)} AS reason FROM varied"))
def f16(spark, sf):
    return rules.non_product_reason(varied(spark, sf), "final").select("id", "reason")


_SPECS = f"({_FILLED('loadCapacity')} OR {_FILLED('liftingSpeed')} OR {_FILLED('motorPower')})"


@query("f17_reject_reason", var(f"""SELECT id, CASE WHEN {anym('trim(model)', rules.DEEP_INVALID)} THEN 'invalidModel' WHEN NOT {_SPECS} AND {anym('trim(model)', rules.DEEP_CATEGORY)} THEN 'categoryPage'
  WHEN NOT ({_SPECS} OR coalesce(classification_raw, '') <> '' OR {_FILLED('dutyCycle')} OR {_FILLED('weight')}) THEN 'noSpecs'
  WHEN NOT {_SPECS} AND (len(trim(model)) < 3 OR regexp_matches(trim(model), '(?i)^[a-z]+$')) THEN 'tooShortModel' END AS reason FROM varied"""))
def f17(spark, sf):
    return varied(spark, sf).select("id", rules.reject_reason().alias("reason"))


_USES = "uses AS (SELECT url, count(*) AS n FROM varied WHERE url IS NOT NULL GROUP BY url)"


@query("f18_category_pages", var("""SELECT v.id FROM varied v LEFT JOIN uses u USING (url) WHERE contains(lower(model), 'category') OR contains(lower(model), 'view all') OR contains(lower(model), 'products')
  OR lower(model) IN ('hoists', 's') OR len(model) < 3 OR coalesce(u.n, 0) > 5""", _USES))
def f18(spark, sf):
    return rules.category_pages(varied(spark, sf)).select("id")


@query("f18_drop_category_pages", var("""SELECT v.id FROM varied v LEFT JOIN uses u USING (url) WHERE NOT (len(trim(model)) < 3 OR lower(trim(model)) IN ('hoists', 's') OR contains(lower(model), 'view all')
  OR contains(lower(model), 'category')) AND NOT (coalesce(v.url, '') <> '' AND u.n > 10)""", _USES))
def f18_drop(spark, sf):
    return rules.drop_category_pages(varied(spark, sf)).select("id")


NOW = "2001-06-01 00:00:00"


@query("f19_stale", raw(f"SELECT id FROM raw WHERE lastUpdated IS NULL OR lastUpdated < TIMESTAMP '{NOW}' - INTERVAL 90 DAY"))
def f19(spark, sf):
    return rules.stale(inputs.raw_catalog(spark, sf), NOW).select("id")


@query("f19_stale_by_vendor", raw(f"SELECT manufacturer, count(*) AS n FROM raw WHERE lastUpdated IS NULL OR lastUpdated < TIMESTAMP '{NOW}' - INTERVAL 90 DAY GROUP BY manufacturer"))
def f19_vendor(spark, sf):
    return rules.stale_by_vendor(inputs.raw_catalog(spark, sf), NOW)


_CAND = {
    "rescrape": "coalesce(loadCapacity, '') = '' AND coalesce(url, '') <> '' AND NOT contains(lower(model), 'category') AND NOT contains(lower(model), 'view all') AND regexp_matches(lower(model), 'hoist|chain|wire|winch|lift')",
    "images": r"n_images = 0 AND starts_with(url, 'http') AND len(regexp_replace(url, '^http://[^/]+', '')) > 2",
    "pdfs": "coalesce(loadCapacity, '') = '' AND n_pdfs > 0 AND n_downloads = 0",
    "unique_url": "coalesce(loadCapacity, '') = '' AND coalesce(url, '') <> '' AND (SELECT n FROM uses u WHERE u.url = varied.url) <= 3",
    "vendor_pdfs": "manufacturer = 'CM' AND n_pdfs > 0",
}
for _k, _w in _CAND.items():
    @query(f"f20_candidates_{_k}", var(f"SELECT id FROM varied WHERE {_w}", _USES))
    def f20(spark, sf, kind=_k):
        return rules.candidates(varied(spark, sf), kind, "CM").select("id")


@query("j12_url_fanout", var("SELECT v.id, coalesce(u.n, 0) AS url_count FROM varied v LEFT JOIN uses u USING (url)", _USES))
def j12(spark, sf):
    return rules.url_fanout(varied(spark, sf)).select("id", "url_count")
