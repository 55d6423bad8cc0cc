"""Filters, sorting, paging, navigation, suggestions and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import c
from ..operators import search, tidy
from . import inputs
from .oracle import bucket, cat
from .q_records import search_catalog as catalog
from .registry import query

Q = "(contains(lower(manufacturer), '{0}') OR contains(lower(model), '{0}') OR contains(lower(series), '{0}') OR contains(lower(loadCapacity), '{0}') OR contains(lower(array_to_string(cls, ' ')), '{0}'))"


def listed(name, where: str, pick):
    """Query that returns the ids a filter keeps."""
    @query(name, cat(f"SELECT id FROM catalog WHERE {where}"))
    def run(spark, sf):
        return pick(catalog(spark, sf)).select("id")


listed("f02_filter_catalog", "contains(lower(manufacturer), 'brand#1') AND contains(lower(model), 'red') AND len(list_filter(cls, lambda x: contains(x, 'd8'))) > 0 AND kg >= 500 AND kg <= 40000",
       lambda d: search.filter_catalog(d, "Brand#1", "RED", "D8", 500, 40000))
listed("f03_text_search", Q.format("widget"), lambda d: search.text_search(d, "Widget"))
listed("f04_capacity_range", "kg >= 1000", lambda d: search.capacity_range(d, lo=1000))
listed("f05_vendors_and_classes", "manufacturer IN ('Brand#4', 'Verlinde') AND list_has_any(cls, ['atex', 'd8'])",
       lambda d: search.any_class(search.vendors_in(d, ["Brand#4", "Verlinde"]), ["atex", "d8"]))
listed("f06_facets_full", Q.format("bolt") + " AND category = 'Winch' AND speedType = 'Variable Speed' AND dutyCycle = 'FEM 2m' AND list_contains(cls, 'd8+') AND " + bucket("kg") + " = '>2000 kg'",
       lambda d: search.facet_filter(d, q="bolt", category="Winch", speedType="Variable Speed", dutyCycle="FEM 2m", classification="d8+", capacity=">2000 kg"))
listed("f06_facets_complete", "manufacturer = 'Brand#4' AND coalesce(loadCapacity, '') NOT IN ('', '-') AND coalesce(liftingSpeed, '') NOT IN ('', '-') AND coalesce(motorPower, '') NOT IN ('', '-')",
       lambda d: search.facet_filter(d, manufacturer="Brand#4", dataQuality="complete"))
listed("f06_facets_images", "n_images > 0 AND " + bucket("kg") + " = '501-1000 kg'", lambda d: search.facet_filter(d, capacity="501-1000 kg", dataQuality="hasImages"))
listed("f06_facets_tier", "dataQualityTier = 'partial'", lambda d: search.facet_filter(d, dataQuality="tier-partial"))
listed("f07_class_alone_compat", "list_contains(list_transform(cls, lambda x: lower(x)), 'atex')", lambda d: search.facet_filter(d, classification="ATEX", compat=True))
listed("f07_class_combined_compat", "list_contains(cls, 'ATEX') AND manufacturer = 'Brand#4'", lambda d: search.facet_filter(d, classification="ATEX", manufacturer="Brand#4", compat=True))
listed("f09_export_filter", "contains(lower(manufacturer), 'brand#2') AND list_contains(cls, 'ce')", lambda d: search.export_filter(d, "brand#2", "CE"))
listed("f10_by_tier", "coalesce(nullif(dataQualityTier, ''), 'minimal') = 'incomplete'", lambda d: search.by_tier(d, "Incomplete"))
listed("f10_by_capacity_bucket", bucket("kg") + " = '1001-2000 kg'", lambda d: search.by_capacity_bucket(d, "1001-2000 kg"))
listed("u04_any_of", "list_has_any(cls, ['ansi', 'bgv-c1'])", lambda d: d.filter(search.any_of("classification", ["ansi", "bgv-c1"])))


@query("a29_facet_count", cat("SELECT count(*) AS count FROM catalog WHERE manufacturer = 'Brand#4' AND list_contains(cls, 'd8')"))
def a29(spark, sf):
    return search.facet_count(catalog(spark, sf), manufacturer="Brand#4", classification="d8")


# -- order and pages ----------------------------------------------------------------------------------------------

@query("w02_sort_paginate", cat("SELECT id, row_number() OVER (ORDER BY coalesce(kg, 0) DESC, _pos) AS rn FROM catalog ORDER BY coalesce(kg, 0) DESC, _pos LIMIT 50 OFFSET 100"))
def w02(spark, sf):
    page = search.paginate(catalog(spark, sf), page=3, limit=50, by="capacity", order="desc")
    from pyspark.sql import Window

    w = Window.orderBy(*search.sort_order("capacity", "desc"))  # one page of 50 rows
    return page.withColumn("rn", (F.row_number().over(w) + 100).cast("long")).select("id", "rn")


@query("w02_sort_text", cat("SELECT id FROM catalog ORDER BY coalesce(dutyCycle, ''), _pos LIMIT 30"))
def w02_text(spark, sf):
    return search.paginate(catalog(spark, sf), 1, 30, "dutyCycle").select("id")


@query("w03_sort_collated", cat("SELECT id FROM catalog ORDER BY lower(model), _pos LIMIT 40 OFFSET 40"))
def w03(spark, sf):
    d = catalog(spark, sf).withColumn("model", F.lower("model"))
    return search.paginate(d, 2, 40, "model", collate=True, default_limit=25).select("id")


@query("w04_paginate_defaults", cat("SELECT id FROM catalog WHERE kg IS NOT NULL ORDER BY _pos LIMIT 50"))
def w04(spark, sf):
    return search.paginate(search.capacity_range(catalog(spark, sf)), 0, 0).select("id")


@query("w04_paginate_negative", cat("SELECT id FROM (SELECT id, _pos FROM catalog ORDER BY _pos DESC LIMIT 50 OFFSET 50) ORDER BY _pos"))
def w04_negative(spark, sf):
    return search.paginate(catalog(spark, sf), -1, 50).select("id")


@query("w04_page_info", cat("""SELECT count(*) AS total, CAST(2 AS INT) AS page, CAST(25 AS INT) AS "limit", CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages,
  2 < ceil(count(*) / 25.0) AS has_next, true AS has_prev FROM catalog WHERE kg > 1000"""))
def w04_info(spark, sf):
    return search.page_info(search.capacity_range(catalog(spark, sf), 1000.0000001), 2, 25)


_NAV = """r AS (SELECT id, row_number() OVER w AS position, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, count(*) OVER () AS total
  FROM catalog WHERE manufacturer = 'Brand#4' WINDOW w AS (ORDER BY coalesce(kg, 0) DESC, _pos))"""


@query("w01_navigate", cat(f"SELECT prev_id, next_id, position, total FROM r WHERE id = 'p-112' UNION ALL SELECT NULL, (SELECT id FROM r WHERE position = 1), 1, count(*) FROM r WHERE (SELECT count(*) FROM r WHERE id = 'p-112') = 0 HAVING (SELECT count(*) FROM r WHERE id = 'p-112') = 0", _NAV))
def w01(spark, sf):
    return search.navigate(search.facet_filter(catalog(spark, sf), manufacturer="Brand#4"), "p-112", "capacity", "desc")


@query("w01_navigate_outside", cat("SELECT NULL AS prev_id, (SELECT id FROM r WHERE position = 1) AS next_id, CAST(1 AS BIGINT) AS position, count(*) AS total FROM r", _NAV))
def w01_outside(spark, sf):
    return search.navigate(search.facet_filter(catalog(spark, sf), manufacturer="Brand#4"), "nowhere", "capacity", "desc")


@query("w01_navigate_all", cat("SELECT id, position, prev_id, next_id FROM r", _NAV.replace(" WHERE manufacturer = 'Brand#4'", "")))
def w01_all(spark, sf):
    return search.navigate_all(catalog(spark, sf), "capacity", "desc")


@query("w05_suggest", cat("""SELECT * FROM (SELECT 'manufacturer' AS type, manufacturer AS value, manufacturer AS label, count(*) AS count FROM catalog WHERE contains(lower(manufacturer), 'er') GROUP BY manufacturer)
  UNION ALL SELECT 'classification', x, upper(x), n FROM (SELECT x, sum(count(*)) OVER (PARTITION BY lower(x)) AS n FROM (SELECT unnest(cls) AS x FROM catalog) WHERE contains(lower(x), 'er') GROUP BY x)
  UNION ALL SELECT 'product', id, manufacturer || ' ' || model, NULL FROM (SELECT manufacturer, model, arg_min(id, _pos) AS id, min(_pos) AS p FROM catalog
    WHERE contains(lower(model), 'er') OR contains(lower(series), 'er') GROUP BY manufacturer, model ORDER BY p LIMIT 5)"""))
def w05(spark, sf):
    return search.suggest(catalog(spark, sf), "ER", 20, 5)


@query("w06_top_k", cat("SELECT manufacturer, id, rank FROM (SELECT manufacturer, id, CAST(row_number() OVER (PARTITION BY manufacturer ORDER BY coalesce(kg, 0) DESC, _pos) AS INT) AS rank FROM catalog) WHERE rank <= 3"))
def w06(spark, sf):
    d = catalog(spark, sf).withColumn("_k", search.sort_key("capacity"))
    return tidy.top_k(d, ["manufacturer"], [c("_k").desc(), c("_pos")], 3).select("manufacturer", "id", "rank")


@query("w07_order_media", f"""WITH docs AS ({inputs.DOCS_SQL}) SELECT p[2] AS page, CAST(p[4] AS INT) AS index, filename FROM (SELECT filename, string_split(replace(filename, '.pdf', ''), '_') AS p FROM docs)""")
def w07(spark, sf):
    from ..functions.names import parse_media_name

    d = inputs.doc_files(spark, sf).withColumn("m", parse_media_name("filename"))
    return search.order_media(d.select(c("m.product").alias("page"), c("m.index").alias("index"), "filename"))


@query("w08_top_vendors", cat("SELECT manufacturer, count(*) AS n FROM catalog GROUP BY manufacturer ORDER BY n DESC, manufacturer LIMIT 5"))
def w08(spark, sf):
    from ..operators.reports import top_vendors

    return top_vendors(catalog(spark, sf), 5)


# -- lookups ------------------------------------------------------------------------------------------------------

@query("j13_compare", cat("SELECT CAST(request_pos AS INT) AS request_pos, v.id, manufacturer, model, loadCapacity FROM (VALUES (1, 'p-17'), (3, 'p-4'), (4, 'p-150')) v(request_pos, id) JOIN catalog c ON c.id = v.id"))
def j13(spark, sf):
    return search.compare(catalog(spark, sf), ["p-17", "unknown", "p-4", "p-150"]).select("request_pos", "id", "manufacturer", "model", "loadCapacity")


@query("j13_compare_table", cat("""SELECT CAST(i AS INT) AS field_pos, field, (SELECT CASE i WHEN 0 THEN manufacturer WHEN 1 THEN loadCapacity ELSE CAST(dataCompleteness AS VARCHAR) END FROM catalog WHERE id = 'p-17') AS "1",
  (SELECT CASE i WHEN 0 THEN manufacturer WHEN 1 THEN loadCapacity ELSE CAST(dataCompleteness AS VARCHAR) END FROM catalog WHERE id = 'p-4') AS "2"
  FROM (VALUES (0, 'manufacturer'), (1, 'loadCapacity'), (2, 'dataCompleteness')) f(i, field)"""))
def j13_table(spark, sf):
    return search.compare_table(catalog(spark, sf), ["p-17", "p-4"], ["manufacturer", "loadCapacity", "dataCompleteness"])


@query("j14_get", cat("SELECT id, manufacturer, model FROM catalog WHERE id = 'p-77'"))
def j14(spark, sf):
    return search.get(catalog(spark, sf), "p-77").select("id", "manufacturer", "model")


@query("j15_similar", cat("SELECT id FROM catalog WHERE manufacturer = (SELECT manufacturer FROM catalog WHERE id = 'p-77') AND id <> 'p-77' ORDER BY _pos LIMIT 5"))
def j15(spark, sf):
    return search.similar(catalog(spark, sf), "p-77").select("id")


@query("j15_similar_all", cat("""SELECT a.id, CAST(r AS INT) AS rank, b.id AS similar_id FROM catalog a, LATERAL (
  SELECT id, row_number() OVER (ORDER BY _pos) AS r FROM catalog c WHERE c.manufacturer = a.manufacturer AND c.id <> a.id) b WHERE r <= 5"""))
def j15_all(spark, sf):
    return search.similar_all(catalog(spark, sf))
