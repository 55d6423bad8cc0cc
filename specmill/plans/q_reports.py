"""Profile reports."""

from __future__ import annotations

from ..functions.names import parse_media_name
from ..functions.text import c
from ..operators import reports
from . import inputs
from .oracle import bucket, cat, num, raw
from .q_records import catalog
from .q_rules import NOW
from .registry import query

SET = lambda x: f"coalesce({x}, '') <> ''"
_F = {"loadCapacity": SET("loadCapacity"), "liftingSpeed": SET("liftingSpeed"), "motorPower": SET("motorPower"), "classification": "len(cls) > 0",
      "series": SET("series"), "url": SET("url"), "weight": SET("weight"), "dimensions": SET("dimensions"), "images": "n_images > 0", "pdfs": "n_pdfs > 0",
      "voltageOptions": "voltage_raw IS NOT NULL", "dutyCycle": SET("dutyCycle")}


@query("a18_stats_report", cat(f"""SELECT 'summary' AS section, 'totalRecords' AS key, count(*) AS n, CAST(NULL AS DOUBLE) AS pct FROM catalog
  UNION ALL SELECT 'summary', 'manufacturers', count(DISTINCT manufacturer), NULL FROM catalog
  UNION ALL SELECT 'summary', 'uniqueModels', count(DISTINCT (manufacturer, model)), NULL FROM catalog
  UNION ALL SELECT 'manufacturer', manufacturer, count(*), NULL FROM catalog GROUP BY manufacturer
  UNION ALL SELECT 'classification', x, count(*), NULL FROM (SELECT unnest(cls) AS x FROM catalog) GROUP BY x
  UNION ALL SELECT 'capacity', {bucket('kg', 'tight')}, count(*), NULL FROM catalog WHERE kg IS NOT NULL GROUP BY 2 UNION ALL """
  + " UNION ALL ".join(f"SELECT 'completeness', '{k}', count(*) FILTER ({_F[k]}), round(count(*) FILTER ({_F[k]}) * 100.0 / count(*), 1) FROM catalog" for k in reports.STATS_FIELDS)))
def a18(spark, sf):
    return reports.stats_report(catalog(spark, sf)).withColumn("n", c("n").cast("long"))


_STALE = f"lastUpdated IS NULL OR lastUpdated < TIMESTAMP '{NOW}' - INTERVAL 90 DAY"
_HEALTH = "floor((avg((" + SET("loadCapacity") + ")::INT) + avg((" + SET("liftingSpeed") + ")::INT) + avg((len(cls) > 0)::INT)) / 3 * 100 + 0.5)"


@query("a19_health_report", cat(" UNION ALL ".join(
    [f"SELECT '{k}' AS item, count(*) FILTER ({_F[k]}) AS n, round(count(*) FILTER ({_F[k]}) * 100.0 / count(*), 1) AS pct FROM catalog" for k in reports.HEALTH_FIELDS]
    + ["SELECT 'total', count(*), NULL FROM catalog", f"SELECT 'stale', count(*) FILTER ({_STALE}), round(count(*) FILTER ({_STALE}) * 100.0 / count(*), 1) FROM catalog",
       f"SELECT 'health', CAST({_HEALTH} AS BIGINT), NULL FROM catalog",
       f"SELECT 'advice: scrape capacity', CAST({_HEALTH} < 50 AND avg(({_F['loadCapacity']})::INT) < 0.5 AS BIGINT), NULL FROM catalog",
       f"SELECT 'advice: scrape images', CAST({_HEALTH} < 50 AND avg((n_images > 0)::INT) < 0.3 AS BIGINT), NULL FROM catalog",
       f"SELECT 'advice: rescrape stale', CAST({_HEALTH} < 50 AND count(*) FILTER ({_STALE}) > 0.3 * count(*) AS BIGINT), NULL FROM catalog",
       "SELECT * FROM (SELECT 'vendor: ' || manufacturer, count(*) AS n, NULL FROM catalog GROUP BY manufacturer ORDER BY n DESC, manufacturer LIMIT 10)"])))
def a19(spark, sf):
    return reports.health_report(catalog(spark, sf), NOW, 10)


@query("a20_inventory_stats", cat(f"""SELECT 'total' AS section, 'rows' AS key, count(*) AS n, CAST(NULL AS DOUBLE) AS pct FROM catalog UNION ALL SELECT 'manufacturer', manufacturer, count(*), NULL FROM catalog GROUP BY manufacturer
  UNION ALL SELECT 'capacity', k.b, count(c.b), round(count(c.b) * 100.0 / (SELECT count(*) FROM catalog), 1) FROM (VALUES ('≤250kg'), ('251-500kg'), ('501-1000kg'), ('1001-2000kg'), ('>2000kg')) k(b)
    LEFT JOIN (SELECT {bucket(num('loadCapacity', '([0-9]+)'), 'tight')} AS b FROM catalog) c ON c.b = k.b GROUP BY k.b"""))
def a20(spark, sf):
    return reports.inventory_stats(catalog(spark, sf))


_SUM = {"total": "count(*)", "manufacturers": "count(DISTINCT manufacturer)", "withImages": "count(*) FILTER (n_images > 0)", "withPdfs": "count(*) FILTER (n_pdfs > 0)",
        "withCapacity": f"count(*) FILTER ({_F['loadCapacity']})", "withSpeed": f"count(*) FILTER ({_F['liftingSpeed']})"}


@query("a22_summary", cat(" UNION ALL ".join([f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS value FROM catalog" for k, v in _SUM.items()]
                                             + [f"SELECT '{k}Pct', round({_SUM[k]} * 100.0 / count(*), 1) FROM catalog" for k in ("withImages", "withPdfs", "withCapacity", "withSpeed")])))
def a22(spark, sf):
    return reports.summary(catalog(spark, sf))


_LEAD = f"(CASE WHEN coalesce(loadCapacity, '') = '' THEN 0 ELSE {num('loadCapacity', '^([0-9]+)')} END)"


@query("a24_merged_distributions", raw(f"""SELECT 'category' AS section, coalesce(nullif(category, ''), 'Unknown') AS key, count(*) AS n FROM raw GROUP BY 2
  UNION ALL SELECT 'speedType', coalesce(nullif(speedType, ''), 'Unknown'), count(*) FROM raw GROUP BY 2
  UNION ALL SELECT 'source', k.s, count(r.s) FROM (VALUES ('web'), ('personality')) k(s) LEFT JOIN (SELECT CASE WHEN source = 'personality' THEN source ELSE 'web' END AS s FROM raw) r ON r.s = k.s GROUP BY k.s
  UNION ALL SELECT 'capacity', k.b, count(r.b) FROM (VALUES ('≤250 kg'), ('251-500 kg'), ('501-1000 kg'), ('1001-2000 kg'), ('>2000 kg')) k(b) LEFT JOIN (SELECT {bucket(_LEAD)} AS b FROM raw) r ON r.b = k.b GROUP BY k.b"""))
def a24(spark, sf):
    return reports.merged_distributions(inputs.raw_catalog(spark, sf))


@query("a25_missing_capacity", raw("SELECT manufacturer, count(*) AS n, count(*) FILTER (coalesce(url, '') <> '') AS with_url FROM raw WHERE coalesce(loadCapacity, '') = '' GROUP BY manufacturer"))
def a25(spark, sf):
    return reports.missing_capacity(inputs.raw_catalog(spark, sf))


@query("a25_missing_members", raw("""SELECT manufacturer, id, CASE WHEN coalesce(url, '') <> '' THEN 'Y' ELSE 'N' END AS has_url, n_pdfs, count(*) OVER (PARTITION BY manufacturer) AS group_size
  FROM raw WHERE coalesce(loadCapacity, '') = ''"""))
def a25_members(spark, sf):
    return reports.missing_capacity_members(inputs.raw_catalog(spark, sf)).select("manufacturer", "id", "has_url", "n_pdfs", "group_size")


@query("a26_coverage", cat("SELECT 'signals' AS section, 'total' AS key, count(*) AS n FROM catalog UNION ALL " + " UNION ALL ".join(
    f"SELECT 'signals', '{k}', count(*) FILTER ({_F[k]}) FROM catalog" for k in reports.COVERAGE) + f""" UNION ALL SELECT 'signals', 'pdfExtracted', 0
  UNION ALL SELECT 'signals', 'missingCapacity', count(*) FILTER (NOT ({_F['loadCapacity']})) FROM catalog
  UNION ALL SELECT * FROM (SELECT 'classes', x, count(*) AS n FROM (SELECT unnest(cls) AS x FROM catalog) GROUP BY x)
  UNION ALL SELECT * FROM (SELECT 'vendors', manufacturer, count(*) AS n FROM catalog WHERE {_F['loadCapacity']} GROUP BY manufacturer)"""))
def a26(spark, sf):
    return reports.coverage(catalog(spark, sf))


_CAP = _F["loadCapacity"]
_DOCS = {"capacityWithDocs": f"{_CAP} AND n_downloads > 0", "linksNotExtracted": "n_pdfs > 0", "missingCapacity": f"NOT ({_CAP})", "missingWithLinks": f"NOT ({_CAP}) AND n_pdfs > 0",
         "missingDownloaded": f"NOT ({_CAP}) AND n_downloads > 0", "needDownload": f"NOT ({_CAP}) AND n_pdfs > 0 AND n_downloads = 0", "withCapacity": _CAP}


@query("a27_doc_coverage", raw(" UNION ALL ".join(f"SELECT 'counts' AS section, '{k}' AS key, count(*) FILTER ({v}) AS n FROM raw" for k, v in _DOCS.items())
  + f" UNION ALL SELECT 'vendors', manufacturer, count(*) FROM raw WHERE {_CAP} AND n_downloads > 0 GROUP BY manufacturer"))
def a27(spark, sf):
    return reports.doc_coverage(inputs.raw_catalog(spark, sf))


@query("a28_media_by_vendor", f"""WITH docs AS ({inputs.DOCS_SQL}), r AS ({inputs.CATALOG_SQL}) SELECT 'vendor' AS section, string_split(filename, '_')[1] AS key, count(*) AS n FROM docs GROUP BY 2
  UNION ALL SELECT 'total', 'files', count(*) FROM docs UNION ALL SELECT 'total', 'productsWithPdfs', count(*) FROM r WHERE n_pdfs > 0""")
def a28(spark, sf):
    files = inputs.doc_files(spark, sf).select("filename", parse_media_name("filename")["vendor"].alias("vendor"))
    return reports.media_by_vendor(files, inputs.raw_catalog(spark, sf)).withColumn("n", c("n").cast("long"))


@query("a35_hot_urls", raw("SELECT url, count(*) AS n FROM raw WHERE coalesce(url, '') <> '' GROUP BY url HAVING count(*) > 3"))
def a35(spark, sf):
    return reports.hot_urls(inputs.raw_catalog(spark, sf))
