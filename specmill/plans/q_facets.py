"""Facet lists, counts and catalogue statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets
from . import inputs
from .oracle import NUM, bucket, cat, num, power_bucket, speed_bucket
from .q_records import catalog
from .registry import query

TRUE = "coalesce({0}, '') <> ''"
SPECS_C = "(coalesce(loadCapacity, '') NOT IN ('', '-') AND coalesce(liftingSpeed, '') NOT IN ('', '-') AND coalesce(motorPower, '') NOT IN ('', '-'))"


@query("a01_vendor_stats", cat("SELECT manufacturer AS name, count(*) AS count, count(DISTINCT nullif(model, '')) AS models FROM catalog GROUP BY manufacturer"))
def a01(spark, sf):
    return facets.vendor_stats(catalog(spark, sf)).withColumn("count", F.col("count").cast("long"))


@query("a02_class_stats", cat("SELECT name, count(*) AS count FROM (SELECT unnest(cls) AS name FROM catalog) GROUP BY name"))
def a02(spark, sf):
    return facets.class_stats(catalog(spark, sf))


@query("a03_capacity_range", cat("SELECT coalesce(min(kg), 0) AS min, coalesce(max(kg), 0) AS max FROM catalog"))
def a03(spark, sf):
    return facets.capacity_range_stats(catalog(spark, sf))


RATIOS = {"loadCapacity": "kg IS NOT NULL", "liftingSpeed": TRUE.format("liftingSpeed"), "motorPower": TRUE.format("motorPower"),
          "classification": "true", "hasImages": "n_images > 0", "hasCompleteSpecs": SPECS_C}


@query("a04_presence_ratios", cat(" UNION ALL ".join(f"SELECT '{k}' AS metric, round(avg(({v})::INT), 9) AS value FROM catalog" for k, v in RATIOS.items())))
def a04(spark, sf):
    return facets.presence_ratios(catalog(spark, sf)).withColumn("value", F.round("value", 9))


@query("a05_facet_values", cat("""SELECT DISTINCT 'manufacturer' AS facet, manufacturer AS value FROM catalog
  UNION SELECT 'dutyCycle', dutyCycle FROM catalog WHERE dutyCycle <> '' UNION SELECT 'category', category FROM catalog WHERE category NOT IN ('', 'Unknown')
  UNION SELECT 'speedType', speedType FROM catalog WHERE speedType NOT IN ('', 'Unknown') UNION SELECT 'tier', dataQualityTier FROM catalog
  UNION SELECT 'classification', unnest(cls) FROM catalog"""))
def a05(spark, sf):
    return facets.facet_values(catalog(spark, sf))


@query("a06_facet_counts", cat(f"""SELECT k.facet, k.bucket, count(p.facet) AS n FROM (VALUES ('tier','complete'),('tier','partial'),('tier','incomplete'),('tier','minimal'),
  ('capacity','≤250 kg'),('capacity','251-500 kg'),('capacity','501-1000 kg'),('capacity','1001-2000 kg'),('capacity','>2000 kg'),
  ('speed','<2 m/min'),('speed','2-4 m/min'),('speed','4-8 m/min'),('speed','≥8 m/min')) k(facet, bucket)
  LEFT JOIN (SELECT 'tier' AS facet, dataQualityTier AS bucket FROM catalog UNION ALL SELECT 'capacity', {bucket('kg')} FROM catalog
             UNION ALL SELECT 'speed', {speed_bucket('mpm')} FROM catalog) p ON p.facet = k.facet AND p.bucket = k.bucket GROUP BY k.facet, k.bucket"""))
def a06(spark, sf):
    return facets.facet_counts(catalog(spark, sf))


@query("a06_index_sizes", cat(f"""SELECT 'byId' AS index, count(DISTINCT id) AS size FROM catalog UNION ALL SELECT 'byManufacturer', count(DISTINCT manufacturer) FROM catalog
  UNION ALL SELECT 'byClassification', count(DISTINCT lower(x)) FROM (SELECT unnest(cls) AS x FROM catalog)
  UNION ALL SELECT 'hasImages', count(*) FROM catalog WHERE n_images > 0 UNION ALL SELECT 'hasCompleteSpecs', count(*) FROM catalog WHERE {SPECS_C}
  UNION ALL SELECT 'parsedCapacities', count(*) FROM catalog WHERE {TRUE.format('loadCapacity')} UNION ALL SELECT 'parsedSpeeds', count(*) FROM catalog WHERE {TRUE.format('liftingSpeed')}"""))
def a06_sizes(spark, sf):
    return facets.index_sizes(catalog(spark, sf))


@query("a07_db_stats", cat("""SELECT 'totalRecords' AS metric, CAST(count(*) AS DOUBLE) AS value FROM catalog UNION ALL SELECT 'manufacturers', count(DISTINCT manufacturer) FROM catalog
  UNION ALL SELECT 'classifications', count(DISTINCT x) FROM (SELECT unnest(cls) AS x FROM catalog) UNION ALL SELECT 'capacityMin', min(kg) FROM catalog
  UNION ALL SELECT 'capacityMax', max(kg) FROM catalog UNION ALL SELECT 'lastUpdatedMs', epoch_ms(max(lastUpdated)) FROM catalog UNION ALL """
  + " UNION ALL ".join(f"SELECT '{k}', round(avg(({v})::INT), 9) FROM catalog" for k, v in RATIOS.items())))
def a07(spark, sf):
    return facets.db_stats(catalog(spark, sf)).withColumn("value", F.round("value", 9))


_D = {"loadCapacity": "coalesce(loadCapacity, '') NOT IN ('', '-', 'Not specified')", "liftingSpeed": "coalesce(liftingSpeed, '') NOT IN ('', '-', 'Not specified')",
      "motorPower": "coalesce(motorPower, '') NOT IN ('', '-', 'Not specified')", "weight": "coalesce(weight, '') NOT IN ('', '-', 'Not specified', 'Not visible')",
      "dimensions": "coalesce(dimensions, '') NOT IN ('', '-', 'Not specified', 'Not visible')", "classification": "len(cls) > 0", "images": "n_images > 0",
      "pdfs": "n_pdfs > 0 OR n_downloads > 0", "url": "coalesce(url, '') NOT IN ('', '-')"}


@query("a08_field_completeness", cat(" UNION ALL ".join(f"SELECT '{k}' AS field, count(*) FILTER ({v}) AS count, round(count(*) FILTER ({v}) * 100.0 / count(*), 1) AS pct FROM catalog" for k, v in _D.items())))
def a08(spark, sf):
    return facets.field_completeness(catalog(spark, sf))


_MMIN = num("liftingSpeed", "(?i)" + NUM + r"\s*m/min")


@query("a09_distributions", cat(f"""SELECT facet, bucket, count(*) AS n FROM (SELECT 'capacity' AS facet, {bucket('kg')} AS bucket FROM catalog UNION ALL SELECT 'power', {power_bucket('motorPower')} FROM catalog
  UNION ALL SELECT 'speed', {speed_bucket(_MMIN, '>8 m/min')} FROM catalog) WHERE bucket IS NOT NULL GROUP BY facet, bucket"""))
def a09(spark, sf):
    return facets.distributions(catalog(spark, sf))


@query("a10_processing_report", cat(f"""SELECT 'records' AS section, 'total' AS key, count(*) AS n FROM raw UNION ALL SELECT 'records', 'processed', count(*) FROM catalog
  UNION ALL SELECT 'records', 'skipped', (SELECT count(*) FROM raw) - (SELECT count(*) FROM catalog)
  UNION ALL SELECT 'manufacturer', manufacturer, count(*) FROM catalog GROUP BY manufacturer
  UNION ALL SELECT 'capacity', {bucket('kg')}, count(*) FROM catalog WHERE kg IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'classification', x, count(*) FROM (SELECT unnest(cls) AS x FROM catalog) GROUP BY x"""))
def a10(spark, sf):
    return facets.processing_report(inputs.raw_catalog(spark, sf), catalog(spark, sf))


@query("a34_home_facets", cat("""SELECT 'manufacturer' AS facet, name, count FROM v WHERE r <= 5 UNION ALL SELECT 'manufacturer', '(others)', count(*) FROM v WHERE r > 5
  UNION ALL SELECT 'classification', name, count FROM k WHERE r <= 6 UNION ALL SELECT 'classification', '(others)', count(*) FROM k WHERE r > 6""",
  """v AS (SELECT manufacturer AS name, count(*) AS count, row_number() OVER (ORDER BY manufacturer COLLATE NOCASE) AS r FROM catalog GROUP BY manufacturer),
  k AS (SELECT name, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, name) AS r FROM (SELECT unnest(cls) AS name FROM catalog) GROUP BY name)"""))
def a34(spark, sf):
    return facets.home_facets(catalog(spark, sf)).withColumn("count", F.col("count").cast("long"))
