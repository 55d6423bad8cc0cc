"""Device records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import num_or_null
from ..functions.text import c
from ..operators import devices, linkage, search
from . import inputs
from .oracle import dev, f
from .q_scalars import _DFPM, _DKG, _DSPEED, DEV_CATEGORY, DEV_HI, DEV_LO, DEV_MODEL, DEV_SPEED, ENT
from .registry import query

_BRAND = "CASE " + " ".join(f"WHEN contains(lower(manufacturer), '{p.lower()}') THEN '{b}'" for p, b, _ in linkage.BRANDS) + " END"
_SITE = "CASE " + " ".join(f"WHEN contains(lower(manufacturer), '{p.lower()}') THEN '{w}'" for p, _, w in linkage.BRANDS) + " END"
DEVICES = f"""named AS (SELECT d.*, m."fullName", coalesce(trim(regexp_replace(m."fullName", '^\\d+\\s*-\\s*', '')), 'Unknown (' || d."manufacturerId" || ')') AS manufacturer FROM devices_raw d LEFT JOIN makers m ON d."manufacturerId" = m."manufacturerId"),
  devices AS (SELECT *, {DEV_MODEL} AS model, {DEV_CATEGORY} AS category, {DEV_SPEED} AS "speedType", ({f(ENT, 'manufacturer')}) AS ent, {_BRAND} AS brand, {_SITE} AS site,
    CASE WHEN "fullName" IS NULL THEN 'Unknown' ELSE manufacturer END || ' ' || {DEV_MODEL} || ' electric chain hoist specifications' AS q,
    {_DKG} AS kg, {_DSPEED} AS mpm, {_DFPM} AS fpm, {DEV_LO} AS lo, {DEV_HI} AS hi, nullif(TRY_CAST(underloadRaw AS DOUBLE), 0) AS under, nullif(TRY_CAST(overloadRaw AS DOUBLE), 0) AS over_,
    nullif(TRY_CAST(encoderRaw AS DOUBLE), 0) AS enc FROM named)"""


def dv(body: str) -> str:
    return dev(body, DEVICES)


def device_rows(spark, sf):
    d = devices.parse_devices(inputs.raw_devices(spark, sf))
    d = d.withColumns({"minSpeed": num_or_null("minSpeedRaw"), "maxSpeed": num_or_null("maxSpeedRaw"), "underloadLimit": num_or_null("underloadRaw"),
                       "overloadLimit": num_or_null("overloadRaw"), "encoderScaling": num_or_null("encoderRaw")})
    return devices.enrich_devices(d, inputs.makers(spark, sf))


@query("j01_with_maker", dv('SELECT "productId" AS id, manufacturer, "fullName" FROM devices'))
def j01(spark, sf):
    return device_rows(spark, sf).select(c("productId").alias("id"), "manufacturer", c("manufacturerFullName").alias("fullName"))


@query("j02_with_brand", dv('SELECT "productId" AS id, brand, site FROM devices'))
def j02(spark, sf):
    return device_rows(spark, sf).select(c("productId").alias("id"), c("manufacturerBrand").alias("brand"), c("manufacturerWebsite").alias("site"))


@query("e01_enrich_devices", dv('SELECT "productId" AS id, model, category, "speedType", ent, brand, q FROM devices'))
def e01(spark, sf):
    return device_rows(spark, sf).select(c("productId").alias("id"), "model", "category", "speedType", c("entertainmentIndustry").alias("ent"),
                                         c("manufacturerBrand").alias("brand"), c("searchQuery").alias("q"))


@query("f08_device_filter", dv("""SELECT "productId" AS id FROM devices WHERE contains(lower(manufacturer), 'gis') AND lower(category) = 'winch' AND ent"""))
def f08(spark, sf):
    return search.device_filter(device_rows(spark, sf), "GIS", "WINCH", entertainment_only=True).select(c("productId").alias("id"))


@query("f08_device_page_filter", dv("""SELECT "productId" AS id FROM devices WHERE category = 'Beam Trolley' AND (contains(lower(name), 'red') OR contains(lower(manufacturer), 'red') OR contains(lower(model), 'red'))"""))
def f08_page(spark, sf):
    return search.device_page_filter(device_rows(spark, sf), category="Beam Trolley", q="Red").select(c("productId").alias("id"))


@query("a23_device_summary", dv("""SELECT 'category' AS section, k.x AS key, count(d.category) AS n FROM (VALUES ('Electric Chain Hoist'), ('Beam Trolley'), ('Winch'), ('Revolve/Turntable'), ('Flying System')) k(x) LEFT JOIN devices d ON d.category = k.x GROUP BY k.x
  UNION ALL SELECT 'speedType', k.x, count(d.category) FROM (VALUES ('Variable Speed'), ('Fixed Speed'), ('Unknown')) k(x) LEFT JOIN devices d ON d."speedType" = k.x GROUP BY k.x
  UNION ALL SELECT 'total', 'products', count(*) FROM devices UNION ALL SELECT 'flag', 'entertainment', count(*) FROM devices WHERE ent
  UNION ALL SELECT 'manufacturer', manufacturer, count(*) FROM devices GROUP BY manufacturer UNION ALL SELECT 'total', 'manufacturers', count(DISTINCT manufacturer) FROM devices"""))
def a23(spark, sf):
    return devices.device_summary(device_rows(spark, sf))


@query("a33_search_queries", dv('SELECT q AS "searchQuery", min(_pos) AS first_pos FROM devices GROUP BY q'))
def a33(spark, sf):
    return devices.search_queries(device_rows(spark, sf))


@query("s55_device_to_catalog", dv("""SELECT 'personality-' || "manufacturerId" || '-' || "productId" AS id, coalesce(brand, manufacturer, 'Unknown') AS manufacturer, CASE WHEN model = '' THEN name ELSE model END AS model, manufacturer AS series,
  CAST(kg AS BIGINT)::VARCHAR || ' kg' AS "loadCapacity", CAST(mpm AS BIGINT)::VARCHAR || ' m/min' AS "liftingSpeed", CASE WHEN ent THEN 'entertainment|' ELSE '' END || replace(lower("speedType"), ' ', '-') AS classes, site AS url,
  "speedType" = 'Variable Speed' AS dynamic, ent AS "liftingOverPeople", enc IS NOT NULL AS has_encoder, CAST(0.95 AS DOUBLE) AS confidence, 'personality' AS source FROM devices"""))
def s55(spark, sf):
    d = devices.device_to_catalog(device_rows(spark, sf))
    return d.select("id", "manufacturer", "model", "series", "loadCapacity", "liftingSpeed", F.array_join("classification", "|").alias("classes"), "url",
                    c("dynamicLifting").alias("dynamic"), "liftingOverPeople", (F.size("positionFeedback") > 0).alias("has_encoder"), "confidence", "source")


@query("j14_get_device", dv("""SELECT "productId" AS id, name FROM devices WHERE "manufacturerId" = (SELECT "manufacturerId" FROM devices WHERE "productId" = '55') AND "productId" = '55'"""))
def j14_device(spark, sf):
    d = device_rows(spark, sf)
    mid = d.filter("productId = '55'").agg(F.max("manufacturerId")).scalar()
    return search.get_device(d, mid, "55").select(c("productId").alias("id"), "name")


@query("j15_similar_devices", dv("""SELECT v.manufacturer, v."manufacturerId", CAST(r AS INT) AS rank, x.sid AS similar_id FROM (SELECT DISTINCT 'V' || CAST(length(name) % 7 AS VARCHAR) AS manufacturer, "manufacturerId" FROM devices) v, LATERAL (
   SELECT "manufacturerId" || '-' || "productId" AS sid, row_number() OVER (ORDER BY _pos) AS r FROM devices d WHERE 'V' || CAST(length(d.name) % 7 AS VARCHAR) = v.manufacturer AND d."manufacturerId" <> v."manufacturerId") x WHERE r <= 5"""))
def j15_devices(spark, sf):
    d = device_rows(spark, sf).withColumn("manufacturer", F.concat(F.lit("V"), (F.length("name") % 7).cast("string")))
    return search.similar_devices(d)


def _t(x: str) -> str:
    return f"CASE WHEN coalesce({x}, 0) = 0 THEN '' WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


@query("snk5_device_report", dv(f"""SELECT manufacturer AS "Manufacturer", name AS "Name", model AS "Model", {_t('kg')} AS "Load Capacity (kg)", {_t('mpm')} AS "Lifting Speed (m/min)", {_t('fpm')} AS "Lifting Speed (fpm)", {_t('lo')} AS "Min Speed", {_t('hi')} AS "Max Speed",
  '' AS "Default Speed", '' AS "Default Accel", '' AS "Default Decel", {_t('under')} AS "Underload Limit", {_t('over_')} AS "Overload Limit", {_t('enc')} AS "Encoder Scaling", '' AS "Loadcell Scaling", q AS "Search Query" FROM devices"""))
def snk5(spark, sf):
    return devices.device_report(device_rows(spark, sf))


@query("snk5_device_enriched_report", dv(f"""SELECT manufacturer AS "Manufacturer", coalesce(brand, '') AS "Brand", name AS "Name", model AS "Model", category AS "Category", "speedType" AS "Speed Type", CASE WHEN ent THEN 'Yes' ELSE 'No' END AS "Entertainment Industry",
  {_t('kg')} AS "Load Capacity (kg)", {_t('mpm')} AS "Lifting Speed (m/min)", {_t('fpm')} AS "Lifting Speed (fpm)", {_t('lo')} AS "Min Speed", {_t('hi')} AS "Max Speed", '' AS "Default Speed", {_t('under')} AS "Underload Limit", {_t('over_')} AS "Overload Limit",
  {_t('enc')} AS "Encoder Scaling", coalesce(site, '') AS "Website", coalesce("imageUrl", '') AS "Image URL" FROM devices"""))
def snk5_enriched(spark, sf):
    return devices.device_enriched_report(device_rows(spark, sf))
