"""Readers and writers: rows of the given tables written to the shared folder and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.text import c
from ..operators.normalize import process_catalog
from ..operators.quality import field_coverage
from ..session import shared_dir
from ..sources import readers, writers
from ..streaming import streams
from . import inputs
from .oracle import DEV, cat, raw
from .registry import query


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


#: Records of one document, about.
RECORDS = 10_000


def _dealt(rows, by: str, id: str):
    """``rows`` with the column ``_by``: the value of ``by`` and the number of one of its documents, by a hash of the id."""
    sizes = rows.groupBy(c(by).alias("_group")).agg(F.ceil(F.count("*") / RECORDS).alias("_parts"))
    found = rows.join(F.broadcast(sizes), c(by).eqNullSafe(c("_group")))
    return found.withColumn("_by", F.concat_ws("-", c(by).cast("string"), F.pmod(F.xxhash64(c(id)), c("_parts")).cast("string"))).drop("_group", "_parts")


def _documents(rows, by: str, path: str, wrap: str | None = None):
    """JSON documents of about RECORDS records with one value of ``by``, a file each: an array of records, or an object that holds it."""
    rows = _dealt(rows, by, "id")
    listed = F.to_json(F.collect_list(F.struct(*[x for x in rows.columns if x != "_by"])))
    text = listed if wrap is None else F.concat(F.lit('{"version": "2", "' + wrap + '": '), listed, F.lit("}"))
    rows.groupBy("_by").agg(text.alias("value")).repartition("_by").write.partitionBy("_by").text(path)


@query("src1_read_catalog", raw("SELECT id, manufacturer, model, loadCapacity, motorPower, weight, CAST(n_images AS BIGINT) AS n_images FROM raw"))
def src1(spark, sf):
    path = _folder(spark, "catalog")
    rows = inputs.raw_catalog(spark, sf).select("id", "manufacturer", "model", "loadCapacity", "motorPower", "weight", "images")
    _documents(rows, "manufacturer", path, "products")
    return readers.read_catalog(spark, f"{path}/*").select("id", "manufacturer", "model", "loadCapacity", "motorPower", "weight", F.size("images").cast("long").alias("n_images"))


@query("src1_read_catalog_split", raw("SELECT id, manufacturer, model, loadCapacity, motorPower, weight, CAST(n_images AS BIGINT) AS n_images FROM raw"))
def src1_split(spark, sf):
    path = _folder(spark, "catalog")
    rows = inputs.raw_catalog(spark, sf).select("id", "manufacturer", "model", "loadCapacity", "motorPower", "weight", "images")
    _documents(rows, "manufacturer", path, "data")
    return readers.read_catalog_split(spark, f"{path}/*").select("id", "manufacturer", "model", "loadCapacity", "motorPower", "weight", F.size("images").cast("long").alias("n_images"))


@query("src2_read_devices", f"""WITH {DEV} SELECT "manufacturerId", "productId", trim(name) AS name, "overloadRaw" AS overload, "minSpeedRaw" AS lo FROM devices_raw""")
def src2(spark, sf):
    path = _folder(spark, "devices")
    d = inputs.raw_devices(spark, sf).select(
        c("manufacturerId").alias("_ManufacturerId"), c("productId").alias("_ProductId"), c("name").alias("Name"), F.struct(c("minSpeedRaw").alias("MinSpeedClamp")).alias("VariableSpeedControl"),
        c("overloadRaw").alias("OverloadLimit"), c("manufacturerId").alias("folder"))
    d.write.format("xml").option("rowTag", "MotorModel").option("rootTag", "MotorModels").partitionBy("folder").save(path)
    return readers.read_devices(spark, path).select("manufacturerId", "productId", "name", c("OverloadLimit").alias("overload"), c("VariableSpeedControl.MinSpeedClamp").alias("lo"))


@query("src3_read_makers", f"""WITH {DEV} SELECT "manufacturerId", "fullName", regexp_replace("fullName", '^[0-9]+ - ', '') AS name FROM makers""")
def src3(spark, sf):
    path = _folder(spark, "makers")
    inputs.makers(spark, sf).select(c("manufacturerId").alias("_ManufacturerId"), c("fullName").alias("ManufacturerName")).write.format("xml").option(
        "rowTag", "Manufacturer").option("rootTag", "Manufacturers").save(path)
    return readers.read_device_makers(spark, path)


@query("src4_read_report", "SELECT 'e' || CAST(event_id AS VARCHAR) AS key, event_type, value FROM events")
def src4(spark, sf):
    path = _folder(spark, "reports")
    e = inputs.table(spark, sf, "events").select(F.concat(F.lit("e"), c("event_id").cast("string")).alias("k"), F.struct("event_type", "value").alias("v"), F.to_date("ts").alias("day"))
    _dealt(e, "day", "k").groupBy("_by").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).repartition("_by").write.partitionBy("_by").text(path)
    r = readers.read_report(spark, f"{path}/*")
    return r.select("key", F.try_variant_get("value", "$.event_type", "string").alias("event_type"), F.try_variant_get("value", "$.value", "double").alias("value"))


@query("src4_read_runs", "SELECT CAST(event_id AS VARCHAR) AS id, event_type <> 'error' AS success, value AS duration FROM events")
def src4_runs(spark, sf):
    path = _folder(spark, "runs")
    e = inputs.table(spark, sf, "events").select(c("event_id").cast("string").alias("id"), (c("event_type") != "error").alias("success"), c("value").alias("duration"), F.to_date("ts").alias("day"))
    _documents(e, "day", path, "runs")
    return readers.read_runs(spark, f"{path}/*").select("id", "success", "duration")


@query("src5_list_media", f"SELECT DISTINCT lower(replace(p_brand, '#', '-')) || '.PDF' AS filename FROM part")
def src5(spark, sf):
    path = _folder(spark, "media")
    names = inputs.table(spark, sf, "part").select(F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit(".PDF")).alias("name")).distinct()
    names.select("name", c("name").alias("value")).repartition("name").write.partitionBy("name").text(path)  # a folder per name, a file in each
    found = readers.list_media(spark, path, ["txt"])
    return found.select(F.url_decode(F.regexp_extract("path", "name=([^/]+)/", 1)).alias("filename")).distinct()


@query("src6_vendor_regions", "SELECT n_name AS \"Manufacturer\", 'https://' || lower(n_name) AS \"Website\", 'Region \"' || CAST(n_regionkey AS VARCHAR) || '\", global' AS \"Region\" FROM nation")
def src6(spark, sf):
    path = _folder(spark, "regions")
    n = inputs.table(spark, sf, "nation")
    n.select(c("n_name").alias("Manufacturer"), F.concat(F.lit("https://"), F.lower("n_name")).alias("Website"),
             F.concat(F.lit('Region "'), c("n_regionkey").cast("string"), F.lit('", global')).alias("Region")).write.csv(path, header=True, quoteAll=True)
    return readers.read_vendor_regions(spark, path)


@query("src8_read_pages", "SELECT page_id, url, html FROM pages")
def src8(spark, sf):
    return readers.read_pages(spark, f"{sf}/pages.parquet")


@query("snk6_write_processed", cat("SELECT id, model, quietOperation, dataCompleteness FROM catalog"))
def snk6(spark, sf):
    path = _folder(spark, "processed")
    d = process_catalog(inputs.raw_catalog(spark, sf))
    writers.write_processed(d, field_coverage(d), path)
    return spark.read.parquet(f"{path}/records").select("id", "model", "quietOperation", "dataCompleteness")


@query("snk6_report_in_one_pass", cat("""SELECT 'records' AS metric, CAST(count(*) AS DOUBLE) AS value FROM catalog UNION ALL SELECT 'motorPower', count(*) FILTER (coalesce(motorPower, '') <> '') FROM catalog
  UNION ALL SELECT 'series', count(*) FILTER (coalesce(series, '') <> '') FROM catalog UNION ALL SELECT 'completeness', sum(dataCompleteness) FROM catalog"""))
def snk6_report(spark, sf):
    path, there = _folder(spark, "processed"), lambda f: F.count_if(F.coalesce(c(f), F.lit("")) != "")
    d = process_catalog(inputs.raw_catalog(spark, sf))
    writers.write_processed(d, {"records": F.count(F.lit(1)), "motorPower": there("motorPower"), "series": there("series"), "completeness": F.sum("dataCompleteness")}, path)
    return spark.read.schema("metric string, value double").json(f"{path}/report")


@query("snk8_export_all", cat("SELECT 'json' AS format, id, model FROM catalog UNION ALL SELECT 'csv', id, model FROM catalog"))
def snk8(spark, sf):
    path = _folder(spark, "export")
    writers.export_all(process_catalog(inputs.raw_catalog(spark, sf)).select("_pos", "id", "model", "classification"), path, when="2025-01-01")
    back = [spark.read.json(f"{path}/json/data"), spark.read.csv(f"{path}/csv", header=True, escape='"')]
    one, two = (d.select(F.lit(n).alias("format"), "id", "model") for n, d in zip(("json", "csv"), back))
    return one.unionByName(two)


@query("t07_late_rows", "SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def t07(spark, sf):
    """On a table a watermark drops nothing; on a stream the tests hold the dropped rows against their counter."""
    e = streams.late(inputs.table(spark, sf, "events"), "1 hour")
    return e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
