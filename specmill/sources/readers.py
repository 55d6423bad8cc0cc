"""Readers: catalogues, reports, device XML, media listings, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import c, js_trim
from ..functions.values import variant_array, variant_to_bool
from ..schema import BOOL_FIELDS, CATALOG, DATE_FIELDS, LIST_FIELDS, MAP_FIELDS, MEDIA_FIELDS, TEXT_FIELDS
from .jsonsplit import split_records

IMAGE_TYPES = ["png", "jpg", "jpeg", "webp", "svg", "gif"]


def _field(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def to_timestamp_any(v: Column) -> Column:
    """ISO text or epoch milliseconds."""
    s = F.try_variant_get(v, "$", "string")
    n = s.try_cast("bigint")
    ms = F.when(s.rlike(r"^\d{9,}$") & (n < 253402300800000), F.timestamp_millis(n))  # up to the year 9999
    return F.coalesce(ms, F.try_to_timestamp(s))


def _urls_as(urls: Column, names: list[str]) -> Column:
    """Plain address lists in the struct form of the schema."""
    none = F.lit(None).cast("string")
    return F.transform(urls, lambda u: F.struct(*[(u if n == "url" else none).alias(n) for n in names]))


def catalog_columns(v: Column) -> list[Column]:
    """The fixed record schema read from a VARIANT; fields that may be a scalar or a list, or a text or an object, are
    settled here, and keys outside the schema go to ``extras``."""
    cols = [_field(v, f, "string").alias(f) for f in TEXT_FIELDS]
    for f in LIST_FIELDS:
        item = _field(v, f, "variant")
        text = F.try_variant_get(item, "$", "string")
        if f == "classification":  # may also come as one delimited text
            one = F.when(F.schema_of_variant(item) == "STRING", F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "[,;/]")))
            cols.append(F.coalesce(one, F.try_variant_get(item, "$", "array<string>")).alias(f))
        else:
            cols.append(variant_array(item).alias(f))
    cols += [_field(v, f, "map<string,string>").alias(f) for f in MAP_FIELDS]
    cols += [F.when(_field(v, f, "variant").isNotNull(), variant_to_bool(_field(v, f, "variant"))).alias(f) for f in BOOL_FIELDS]
    for f, t in MEDIA_FIELDS.items():
        kind = f"array<{t.simpleString()}>"
        plain = _urls_as(_field(v, f, "array<string>"), t.fieldNames())
        first = F.try_variant_get(v, f"$.{f}[0]", "variant")
        cols.append(F.when(F.schema_of_variant(first) == "STRING", plain).otherwise(_field(v, f, kind)).alias(f))
    cols += [_field(v, "price", "struct<value:double,currency:string>").alias("price"),
             _field(v, "rentalRate", "struct<daily:double,weekly:double>").alias("rentalRate")]
    cols += [_field(v, f, "double").alias(f) for f in ("confidence", "capacityKg", "speedMMin", "dataCompleteness")]
    cols.append(_field(v, "dataQualityTier", "string").alias("dataQualityTier"))
    cols += [to_timestamp_any(_field(v, f, "variant")).alias(f) for f in DATE_FIELDS]
    known = F.array(*[F.lit(n) for n in CATALOG.fieldNames()])
    rest = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: ~F.array_contains(known, k))
    cols.append(F.transform_values(rest, lambda k, x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))).alias("extras"))
    return cols


def _documents(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """(_file, value, d) per JSON document: ``d`` has the given top-level ``fields``; nested values are read as their JSON text.

    The text of a document is parsed in pieces, one per field or record, so its size is not bounded by what one VARIANT
    holds. A document that is no JSON, or cut short, is an error.
    """
    docs = spark.read.text(path, wholetext=True).select(c("_metadata.file_name").alias("_file"), js_trim("value").alias("value"))
    kinds = ", ".join(f"{k} {t}" for k, t in {**fields, "_bad": "string"}.items())
    object_ = c("value").startswith("{")
    d = docs.withColumn("d", F.when(object_, F.from_json("value", kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})))
    other = ~object_ & ~c("value").startswith("[") & F.try_parse_json("value").isNull()
    return d.withColumn("d", F.when(c("d._bad").isNotNull() | other, _unreadable().cast(d.schema["d"].dataType)).otherwise(c("d")))


def _unreadable() -> Column:
    return F.raise_error(F.concat(F.lit("no readable JSON in "), c("_file")))


def read_catalog(spark: SparkSession, path: str, on_bad: str = "raise") -> DataFrame:
    """Catalogue JSON document(s): a bare array, or an object with ``data`` or ``products``.

    A JSON document is one unit, so it is read by one task per file, record by record; a large one is read by many tasks with
    ``read_catalog_split``. ``_pos`` is the position in the document, ``_file`` its name. A document that is
    no JSON raises. Any other shape raises too, or yields nothing with ``on_bad='empty'``.
    """
    if on_bad not in ("raise", "empty"):
        raise ValueError("on_bad must be 'raise' or 'empty'")
    docs = _documents(spark, path, {"data": "array<string>", "products": "array<string>"})
    items = F.when(c("value").startswith("["), F.coalesce(F.from_json("value", "array<string>"), _unreadable().cast("array<string>"))).otherwise(F.coalesce("d.data", "d.products"))
    if on_bad == "raise":
        items = F.coalesce(items, F.raise_error(F.concat(F.lit("no record array in "), c("_file"))).cast("array<string>"))
    rows = docs.select("_file", F.posexplode(items).alias("_pos", "r")).withColumn("r", F.parse_json("r"))
    return rows.select(c("_pos").cast("long").alias("_pos"), *catalog_columns(c("r")), "_file")


def read_catalog_split(spark: SparkSession, path: str, on_bad: str = "raise") -> DataFrame:
    """``read_catalog`` for documents of any size: each is read in parts, by many tasks; see ``split_records``.

    The rows are the same. What is beside the records is looked at for brackets and texts only, and an empty file has no rows.
    """
    if on_bad not in ("raise", "empty"):
        raise ValueError("on_bad must be 'raise' or 'empty'")
    rows = split_records(spark, path, on_bad=on_bad).withColumn("r", F.parse_json("record"))
    return rows.select("_pos", *catalog_columns(c("r")), "_file")


def read_catalog_meta(spark: SparkSession, path: str) -> DataFrame:
    """Envelope fields other than the records, one row per file."""
    docs = _documents(spark, path, {"version": "string", "scrapedAt": "string", "stats": "string"})
    return docs.select("_file", "d.version", "d.scrapedAt", "d.stats")


def read_catalog_lines(spark: SparkSession, path: str, pos: str = "line") -> DataFrame:
    """Catalogue as JSON lines, splittable; ``pos`` names the numeric key that holds the input order."""
    v = spark.read.text(path).select(F.try_parse_json("value").alias("v")).filter("v is not null")
    return v.select(F.try_variant_get("v", f"$.{pos}", "bigint").alias("_pos"), *catalog_columns(c("v")))


def write_ready(df: DataFrame) -> DataFrame:
    """Records for JSON output: technical columns dropped."""
    return df.drop(*[x for x in df.columns if x.startswith("_")])


DEVICE_XML = T.StructType(
    [T.StructField("_ManufacturerId", T.StringType()), T.StructField("_ProductId", T.StringType()),
     T.StructField("Name", T.StringType()), T.StructField("ImageFile", T.StringType()),
     T.StructField("VariableSpeedControl", T.StructType([T.StructField(n, T.StringType()) for n in (
         "MinSpeedClamp", "MaxSpeedClamp", "MinAccelClamp", "MaxAccelClamp", "MinDecelClamp", "MaxDecelClamp",
         "ErrorStopClamp", "DefaultSpeed", "DefaultAccel", "DefaultDecel")]))]
    + [T.StructField(n, T.StringType()) for n in ("UnderloadLimit", "OverloadLimit", "LoadcellScaling", "EncoderScaling")]
    + [T.StructField("TuningParameter", T.ArrayType(T.StructType([
        T.StructField("TuningParameterName", T.StringType()), T.StructField("TuningParameterValue", T.StringType())])))])


def read_devices(spark: SparkSession, root: str) -> DataFrame:
    """Device XML files one directory below ``root``; only ``*.xml``, files that do not parse are skipped.

    All fields are read as text (ids keep their leading zeros) and cast by ``parse_devices``.
    """
    raw = (spark.read.format("xml").option("rowTag", "MotorModel").option("mode", "DROPMALFORMED").schema(DEVICE_XML)
           .option("pathGlobFilter", "*.xml").load(f"{root}/*/"))
    df = raw.select("*", c("_metadata.file_name").alias("_f"), c("_metadata.file_path").alias("_path"))
    name = F.url_decode(F.replace(c("_f"), F.lit("+"), F.lit("%2B")))
    cols = [c("_ManufacturerId").alias("manufacturerId"), c("_ProductId").alias("productId"),
            F.coalesce("Name", F.lit("")).alias("name"), name.alias("fileName"), "_path",
            F.nullif(c("ImageFile"), F.lit("")).alias("imageFile"),
            "VariableSpeedControl", "UnderloadLimit", "OverloadLimit", "LoadcellScaling", "EncoderScaling", "TuningParameter"]
    return df.filter(c("_ManufacturerId").isNotNull()).select(*cols)


def read_device_makers(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("_ManufacturerId", T.StringType()), T.StructField("ManufacturerName", T.StringType())])
    df = spark.read.format("xml").option("rowTag", "Manufacturer").schema(schema).load(path)
    return df.select(c("_ManufacturerId").alias("manufacturerId"), c("ManufacturerName").alias("fullName"),
                     js_trim(F.regexp_replace("ManufacturerName", r"^\d+\s*-\s*", "")).alias("name"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Report, history or extraction JSON as (_file, key, value VARIANT): one row per top-level entry."""
    entries = _documents(spark, path, {}).filter(c("value").startswith("{") & c("d").isNotNull()).select(
        "_file", F.explode(F.from_json("value", "map<string,string>")).alias("key", "text"))
    plain = F.try_variant_get(F.parse_json(F.to_json(F.struct("text"))), "$.text", "variant")  # a text that is no JSON itself
    return entries.select("_file", "key", F.coalesce(F.try_parse_json("text"), plain).alias("value"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run history: one row per run."""
    run = "struct<id:string,startTime:string,endTime:string,duration:double,success:boolean,error:string>"
    docs = _documents(spark, path, {"runs": f"array<{run}>"})
    return docs.select(F.posexplode("d.runs").alias("pos", "r")).select("pos", "r.*")


def list_media(spark: SparkSession, path: str, exts: list[str]) -> DataFrame:
    """Media files by extension (any case): name and size; the contents are never read."""
    pat = r"(?i)\.(" + "|".join(e.lstrip(".") for e in exts) + ")$"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return df.filter(c("path").rlike(pat)).withColumn("filename", F.substring_index("path", "/", -1))


def read_vendor_regions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="Manufacturer string, Website string, Region string")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")
