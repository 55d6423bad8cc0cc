"""Writers: JSON and CSV exports, processed output, and snapshots with retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import c, js_number
from ..operators.search import export_filter
from .readers import write_ready

# how a map column names its flattened columns where that differs from the column name
PREFIXES = {"certifications": "certification"}
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def export_meta(df: DataFrame, when, filters: dict | None = None, version: str = "2.0",
                description: str = "Product catalogue export") -> DataFrame:
    """One row that describes an export."""
    return _meta(df.agg(F.count("*").alias("totalRecords")), when, filters, version, description)


def _meta(counted: DataFrame, when, filters: dict | None = None, version: str = "2.0", description: str = "Product catalogue export") -> DataFrame:
    return counted.select(
        F.lit(when).alias("exportDate"), "totalRecords", F.lit(version).alias("version"),
        F.to_json(F.create_map(*[F.lit(x) for kv in (filters or {}).items() for x in kv])).alias("filters") if filters
        else F.lit("{}").alias("filters"), F.lit(description).alias("description"))


def export_json(df: DataFrame, path: str, filters: dict | None = None, when: str | None = None) -> None:
    """JSON lines under ``path/data`` and a metadata row under ``path/metadata``; the rows are counted while they are written."""
    n = Observation()
    rows = export_filter(df, **(filters or {})).observe(n, F.count(F.lit(1)).alias("totalRecords"))
    write_ready(rows).write.mode("overwrite").json(f"{path}/data")
    counted = df.sparkSession.range(1).select(F.lit(n.get["totalRecords"]).cast("long").alias("totalRecords"))
    _meta(counted, when, filters).write.mode("overwrite").json(f"{path}/metadata")


def flatten_catalog(df: DataFrame, sep: str = ", ", map_keys: dict[str, list[str]] | None = None, falsy_blank: bool = False,
                    expand_maps: bool = True) -> DataFrame:
    """Flat columns for CSV: lists joined, maps spread over ``prefix_key`` columns, price and rental split, dates as ISO
    text. ``falsy_blank`` writes '' for empty price parts. A header needs the keys of a map column beforehand: ``map_keys`` names
    them, and a map without an entry there (or with ``expand_maps`` off) is written as one JSON text, so no key is lost."""
    out: list[Column] = []
    for f in df.schema.fields:
        n, t = f.name, f.dataType
        if isinstance(t, T.ArrayType):
            if isinstance(t.elementType, T.StructType):
                key = "url" if "url" in t.elementType.fieldNames() else t.elementType.fieldNames()[0]
                out.append(F.array_join(F.col(f"{n}.{key}"), sep).alias(n))
            else:
                out.append(F.array_join(n, sep).alias(n))
        elif isinstance(t, T.MapType):
            keys = (map_keys or {}).get(n) if expand_maps else None
            if keys is None:
                out.append(F.to_json(n).alias(n))
                continue
            out += [F.try_element_at(n, F.lit(k)).cast("string").alias(f"{PREFIXES.get(n, n)}_{k}") for k in keys]
        elif isinstance(t, T.StructType):
            for sub in t.fields:
                v = F.col(f"{n}.{sub.name}")
                if falsy_blank:
                    v = F.when(v.isNull() | v.cast("string").isin("0", "0.0", ""), "").otherwise(v.cast("string"))
                out.append(v.alias(f"{n}{sub.name[0].upper()}{sub.name[1:]}"))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(n, ISO).alias(n))
        else:
            out.append(c(n))
    return df.select(*out)


def flatten_media(df: DataFrame) -> DataFrame:
    """Images and videos as addresses joined by '; ', classes joined by ', '; '' where there are none."""
    cols = {}
    for n in ("images", "videos"):
        if n in df.columns:
            cols[n] = F.coalesce(F.array_join(F.transform(n, lambda x: x["url"]), "; "), F.lit(""))
    if "classification" in df.columns:
        cols["classification"] = F.array_join("classification", ", ")
    return df.withColumns(cols)


def header_keys(df: DataFrame) -> dict[str, list[str]]:
    """The keys that occur in each map column, in order: what a CSV header needs. One aggregate over all map columns; its result is a header."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    if not maps:
        return {}
    def keys_of(n: str) -> Column:
        return F.transform(F.coalesce(F.map_keys(n), F.array().cast("array<string>")), lambda k: F.struct(F.lit(n).alias("column"), k.alias("key")))

    keys = [keys_of(n) for n in maps]
    found = df.select(F.inline(F.flatten(F.array(*keys)))).distinct().collect()
    return {n: sorted(r["key"] for r in found if r["column"] == n) for n in maps}


def export_csv(df: DataFrame, path: str, **options) -> None:
    """CSV with a header; the keys of map columns are found in the rows, by ``header_keys``, unless ``map_keys`` names them."""
    df = write_ready(df)
    if options.get("expand_maps", True) and options.get("map_keys") is None:
        options = {**options, "map_keys": header_keys(df)}
    flatten_catalog(df, **options).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_processed(df: DataFrame, report: DataFrame | dict[str, Column], path: str) -> None:
    """Records under ``path/records`` and their report under ``path/report``.

    A report of aggregate columns by name is taken while the records are written, and has a row (metric, value) for each; one
    that is a table is computed by itself.
    """
    if isinstance(report, DataFrame):
        df.write.mode("overwrite").parquet(f"{path}/records")
    else:
        seen = Observation()
        df.observe(seen, *[v.alias(k) for k, v in report.items()]).write.mode("overwrite").parquet(f"{path}/records")
        rows = [(k, None if seen.get[k] is None else float(seen.get[k])) for k in report]
        report = df.sparkSession.createDataFrame(rows, "metric string, value double")
    report.write.mode("overwrite").json(f"{path}/report")


def export_all(df: DataFrame, path: str, stats: DataFrame | None = None, when: str | None = None, **csv_options) -> None:
    """The same rows in every format: one pass over ``df`` for each, nothing is kept in between."""
    export_json(df, f"{path}/json", when=when)
    export_csv(df, f"{path}/csv", **csv_options)
    if stats is not None:
        stats.write.mode("overwrite").json(f"{path}/stats")


def export_filtered(df: DataFrame, path: str, filters: dict, fmt: str = "json", when: str | None = None) -> None:
    if fmt == "json":
        export_json(df, path, filters, when)
    elif fmt == "csv":
        export_csv(export_filter(df, **filters), path)
    else:
        raise ValueError(f"unknown format {fmt}")


# -- snapshots ----------------------------------------------------------------------------------------------------

def snapshot(df: DataFrame, root: str, ts: str) -> None:
    """Write one snapshot partition; an equal timestamp replaces only its own partition."""
    (df.withColumn("snapshot_ts", F.lit(ts)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_ts").parquet(root))


def _stored(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(root).withColumn("snapshot_ts", c("snapshot_ts").cast("string"))


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Snapshots with row counts and stored bytes, newest first."""
    rows = _stored(spark, root).groupBy("snapshot_ts").agg(F.count("*").alias("rows"))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
             .select(F.url_decode(F.regexp_extract("path", r"snapshot_ts=([^/]+)/", 1)).alias("snapshot_ts"), "length")
             .groupBy("snapshot_ts").agg(F.sum("length").alias("bytes")))
    return rows.join(files, "snapshot_ts", "left").orderBy(c("snapshot_ts").desc())


def retention(manifest: DataFrame, n: int = 10, ts: str = "snapshot_ts") -> DataFrame:
    """Mark which snapshots stay: the newest n. The manifest has one row per snapshot, so ranking it is small."""
    w = Window.orderBy(c(ts).desc())
    return manifest.withColumn("rank", F.row_number().over(w)).withColumn("keep", c("rank") <= n)


def retain(spark: SparkSession, root: str, n: int = 10) -> list[str]:
    """Delete all but the newest n snapshots and return the deleted timestamps."""
    old = [r.snapshot_ts for r in retention(_stored(spark, root).select("snapshot_ts").distinct(), n).filter("not keep").collect()]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    esc = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for ts in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(base, f"snapshot_ts={esc.escapePathName(ts)}"), True)
    return old


def restore(spark: SparkSession, root: str, ts: str, current: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """Rows of a snapshot; with ``current`` given that state is snapshotted first."""
    if current is not None:
        if not now:
            raise ValueError("restore needs the timestamp of the safety snapshot")
        snapshot(current, root, now)
    return _stored(spark, root).filter(c("snapshot_ts") == ts).drop("snapshot_ts")


def size_text(n) -> Column:
    """Bytes as text with up to two decimals."""
    n = c(n).cast("double")
    i = F.when(n < 1024, 0).when(n < 1024 ** 2, 1).when(n < 1024 ** 3, 2).otherwise(3)

    v = F.round(n / F.pow(F.lit(1024.0), i), 2)
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), i + 1)
    return F.when(n == 0, "0 B").otherwise(F.concat(js_number(v), F.lit(" "), unit))


def backup_stamp(ts) -> Column:
    """Timestamp as a file-name-safe text."""
    return F.date_format(c(ts), "yyyy-MM-dd'T'HH-mm-ss")


def iso_date(ts) -> Column:
    return F.date_format(c(ts), "yyyy-MM-dd")


def epoch_ms(x) -> Column:
    return F.unix_millis(F.try_to_timestamp(c(x)))
