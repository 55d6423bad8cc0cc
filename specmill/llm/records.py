"""The tables of the corpus as catalogue records, and back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_catalog(docs: DataFrame) -> DataFrame:
    """Documents as catalogue records: the text is the description, the source the manufacturer."""
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("description"), F.col("source").alias("manufacturer"),
                       F.col("lang").alias("language"))


def as_documents(catalog: DataFrame) -> DataFrame:
    """Records with a whole description as rows of ``documents``; the length is counted anew."""
    return catalog.select(F.col("id").alias("doc_id"), F.col("description").alias("text"), F.col("language").alias("lang"),
                          F.col("manufacturer").alias("source"), F.length("description").cast("long").alias("n_chars"))


def ratings(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    """Labels of records: (id, rating)."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col(field).alias("rating"))


def fold(id, n: int):
    """crc32 of the id as text, modulo ``n``; ``n``, which is no remainder, for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % n, F.lit(n).cast("long"))


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
