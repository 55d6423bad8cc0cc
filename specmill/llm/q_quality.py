"""op8: quality of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, records

GOOD = 0.7


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = records.as_catalog(records.documents(spark, sf_dir))
    rated = records.ratings(spark, sf_dir, "quality").where(records.fold("id", 4) != 2)
    scored = quality.score_quality(catalog, quality.fit_quality(catalog, rated))
    return scored.select(F.col("id").alias("doc_id"), (records.fold("id", 4) == 2).alias("held_out"),
                         F.col("quality").alias("score"), (F.col("quality") >= GOOD).cast("int").alias("predicted"))
