"""op2: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records, toxicity


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = records.as_catalog(records.documents(spark, sf_dir))
    rated = records.ratings(spark, sf_dir, "toxic").where(records.fold("id", 5) != 0)
    scored = toxicity.score_toxicity(catalog, toxicity.fit_toxicity(catalog, rated))
    return scored.select(F.col("id").alias("doc_id"), (records.fold("id", 5) == 0).alias("held_out"),
                         F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
