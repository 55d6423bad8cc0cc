"""op7: language of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, records


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = records.as_catalog(records.documents(spark, sf_dir))
    learned = language.fit_languages(catalog.where(records.fold("id", 5) != 0))
    return language.identify_language(catalog, learned).select(
        F.col("id").alias("doc_id"), (records.fold("id", 5) == 0).alias("held_out"), F.col("language").alias("lang_pred"), "score", "rejected")
