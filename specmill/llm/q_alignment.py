"""op13: two tokenizers' tokens of all documents aligned."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, records

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = records.as_catalog(records.documents(spark, sf_dir))
    aligned = alignment.align_catalog(catalog, public_tokenizers.path(FIRST), public_tokenizers.path(SECOND))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    scored = alignment.score_links(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return scored.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
