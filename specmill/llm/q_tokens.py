"""op11: token counts of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import records, tokens

MODEL = "piece_bpe_32k.model"


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(records.as_catalog(records.documents(spark, sf_dir)), public_tokenizers.path(MODEL)).withColumnRenamed("id", "doc_id")
