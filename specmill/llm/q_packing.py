"""op3: all documents packed into sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, records

VOCABULARY = "byte_bpe_50k.json"


def digested(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(packing.pack_catalog(records.as_catalog(records.documents(spark, sf_dir)), public_tokenizers.path(VOCABULARY)))
