"""op6: sampled segmentations of all documents, decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records, segments

MODEL, SAMPLES = "piece_bpe_32k.model", 2


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.sample_segmentations(records.as_catalog(records.documents(spark, sf_dir)), public_tokenizers.path(MODEL), k=SAMPLES)


def op6_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = segments.sample_segmentations(records.as_catalog(records.documents(spark, sf_dir)), public_tokenizers.path(MODEL), k=SAMPLES, decoded=True)
    return read.select(F.col("id").alias("doc_id"), "rank", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "log_prob", "score", "inclusion")
