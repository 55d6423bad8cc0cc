"""op1: secrets of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records, secrets


def _listed(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _of_kind(kind: str):
    return F.filter("secrets", lambda s: s["kind"] == kind)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(records.as_catalog(records.documents(spark, sf_dir)))
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    return found.select(
        F.col("id").alias("doc_id"),
        *(F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))
