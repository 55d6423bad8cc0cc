"""Corpus pipeline over ``documents``: each stage's rows are written and read again as the next one's.

Junk and texts of unclear language go, one document of each group of near-duplicates stays, secrets are masked, and what is left is
packed into training sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from specmill.llm import language, neighbours, packing, quality, records, secrets
from specmill.llm.q_packing import VOCABULARY, digested
from specmill.llm.q_quality import GOOD
from specmill.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _on_documents(stage: Stage) -> Stage:
    """The stage on the columns of ``documents`` only, whatever else a table holds."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs.select(*records.DOCUMENT), sf_dir)

    run.__doc__ = stage.__doc__
    return run


@_on_documents
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model finds good; it learns from the labelled ones outside the held-out fold."""
    rated = records.ratings(spark, sf_dir, "quality").where(records.fold("id", 4) != 2)
    return quality.keep_good(docs, quality.fit_quality(docs, rated, "doc_id", "text"), "text", GOOD)


@_on_documents
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the dictionaries come from those outside the held-out fold."""
    learned = language.fit_languages(docs.where(records.fold("doc_id", 5) != 0), "doc_id", "text", "lang")
    return language.keep_identified(docs, learned, "text")


@_on_documents
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: 80 % or more of their five-word shingles in common."""
    return neighbours.keep_first(docs, "doc_id", "text", percent=80, words=5)


@_on_documents
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and their lengths counted anew."""
    return records.as_documents(secrets.mask_secrets(records.as_catalog(docs)))


@_on_documents
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return digested(packing.pack_catalog(docs, public_tokenizers.path(VOCABULARY), "doc_id", "text"))


STAGES = [("quality_classifier", quality_classifier), ("language_id", language_id), ("jaccard_join", jaccard_join), ("secret_scans", secret_scans), ("packing", pack)]
#: SQL can't fit the models; the result is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = records.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = records.written(docs, name)
    return docs
