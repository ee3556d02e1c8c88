"""The corpus pipeline: five stages, each over all documents that the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared folder and
read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, jaccard_join, quality_classifier, secrets, sentencepiece
from tidewire.llm.kernel import shared, table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least doc_id stays; they link by five-word shingles from similarity 0.8."""
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are redacted; n_chars follows the text."""
    clean = secrets.without_secrets(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else clean


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return sentencepiece.encode_texts(docs, [c for c in docs.columns if c != "text"])


STAGES = [
    ("quality_classifier", _quality),
    ("near_copies", _near_copies),
    ("decontamination", _decontaminate),
    ("secret_scan", _secrets),
    ("sentencepiece", _encode),
]
#: Trained models and tokenising can't be written as SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
