"""The corpus pipeline: five filters and an encoder over `documents`, each stage on all that the one before kept.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the shared folder and reads it again as the
next stage's docs. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm import byte_bpe, decontaminate, jaccard, language, quality
from cloakwork.llm.common import stored, table
from cloakwork.llm.queries import BYTE_BPE, fold, pattern, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; the models are learnt from two thirds of the labelled rows."""
    return language.accepted(docs, language.fit(docs, fold("k", 3) != 1))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a quality score of 0.3 or more."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near duplicates the document with the smallest id."""
    return jaccard.one_of_each(docs, threshold=0.8, n=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a word inside a passage of ten words from the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: number, and digests of the ids and of the decoded bytes."""
    return byte_bpe.digests(docs, vocabulary(BYTE_BPE), pattern())


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: SQL can express neither the fitted models nor the merges; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
