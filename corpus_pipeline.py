"""Pipeline over ``documents``: reject toxic texts, keep one of near copies, decontaminate, redact secrets, mix sources.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  All but the last
return the columns of ``documents``; redaction changes texts but drops none.  The mix returns one row per
document that it takes words from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import decontamination, mixing, ngram_join, secret_scan, toxicity
from sightline.llm.common import saved, table

#: The classifiers and the components can't be expressed in SQL.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score stays below the threshold."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of documents linked by 5-word shingles at a Jaccard similarity of 0.75."""
    return ngram_join.keep_one_per_class(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no 10-word window of a benchmark item."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by a mark."""
    return secret_scan.redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words from, with how many and how often as a whole."""
    return mixing.mix_sources(docs).filter("taken > 0")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", one_of_near_copies),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("mix", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each one's result written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
