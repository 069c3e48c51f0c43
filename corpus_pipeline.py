"""A training-data pipeline of five stages over ``documents``; each stage reads what its predecessor kept.

All but the last stage return the columns of ``documents``. Null texts are empty texts throughout: the quality
stage rejects texts without words, copies of the empty text are copies like others, empty shingle sets link with
nothing, and packing closes an empty text with one id. Rows without an id are judged like others by the first two stages
and kept by the third. An empty table gives no pieces. Columns with names of a stage's results pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigspark.llm import exact_dedup, near_dedup, packing, pii, quality_classifier
from sigspark.llm.common import read_table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier takes; its labels come from ``labels``."""
    model = quality_classifier.fit_on_labels(docs, read_table(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest id."""
    return exact_dedup.distinct_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.keep_one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text."""
    return pii.redact(docs, pii.fit_pii(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences, neighbours on the curve side by side."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses neither the classifier nor the tokens; the stages' operators are tested against plain versions.
ORACLE_SQL = None
