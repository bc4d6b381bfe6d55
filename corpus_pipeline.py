"""The corpus pipeline: five of the training-data operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``docs``.

Empty input gives empty output at each stage; null and empty texts are scored by
the first stage like any other, and grouped with each other by the third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowprep.llm import decontaminate, line_dedup, quality_classifier, sentencepiece, simhash
from flowprep.llm.common import read_table, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier rejects go."""
    return quality_classifier.classify(docs, read_table(spark, sf_dir, "labels"), threshold=0.3, keep_only=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: later copies of lines go, and documents that had lines and lost all."""
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group stays."""
    return simhash.keep_one(docs, shingle=4, distance=4)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: (doc_id, n_tokens, ids, round_trip)."""
    return sentencepiece.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("sentencepiece", tokens),
]

# A classifier's scores and a Viterbi segmentation have no SQL form: tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
