"""The training-corpus pipeline: five stages from raw documents to a mixed corpus.

Each stage takes the documents that the one before it kept, whole, and its decisions
take effect: rejected languages, copies, near copies and contaminated documents go, and the
last stage repeats or cuts sources to their target weights. All but the last
return the columns of ``documents``. :func:`run` writes each stage's result to the shared
folder and rereads it, so that a later stage never repeats an earlier one's work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cueline.llm.decontaminate import decontaminate
from cueline.llm.exact_dedup import exact_dedup
from cueline.llm.language_id import keep_identified
from cueline.llm.mixing import mixture
from cueline.llm.near_dedup import near_dedup
from cueline.llm.tables import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that the calibrated model rejects go."""
    return keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id."""
    return near_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken, with its epoch and words."""
    return mixture(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("mix", mixing_stage),
]

#: The language model, the similarity links and their components have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
