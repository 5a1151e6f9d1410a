"""The corpus pipeline: STAGES over documents, each stage's rows written as Parquet and read back by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from echolens.llm.common import discard, materialize, scratch, table
from echolens.llm.decontamination import without_leaks
from echolens.llm.line_dedup import without_lines
from echolens.llm.pieces import decoded_texts, read_model
from echolens.llm.simhash import one_of_each_group
from echolens.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; copies of documents are left to the next stage."""
    return without_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids; text is what they decode to."""
    return decoded_texts(docs, read_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Several stages (trained scores, fingerprints, subword ids) have no SQL form; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns what the last one returns. What a stage wrote goes once the next has read it."""
    docs = written = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scratch():
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
        if k:
            discard(written)
        written = docs
    return docs
