"""A corpus from documents: quality, line dedup, near-duplicate documents, benchmark leaks, source mix.

Each stage works on what its predecessor kept, which is written as Parquet and read again, and returns its columns as they
were but for text and n_chars where lines were dropped. Null and empty texts pass the first stages like any others (the
classifier judges the empty text, they have no lines, shingles or leaks) and the mix takes no words of them. Documents
with null doc_id are treated by their text. Of repeated rows one stays, unless they are empty. Ties: the first by doc_id, then
by a hash of the text, stays. Very long texts: whole, like any other. Other columns pass, whatever their names. No documents:
no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.cut import marked, settled, small_batches
from webloom.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from webloom.tables import table

#: Near copies: so many per cent of the shingles of so many words are shared.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.accepted(docs, labels)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go, and with them documents of which nothing is left."""
    rows = line_dedup.deduped(docs)
    dropped = F.col(f"`{line_dedup.DROPPED}`")
    left = rows.where(dropped.isNull() | F.col("text").rlike(r"\S"))
    n_chars = F.when(dropped.isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return left.select(*(n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.representatives(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", _in_small_batches(quality_classifier)),
    ("line_dedup", _in_small_batches(drop_repeated_lines)),
    ("ngram_jaccard_join", _in_small_batches(one_of_each_group)),
    ("benchmark_decontamination", _in_small_batches(drop_leaks)),
    ("source_mix", _in_small_batches(mix_sources)),
]

#: The stages' models and joins can't be expressed in SQL; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. When a stage's output is stored, its predecessor's and its own tables go: at most two copies of the documents are there at once."""
    docs, mark = table(spark, sf_dir, "documents"), marked()
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name, mark)
    return docs
