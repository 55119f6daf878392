"""Corpus pipeline: quality, exact copies, near copies, source mix, packing. Every stage works on the written rows of the one before.

Every stage takes an empty table and gives none back, reads the key, text and source by name, and passes other columns on as they are. Null
texts count as empty; what a stage does with rows that repeat an id or have none is said below.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import exact_dedup, mixing, packing, quality, shingle_join
from marketloom.llm.tables import discard, noted, settled, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_left: list[str] = []


def stage(work: Stage) -> Stage:
    """A stage's input is written, so what the stage before it settled in the shared folder has no reader left and goes first."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _left)
        with noted() as paths:
            try:
                return work(spark, docs, sf_dir)
            finally:
                _left.extend(paths)

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Rows that repeat get one verdict; empty texts have weight 0, a null id is one like any other."""
    return quality.kept_rows(docs, table(spark, sf_dir, "labels"))


@stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the largest id, rows without an id as well."""
    return exact_dedup.kept_rows(docs)


@stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity of 0.8 or more. Every row is a document, so a text that shares only its
    id with one that goes stays, and so does one without an id that is like no other; empty texts all stay."""
    return shingle_join.kept_rows(docs, shingle_join.NEAR_COPIES)


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of sources; the written files keep it. A null source is one like any other."""
    return mixing.mixed_rows(docs)


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, cut along the order of the mix; an empty text is one separator."""
    return packing.pieces(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_copies", near_stage),
    ("source_mix", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # the classifier and the tokenizer have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, work in STAGES:
        with noted() as written:
            docs = settled(work(spark, docs, sf_dir), f"corpus-{name}")
        discard(spark, before)
        before = written
    discard(spark, _left)
    return docs
