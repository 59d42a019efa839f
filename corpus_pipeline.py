"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Each stage works on all rows that the one before it kept and returns the columns of documents; the last returns the
pieces of the packed sequences. A stage's result is to be written before the next stage is called: the intermediate
files of a stage are removed when a later one begins, unless that one still reads them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import mixing, packing, quality, secretscan, simhash
from plumbline.llm.common import cut
from plumbline.sources.scratch import Scope, scope

CACHED = 200_000  # pieces of text a packing worker remembers: less than alone, as workers serve all stages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_PAST: list[Scope] = []


def _tidy(spark: SparkSession, docs: DataFrame) -> None:
    """Remove the files of the stages before, as their results have been written; what ``docs`` reads stays."""
    for past in [p for p in _PAST if not p.feeds(docs)]:
        past.remove(spark)
        _PAST.remove(past)


def stage(run: Stage) -> Stage:
    @functools.wraps(run)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _tidy(spark, docs)
        with scope() as made:
            out = run(spark, docs, sf_dir)
        _PAST.append(made)
        return out

    return tidied


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


@stage
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by marks."""
    return secretscan.redact(docs)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: a row for every pass over a document, with the words taken in it."""
    return mixing.documents(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.digest(packing.pack(docs, cached=CACHED))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources", source_mix),
    ("packing", packed),
]

ORACLE_SQL = None  # language models, components and packing are beyond SQL; tests/llm holds the brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces. What a stage wrote for the next one goes when the one after that begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        made = step(spark, docs, sf_dir)
        with scope() as written:
            docs = cut(made, name.replace(" ", "-"))
        _tidy(spark, docs)
        _PAST.append(written)
    return STAGES[-1][1](spark, docs, sf_dir)
