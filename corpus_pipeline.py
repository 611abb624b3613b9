"""The training-data pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Rows that a stage rejects go; a document that line dedup leaves without a word goes too, as nothing of it is
left to train on. Null text fails the base rules. Null ids and languages, repeated rows, ties, empty texts and texts of any
length are treated as the operators' docstrings say; columns of other names ride along to packing,
which gives pieces alone. An empty table gives an empty result.

The tables that a stage works with live until the next stage is called, whose input has been written and read
again by then; run() also drops a stage's input once its result is written, so that the disk holds one stage's tables
at a time.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import decontaminate, line_dedup, near_dup, packing, quality
from vecloom.llm.common import collecting, discard, materialize, release, table

#: Tables of the stage that was called last.
_left: list[str] = []


def _stage(f):
    @functools.wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, *_left)
        _left.clear()
        with collecting() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return call


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@_stage
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate_lines(docs, min_words=1, drop_emptied=True)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs, size=5, percent=80)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", best_fit_packing)]

#: Tokenizing and the references of the quality rules can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if written is not None:
            release(written)
        written = docs
    discard(spark, *_left)
    _left.clear()
    return docs
