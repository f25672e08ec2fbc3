"""The corpus pipeline: five stages, each over all documents that the one before has kept."""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, decontaminate, line_dedup, near_dup, quality_classifier
from tessella.llm.common import adopt, owning, reads, release, written
from tessella.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_running = threading.local()


def _stage(stage: Stage) -> Stage:
    """A stage owns the scratch tables that its result reads. They go when the next stage of this thread begins, whose
    ``docs`` are that result written and reread; the last stage's go when the interpreter ends. Nothing else is touched."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = _running.__dict__.get("made", [])
        if reads(docs, before):  # not stored in between: left for the interpreter's end
            adopt(before)
        elif stage is not STAGES[0][1].__wrapped__:
            release(before)
        with owning(until_exit=True) as made:
            out = stage(spark, docs, sf_dir)
        _running.made = made
        if stage is STAGES[-1][1].__wrapped__:
            adopt(made)
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, short=True)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(docs)


@_stage
def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", contamination),
    ("bpe encoding", encoding),
]

#: SQL expresses neither the classifier nor the encoding; tests/llm/test_pipeline.py holds the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
