"""A corpus pipeline: drop toxic documents, drop those of no determined language, keep one of each group of near copies,
drop documents that hold benchmark passages, encode the rest as token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, dartminhash, decontaminate, language, toxicity
from millrace.scratch import drop_scratch, temporary, write_table
from millrace.session import read_table

#: No SQL expresses the trained stages and the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.7; a null text is judged as an empty one.

    This stage, like all others but the last, returns whole rows whatever their other columns are called, judges repeated
    rows alike and gives an empty table for an empty one.
    """
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is determined (a null text, or one without letters, has none) with a score of 0.5 or more."""
    return language.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: that of the least id; a null text is an empty one."""
    return dartminhash.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap no benchmark item; null texts overlap none."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; a null text is an empty one."""
    return bpe.digest_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a Parquet table that the next one reads.

    A stage's own intermediate tables, and the result of the stage before, are deleted once its result is written.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary(spark) as scope:
            docs, path = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
            scope.keep(path)
        if before is not None:
            drop_scratch(spark, before)
        before = path
    return docs
