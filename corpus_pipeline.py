"""The corpus pipeline: quality rules, line dedup, near dedup, decontamination, piece encoding. Part of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfdate.llm import decontaminate, line_dedup, near_dedup, pieces, quality
from shelfdate.llm.common import dropped, table, written
from shelfdate.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the regression pass. The regression learns from this stage's documents."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the chunks and pairs of lines that an earlier place has."""
    return line_dedup.dedup_passages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return pieces.piece_digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: The regression, ProbMinHash and the piece model have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each stage's result written as Parquet in the shared folder, read by the next and removed when that is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
