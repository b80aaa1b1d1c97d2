"""The thin queries of this folder's operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .secrets import scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out_languages

    return held_out_languages(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import classes

    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge, train

    documents = table(spark, sf_dir, "documents")
    return judge(documents, train(documents, table(spark, sf_dir, "labels")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_t")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .suffix_dedup import dedup_strings

    found = dedup_strings(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["z"] - s["a"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import passage_digests

    return passage_digests(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_language_id, op3_minhash_near_dedup, op4_quality_rules, op5_html_extraction, op6_sentencepiece, op7_benchmark_decontamination, op8_suffix_dedup, op9_token_counts, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {}
