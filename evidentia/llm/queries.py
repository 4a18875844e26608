"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import oracle


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.quality_rules import apply_rules

    out = apply_rules(_documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_marks", "n_stop_words")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.token_counts import length_histogram, suffix_sums

    return suffix_sums(length_histogram(_documents(spark, sf_dir, "text")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.decontamination import find_leaks

    docs = _documents(spark, sf_dir, "doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.inline("leaks"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.suffix_dedup import dedup_substrings

    out = dedup_substrings(_documents(spark, sf_dir, "doc_id", "text"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.chat_format import format_chats

    out = format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select(F.col("conv").alias("conv_id"), F.col("at").alias("turn"), "part", "role", "opens", "rendered")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.packing import pack

    return pack(_documents(spark, sf_dir, "doc_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.line_dedup import dedup_lines

    out = dedup_lines(_documents(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.common import fold_of
    from evidentia.llm.quality_classifier import classify, train

    docs = _documents(spark, sf_dir, "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.lm_scoring import score

    return score(_documents(spark, sf_dir, "doc_id", "text"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.near_duplicates import near_duplicates

    return near_duplicates(_documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.periodic_runs import digests, find_runs, looped

    docs = _documents(spark, sf_dir, "doc_id", "text")
    return digests(find_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.merkle import checked, manifest, row_digest

    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = _documents(spark, sf_dir, *fields)
    tampers = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    changed = row_digest([F.when(tampers, F.translate("text", "\n", "")).otherwise(F.col("text")) if c == "text" else F.col(c) for c in fields])
    return checked(manifest(docs, fields, "source", "doc_id", presented=changed)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.llm.embedding_join import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_line_dedup, op3_token_counts, op4_benchmark_decontamination, op5_suffix_array_dedup, op6_chat_formatting, op7_best_fit_packing, op8_quality_classifier, op9_lm_scoring, op10_ngram_jaccard_join, op11_periodic_runs, op12_merkle_manifest, op13_embedding_near_dedup)
}
ORACLE_SQL: dict[str, str] = dict(oracle.ORACLE_SQL)
