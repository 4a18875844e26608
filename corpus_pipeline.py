"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Quality classification, line dedup, near-duplicate removal and decontamination keep the columns of
``documents``; packing returns the pieces with their places. Each stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import clear_prefix, written
from evidentia.llm.decontamination import decontaminate
from evidentia.llm.line_dedup import dedup_lines
from evidentia.llm.near_duplicates import drop_near_duplicates
from evidentia.llm.packing import pack
from evidentia.llm.quality_classifier import classify, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, rejects are dropped.

    Without labels outside the held-out fold, or with one class only, the model is a constant and rejects none or all by the
    classes' rate. Null and empty texts are scored as texts without words; repeated rows go or stay together.
    """
    model, prefix = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), clear_prefix(docs.columns, ["score", "predicted"])
    return classify(docs, model, prefix=prefix).where(F.col(f"{prefix}predicted") == 1).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines are cut from the texts; ``n_chars`` follows where a text has changed. No row goes: a text of
    boilerplate alone becomes empty, null texts stay null, a null source counts as one."""
    prefix = clear_prefix(docs.columns, ["n_lines", "n_removed"])
    out = dedup_lines(docs, prefix=prefix)
    if "n_chars" in docs.columns:
        changed = F.when(F.col(f"{prefix}n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id (a null id comes last); null and
    empty texts link with nothing and all stay, of repeated rows one."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item are dropped; an empty benchmark drops none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row a piece. A null or empty text is its end token alone."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]
#: The trained classifier, the latent retrieval and the packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
