"""Token counts: an exact histogram of encoded lengths, from which suffix sums answer every limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import slices
from evidentia.llm.tokens import encoder
from evidentia.ship import ship


def length_histogram(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``length int, n_docs long``: documents by number of tokens, over all whole texts.

    A null or empty text has length 0; repeated rows count each time; an empty table gives no rows.
    Each task sends one row for each length it saw, so no key is hot.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer), Counter()
        for batch in slices(batches, "text"):
            seen.update(map(len, encode([t or "" for t in batch.column("text").to_pylist()])))
        if seen:
            yield pa.record_batch([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["length", "n"])

    ship(docs.sparkSession)
    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "length int, n long")
    return counted.groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, the answers at a context limit of L tokens.

    ``docs_at_least``/``tokens_at_least``: documents of L tokens or more and their tokens;
    ``tokens_total``: all tokens; ``tokens_truncated``: all tokens when documents are cut at L;
    ``share_up_to``: share of documents of at most L tokens. The table has one row for each distinct
    length, at most the longest document's length, whatever the number of documents.
    """
    down = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("length").cast("long") * F.col("n_docs")
    out = histogram.select(
        "length", "n_docs",
        F.sum("n_docs").over(down).alias("docs_at_least"), F.sum(tokens).over(down).alias("tokens_at_least"),
        F.sum("n_docs").over(whole).alias("_docs"), F.sum(tokens).over(whole).alias("tokens_total"),
    )
    return out.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("length").cast("long") * F.col("docs_at_least")).alias("tokens_truncated"),
        ((F.col("_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("_docs")).alias("share_up_to"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, docs_over, tokens_truncated`` for any limits, whether or not a document has that length."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit int")
    n, size, at = F.col("n_docs"), F.col("length").cast("long"), F.col("limit").cast("long")
    # A stated list of limits against the bounded histogram.
    pairs = histogram.join(F.broadcast(asked), F.lit(True), "right") if limits else histogram.join(asked, F.lit(True))
    return pairs.groupBy("limit").agg(
        F.coalesce(F.sum(F.when(size > at, n)), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.least(size, at) * n), F.lit(0)).alias("tokens_truncated"),
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the smallest length that at least this share of documents does not exceed."""
    sums = suffix_sums(histogram)
    picked = [F.min(F.when(F.col("share_up_to") >= q, F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)]
    one = sums.agg(*picked)
    rows = F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)])
    return one.select(F.inline(rows))
