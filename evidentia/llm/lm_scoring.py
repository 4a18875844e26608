"""LM scoring: a unigram over existing subword pieces; a text's probability sums all its segmentations.

Pieces never cross a word's end, so a text's marginal is the product of its words' marginals. Each
distinct word of the corpus runs through the lattice once; documents then add up word scores. Piece
probabilities are learned from the training fold; the vocabulary itself is read by path, never trained.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import fold_of, slices, words_of, written
from evidentia.ship import ship

SPACE = "▁"
#: Most words whose scores are sent to every task; the others are joined.
FREQUENT_WORDS = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a vocabulary file, bytes as <0xNN>; control pieces are left out."""
    sp = _processor(path or default_path())
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]


class Lattice:
    """Forward sums over all segmentations of a word, in natural logarithms."""

    def __init__(self, logp: dict[str, float]):
        self.logp, self.longest = logp, max((len(p) for p in logp if not p.startswith("<0x")), default=1)
        self.byte = [logp.get(f"<0x{b:02X}>", -40.0) for b in range(256)]

    def word(self, word: str) -> float:
        """log of the summed probability of every way to write ``word`` (with its leading space mark) in pieces."""
        text, get, longest = SPACE + word, self.logp.get, self.longest
        alpha = [0.0]
        for j in range(1, len(text) + 1):
            ways = [alpha[j - 1] + sum(self.byte[b] for b in text[j - 1].encode("utf-8", "surrogatepass"))]
            for i in range(max(0, j - longest), j):
                if (lp := get(text[i:j])) is not None:
                    ways.append(alpha[i] + lp)
            if len(ways) == 1:
                alpha.append(ways[0])
            else:
                top = max(ways)
                alpha.append(top + math.log(sum([math.exp(x - top) for x in ways])))
        return alpha[-1]


def word_counts(docs: DataFrame, text: str, train: str) -> DataFrame:
    """``word, n_train, n_all`` over all whole texts, lower-cased A-Z; each task sends each word of a slice once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            words, at = words_of(batch.column("text"))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            codes = np.asarray(coded.indices)
            flags = np.repeat(np.asarray(batch.column("train").cast(pa.int8())), np.diff(at))
            n = len(coded.dictionary)
            every, trained = np.bincount(codes, minlength=n), np.bincount(codes, weights=flags, minlength=n).astype(np.int64)
            for k in range(0, n, 50_000):
                yield pa.record_batch([coded.dictionary[k : k + 50_000].cast(pa.string()), pa.array(trained[k : k + 50_000]), pa.array(every[k : k + 50_000].astype(np.int64))], names=["word", "n_train", "n_all"])

    rows = docs.select(F.col(text).alias("text"), F.col(train).alias("train")).mapInArrow(count, "word string, n_train long, n_all long")
    return rows.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """``piece, n``: pieces of the training words as the vocabulary's own encoder cuts them, each word weighted by its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(path)
        seen = np.zeros(sp.get_piece_size(), np.float64)
        for batch in slices(batches, "word", 2 << 20):
            ids = sp.encode(batch.column("word").to_pylist(), num_threads=1)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
            seen += np.bincount(flat, weights=np.repeat(np.asarray(batch.column("n_train")), sizes), minlength=len(seen))
        at = np.flatnonzero(seen)
        if len(at):
            yield pa.record_batch([pa.array([sp.id_to_piece(int(i)) for i in at]), pa.array(seen[at].astype(np.int64))], names=["piece", "n"])

    rows = words.where("n_train > 0").select("word", "n_train").mapInArrow(count, "piece string, n long")
    return rows.groupBy("piece").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out_fold: int = 1, path: str | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Learning uses rows whose fold (crc32 of the id's text, mod 5) is not ``held_out_fold``. A null or
    empty text is its end token alone; null and repeated ids keep a row each; other columns are not
    read; an empty table gives no rows. ``score`` is log10 of the product of all words' lattice
    marginals and the end's probability; pieces unseen in training get the half count that smooths all.

    The scores of at most ``FREQUENT_WORDS`` words (the most frequent ones) travel to the tasks; every
    other word is joined by a shuffle, so the model may have any number of words.
    """
    ship(docs.sparkSession)
    path = path or default_path()
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (fold_of(F.col(doc_id)) == held_out_fold).alias("held_out"))
    words = written(word_counts(rows.withColumn("train", ~F.col("held_out")), "text", "train"))
    ends = rows.where(~F.col("held_out")).count()
    total, kinds = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count(F.when(F.col("n_train") > 0, 1))).first()
    total, kinds = total + ends, kinds + (1 if ends else 0)

    pieces = {p: 0 for p in vocabulary(path)}
    pieces |= {r["piece"]: r["n"] for r in piece_counts(words, path).collect() if r["piece"] in pieces}  # at most the vocabulary
    all_pieces = sum(pieces.values()) + ends + 0.5 * (len(pieces) + 1)
    logp = {p: math.log((n + 0.5) / all_pieces) for p, n in pieces.items()}
    base_of = lambda c: np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    end_base, end_lm, end_known = float(base_of(ends)), math.log10((ends + 0.5) / all_pieces), int(ends > 0)

    def lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log10 = Lattice(logp), math.log(10)
        for batch in batches:
            word, n = batch.column("word"), np.asarray(batch.column("n_train"))
            lm = [model.word(w) / log10 for w in word.to_pylist()]
            yield pa.record_batch([word, pa.array(base_of(n)), pa.array(lm, pa.float64()), pa.array((n > 0).astype(np.int32)), batch.column("n_all")], names=["word", "base", "lm", "known", "n_all"])

    scored = written(words.mapInArrow(lattice, "word string, base double, lm double, known int, n_all long"))
    octave = F.floor(F.log2("n_all") * 4).cast("int")
    held, least = 0, None
    for r in sorted(scored.groupBy(octave.alias("k")).count().collect(), key=lambda r: -r["k"]):  # a few hundred rows
        held += r["count"]
        if held > FREQUENT_WORDS:
            break
        least = r["k"]
    top = scored.where(octave >= (least if least is not None else 1 << 30)).select("word", "base", "lm", "known").toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast([top.column(c).to_numpy() for c in ("base", "lm", "known")] + [top.column("word").to_pylist()])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, lm, known, names = shared.value
        base, lm, known = (np.append(x, 0.0) for x in (base, lm, known))
        names = pa.array(names, pa.large_string())
        for batch in slices(batches, "text", 16 << 20):
            flat, at = words_of(batch.column("text"))
            found = pc.index_in(flat, value_set=names)
            rare = np.asarray(found.is_null())
            code = np.asarray(pc.fill_null(found, len(names)))
            sums = [np.add.reduceat(np.append(x[code], 0.0), at[:-1]) * (np.diff(at) > 0) for x in (base, lm, known)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)])[at].astype(np.int32)), flat.filter(pa.array(rare)).cast(pa.string()))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(at) + 1), pa.array(sums[2].round().astype(np.int64) + end_known), pa.array(sums[0] + end_base), pa.array(sums[1] + end_lm), lists],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "rare"],
            )

    partial = rows.mapInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, lm double, rare array<string>")
    partial = written(partial.withColumn("row", F.monotonically_increasing_id()))
    rare = partial.select("row", F.explode("rare").alias("word")).join(scored.select("word", "base", "lm", "known"), "word")
    none = lambda kind: F.lit(None).cast(kind)
    parts = partial.drop("rare").unionByName(
        rare.select("row", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"), "base", "lm")
    )
    return parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("lm").alias("score"),
    ).drop("row")
