"""Runs of words that repeat with a short period: Karp-Miller-Rosenberg names, and grid candidates extended by them.

1. A slice of texts is one sequence of words. Level 0 names a word by its text and itself; level k + 1 names the
   stretch of 2**(k + 1) words at a place by the pair of level k names of its halves. A stretch found once in its
   text gets no name: nothing equals it, nor anything that begins with it. So levels thin out quickly, and a
   stretch that crosses the border of two texts never has a name.
2. The longest common extension of two places is read off by descending levels: where names are equal, both
   places advance by 2**k. Backwards alike.
3. In a run of period p and length >= ``LEAST_TIMES`` * p, the words p apart agree on a stretch of (LEAST_TIMES - 1) * p
   places or more, so one multiple of that step lies in it. These grid places, for each period that the text's
   longest repeat allows, are the candidates; each is extended both ways to the whole run.
4. A stretch found by several periods is the run of the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import SPACES, let, refuse, slices, words_of
from evidentia.ship import ship

#: A run holds its period so often at least, and so many words at least.
LEAST_TIMES, LEAST_WORDS = 4, 6
#: Text bytes that are named at once, and grid places that are extended at once.
SLICE_BYTES, PLACES = 4 << 20, 1 << 20


def name_levels(word: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words at each place, -1 where the stretch is found once in its text."""
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    levels, width = [_named(text * (int(word.max(initial=0)) + 1) + word, np.arange(len(word)), len(word))], 1
    while True:
        last = levels[-1]
        at = np.flatnonzero(last[: max(0, len(last) - width)] >= 0)
        at = at[last[at + width] >= 0]
        above = _named(last[at].astype(np.int64) * (len(last) + 1) + last[at + width], at, len(last))
        if above.max(initial=-1) < 0:
            return levels
        levels.append(above)
        width *= 2


def _named(code: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Ranks of ``code`` at the places ``at``, -1 elsewhere and where a code stands once."""
    out = np.full(n, -1, np.int32)
    _, rank, times = np.unique(code, return_inverse=True, return_counts=True)
    out[at] = np.where(times[rank] > 1, rank, -1)
    return out


def _extend(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """Words that follow (or precede) the places ``i < j`` alike."""
    n, i, j = len(levels[0]), i.copy(), j.copy()
    total = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step, name = 1 << k, levels[k]
        inside = np.flatnonzero(i >= step if back else j < n)
        a, b = (i[inside] - step, j[inside] - step) if back else (i[inside], j[inside])
        same = inside[(name[a] == name[b]) & (name[a] >= 0)]
        total[same] += step
        i[same] += -step if back else step
        j[same] += -step if back else step
    return total


def find(word: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of all runs, by start and period; ``begin`` holds the texts' first places and the end."""
    levels = name_levels(word, begin)
    size = np.diff(begin)
    # The longest repeat of a text is shorter than 2**(highest level with a name in it + 1): no period reaches further.
    reach = np.zeros(len(size), np.int64)
    for k, name in enumerate(levels):
        named = np.concatenate([[0], np.cumsum(name >= 0)])
        reach = np.where(named[begin[1:]] > named[begin[:-1]], (2 << k) - 1, reach)
    step = LEAST_TIMES - 1
    most = np.where(size >= LEAST_WORDS, np.minimum(size // LEAST_TIMES, reach // step), 0)
    text = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    places = (size[text] - period - 1) // (step * period) + 1
    ends, found = np.cumsum(places), []
    at = 0
    while at < len(places):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - places[at] + PLACES, side="right")))
        n = places[at:to]
        p = np.repeat(period[at:to], n)
        i = np.repeat(begin[text[at:to]], n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * step * p
        same = (levels[0][i] == levels[0][i + p]) & (levels[0][i] >= 0)
        i, p = i[same], p[same]
        start, end = i - _extend(levels, i, i + p, True), i + p + _extend(levels, i, i + p, False)
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * p)
        found.append(np.unique(np.stack([start[long], end[long], p[long]]), axis=1))
        at = to
    start, end, p = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    order = np.lexsort((p[first], start[first]))
    return start[first][order], (end - start)[first][order], p[first][order]


def _analysed(text: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each text: its number of words, its runs, and its words without the repeats of runs."""
    flat, begin = words_of(text, lower=False)
    codes = flat.dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    start, length, period = find(np.asarray(codes.indices, dtype=np.int64), begin)
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)])[begin].astype(np.int32)), flat.filter(pa.array(kept)).cast(pa.string()))
    owner = np.searchsorted(begin, start, side="right") - 1
    runs = pa.StructArray.from_arrays([pa.array(start - begin[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(begin))).astype(np.int32)), runs)
    joined = pc.binary_join(whole, " ")
    return pa.array(np.diff(begin).astype(np.int64)), lists, pc.if_else(pc.is_valid(text), joined, pa.scalar(None, pa.string()))


def find_runs(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` and the columns ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are separated by ASCII white space and compared as they stand. A run is a stretch of at least ``LEAST_WORDS``
    words and ``LEAST_TIMES`` times its smallest period that no neighbouring word extends. ``collapsed`` holds the words,
    joined by single spaces, that no run contains after its first period; so runs of exactly the words given, whatever
    white space parts them. Null texts have no words, no runs and a null ``collapsed``; empty texts an empty one.
    Rows are kept, repeated ones too, and an empty table gives none. Columns of these names, in any case, are refused:
    give a ``prefix``. One text is one task's work, however long: about 4 bytes a word and level (the logarithm of
    its longest repeat) and the grid in blocks of ``PLACES``.
    """
    ship(docs.sparkSession)
    new = [prefix + c for c in ("n_words", "runs", "collapsed")]
    refuse(docs.columns, new)
    item = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
    schema = T.StructType([*docs.schema, T.StructField(new[0], T.LongType()), T.StructField(new[1], T.ArrayType(item, False)), T.StructField(new[2], T.StringType())])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            yield pa.record_batch([*batch.columns, *_analysed(batch.column(place))], names=[*batch.schema.names, *new])

    return docs.mapInArrow(run, schema)


def looped(doc_id: Column, text: Column) -> Column:
    """The texts on which the registered query is held: a tenth of them, by the id's hash, repeat a stretch of their words.

    With h = crc32 of the id and h % 10 = 0, word i >= a becomes word a + (i - a) % p, where g = h div 10, a = g % n and
    p = 1 + (n - a) div (3 + g % 8). A null id, and a text without words, stays as it is.
    """
    h = F.crc32(doc_id.cast("string"))

    def repeat(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = F.pmod(g, F.greatest(n, F.lit(1).cast("long")))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        loop = lambda v: F.transform(F.sequence(v["a"], v["n"] - 1), lambda i: F.get(words, (v["a"] + F.pmod(i - v["a"], v["p"])).cast("int")))
        made = let(F.struct(a.alias("a"), n.alias("n"), p.alias("p")), lambda v: F.array_join(F.concat(F.slice(words, F.lit(1), v["a"].cast("int")), loop(v)), " "))
        return F.when(n > 0, made).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(SPACES.replace("[", "[^", 1)), F.lit(0))
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.isNotNull(), let(words, repeat)).otherwise(text)


def digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_runs``, the longest run (ties: smallest start, then period; null without runs) and sha256 of runs and of what is left."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    top = found.select(doc_id, F.size("runs").cast("long").alias("n_runs"), best.alias("top"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))
    return top.select(
        doc_id, "n_runs", F.col("top.start").alias("start"), (-F.col("top.length")).alias("length"), F.col("top.period").alias("period"),
        F.floor(-1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
