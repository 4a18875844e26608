"""Best-fit packing by a grouping genetic algorithm over lengths.

Only lengths decide how documents share sequences, so a genome is a list of (pattern, copies): a
pattern is the lengths put in one sequence. Its size depends on the number of distinct lengths (below
the capacity), not on the number of documents; the histogram is all that the driver sees.
"""

from __future__ import annotations

import json
import random
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import slices, small, written
from evidentia.llm.tokens import encoder
from evidentia.ship import ship

Genome = list[tuple[tuple[int, ...], int]]
END_ID = 0


def best_fit(left: dict[int, int], capacity: int, rng: random.Random | None = None) -> Genome:
    """Packs lengths (length -> count): the largest length opens a sequence, then the largest that still
    fits fills it, as often as the counts allow at once. With ``rng`` other lengths may open or fill."""
    left = {s: n for s, n in left.items() if n > 0}
    sizes, out = sorted(left), []
    while sizes:
        first = sizes[-1] if rng is None else sizes[-1 - min(int(rng.expovariate(0.5)), len(sizes) - 1)]
        used, room = Counter([first]), capacity - first
        at = bisect_right(sizes, room) - 1
        while at >= 0:
            s = sizes[at]
            if used[s] < left[s] and not (rng and at and rng.random() < 0.1):
                used[s] += 1
                room -= s
                at = bisect_right(sizes, room) - 1
            else:
                at -= 1
        copies = min(left[s] // k for s, k in used.items())
        out.append((tuple(sorted(used.elements(), reverse=True)), copies))
        for s, k in used.items():
            left[s] -= k * copies
            if not left[s]:
                del left[s]
                sizes.pop(bisect_right(sizes, s) - 1)
    return out


def bins(genome: Genome) -> int:
    return sum(n for _, n in genome)


def fitness(genome: Genome, capacity: int) -> tuple[int, float]:
    """Fewer sequences first; then the fuller the full ones are, the better (smaller is better)."""
    return bins(genome), -sum(n * (sum(p) / capacity) ** 2 for p, n in genome)


def crossover(a: Genome, b: Genome, counts: dict[int, int], capacity: int, rng: random.Random) -> Genome:
    """Whole well-filled sequences of ``b`` go into the child first; sequences of ``a`` follow as far as
    their documents are not there already; what both lost is packed by best fit."""
    left, child = dict(counts), Counter()

    def take(pattern: tuple[int, ...], copies: int) -> None:
        need = Counter(pattern)
        n = min([copies, *(left[s] // k for s, k in need.items())])
        if n > 0:
            child[pattern] += n
            for s, k in need.items():
                left[s] -= k * n

    for pattern, copies in b:
        fill = sum(pattern) / capacity
        if fill > 0.995 and rng.random() < 0.5:
            take(pattern, copies)
    for pattern, copies in sorted(a, key=lambda x: -sum(x[0])):
        if sum(pattern) >= 0.98 * capacity:
            take(pattern, copies)
    for pattern, copies in best_fit(left, capacity, rng if rng.random() < 0.5 else None):
        child[pattern] += copies
    return list(child.items())


def evolve(counts: dict[int, int], capacity: int, seed: int, elites: list[Genome], population: int = 6, children: int = 12) -> Genome:
    """One island: a population of best-fit packings and immigrants, steady-state crossover, its best genome."""
    rng = random.Random(seed)
    group = [*elites, best_fit(counts, capacity)]
    while len(group) < population:
        group.append(best_fit(counts, capacity, rng))
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    for _ in range(children):
        group.sort(key=lambda g: fitness(g, capacity))
        if bins(group[0]) <= least:
            break
        a, b = rng.sample(group[: max(2, population // 2 + 1)], 2)
        child = crossover(a, b, counts, capacity, rng)
        if fitness(child, capacity) < fitness(group[-1], capacity):
            group[-1] = child
    return min(group, key=lambda g: fitness(g, capacity))


def solve(spark, counts: dict[int, int], capacity: int, islands: int = 4, epochs: int = 2) -> Genome:
    """Islands run as tasks; between epochs the best genome of each moves on to the next island."""
    if not counts:
        return []
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    best, elites = best_fit(counts, capacity), [[] for _ in range(islands)]
    for epoch in range(epochs):
        if bins(best) <= least:
            break

        def run(batches: Iterator[pa.RecordBatch], epoch: int = epoch, elites: list[list[Genome]] = elites) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column("id").to_pylist():
                    got = evolve(counts, capacity, 1000 * epoch + i, elites[i])
                    yield pa.record_batch([pa.array([i], pa.int64()), pa.array([json.dumps(got)])], names=["island", "genome"])

        rows = spark.range(0, islands, 1, islands).mapInArrow(run, "island long, genome string").collect()
        found = [[(tuple(p), n) for p, n in json.loads(r["genome"])] for r in sorted(rows, key=lambda r: r["island"])]
        best = min([best, *found], key=lambda g: fitness(g, capacity))
        elites = [[found[i - 1], best] for i in range(islands)]
    return best


def cut(docs: DataFrame, doc_id: str, text: str, capacity: int, tokenizer: str | None) -> DataFrame:
    """Pieces of every document: ids of the whole text, then ``END_ID``; a document over ``capacity`` is cut
    into pieces of ``capacity`` ids, the remainder first. ``part`` and ``rank`` number equal lengths within a task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in slices(batches, "text"):
            doc, piece, start, length, crc, rank = [], [], [], [], [], []
            for d, ids in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                data = np.array([*ids, END_ID], "<u4")
                at, to, k = 0, (len(data) - 1) % capacity + 1, 0
                while at < len(data):
                    n = to - at
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(data[at:to]))
                    rank.append(seen[n])
                    seen[n] += 1
                    at, to, k = to, to + capacity, k + 1
            yield pa.record_batch(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, rank)), pa.array([part] * len(doc), pa.int32())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, part int"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, schema)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str | None = None, islands: int = 4, epochs: int = 2) -> DataFrame:
    """Every document's pieces with the sequence and offset they are packed at.

    Null and empty texts are one end id; null and repeated ids stay as rows of their own; an empty
    table gives no rows; other columns are not read. Sequences are filled from offset 0 without gaps.

    Pieces are written once; equal lengths are numbered within each task and by running totals across
    tasks, so one hot length is never gathered. The genome becomes at most a few thousand ranges of
    numbers, and each piece finds its place by binary search.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    found = written(cut(docs, doc_id, text, capacity, tokenizer))
    per_part = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    full = counts.pop(capacity, 0)
    genome = solve(spark, counts, capacity, islands, epochs)

    by_size: dict[int, list[tuple[int, int]]] = {capacity: [(0, 0)]} if full else {}
    first = full
    copies: dict[int, list[int]] = {capacity: [full]} if full else {}
    for pattern, n in genome:
        offset = 0
        for s in pattern:
            by_size.setdefault(s, []).append((first, offset))
            copies.setdefault(s, []).append(n)
            offset += s
        first += n
    place = {s: (np.concatenate([[0], np.cumsum(copies[s])[:-1]]), np.array([x[0] for x in v]), np.array([x[1] for x in v])) for s, v in by_size.items()}

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("base").to_numpy() + batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                at, (lo, base, off) = np.flatnonzero(length == s), place[int(s)]
                k = np.searchsorted(lo, number[at], side="right") - 1
                sequence[at], offset[at] = base[k] + number[at] - lo[k], off[k]
            yield pa.record_batch([*(batch.column(c) for c in _OUT), pa.array(sequence), pa.array(offset)], names=[*_OUT, "sequence_id", "offset"])

    numbered = found.join(small(starts.select("part", "length", "base")), ["part", "length"])
    return numbered.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


_OUT = ["doc_id", "piece", "start", "length", "ids_crc32"]
