"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages (two chunks of 16 words, a step of one chunk) over the benchmark's
vocabulary. Three passes, none of which moves text: chunk frequencies; a randomised SVD of the
TF-IDF passage matrix A (each task adds up its part of A'(AG), and the sum gives the right singular
vectors); then passages and items are compared by cosine in the latent space, and candidates are
settled by the longest common subsequence with the item and by its answer. Latent retrieval can miss a
paraphrase; bounds that every leak meets (``_Bounds``) propose all that are left, so none is lost.
Items come in blocks, each with its own latent space; several blocks share the three passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import SPACES, fresh, refuse, slices, words_of
from evidentia.ship import ship

CHUNK = 16
EDGES = ".,;:!?\"'()[]"
#: Items and item words of one latent space, about, and such blocks that share a scan: they bound what is broadcast and what each
#: task sums. An item of more words is a block with few others.
BLOCK_ITEMS, BLOCK_WORDS, BLOCKS_AT_ONCE = 500, 20_000, 4
#: Passages compared with all items at once.
_ROWS = 4096
RANK = 64
#: Words in over this share of chunks carry no weight, except the KEPT rarest words of each item.
COMMON, KEPT = 0.002, 4
#: Share of an item window's latent weight, then of its inverse frequencies, that a candidate passage must
#: bring. A passage that holds an item covers 3/4 of one of its windows, and ``enough`` of the words in it.
COVER, OVERLAP = 0.15, 0.33
LEAKS = "array<struct<item_id:bigint,cosine:double,lcs:int,n_item_words:int,answer:boolean>>"


class Item(NamedTuple):
    item_id: int
    ids: tuple[int, ...]
    answer: tuple[int, ...]


class Benchmark(NamedTuple):
    """Items as word ids, and the vocabulary by id."""

    items: list[Item]
    words: list[str]


def _plain(words: pa.Array) -> pa.Array:
    """Words in lower case without marks at their ends; a word of marks alone is empty."""
    return pc.utf8_trim(pc.utf8_lower(words), characters=EDGES)


def tokens(text: str | None) -> list[str]:
    return [w for w in _plain(words_of(pa.array([text], pa.string()), lower=False)[0]).to_pylist() if w]


def read_items(rows: list[tuple[int, str, str | None]]) -> Benchmark:
    """(item_id, text, answer or None) -> ids; without an answer the item's last four words stand for it."""
    number: dict[str, int] = {}
    at = lambda text: tuple(number.setdefault(w, len(number)) for w in tokens(text))
    items = []
    for i, text, answer in rows:
        if ids := at(text):
            items.append(Item(i, ids, at(answer) or ids[-4:]))
    return Benchmark(items, list(number))


class Blocks(NamedTuple):
    """Benchmarks that share a scan: all their words, and each one's ids of these (-1: not its word; also the last)."""

    words: list[str]
    parts: list[Benchmark]
    local: list[np.ndarray]


def together(parts: list[Benchmark]) -> Blocks:
    number: dict[str, int] = {}
    at = [[number.setdefault(w, len(number)) for w in x.words] for x in parts]
    local = []
    for spots in at:
        ids = np.full(len(number) + 1, -1, np.int64)
        ids[spots] = np.arange(len(spots))
        local.append(ids)
    return Blocks(list(number), parts, local)


def _read(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids (-1: not the benchmark's), each text's first word, each word's chunk; chunks don't cross texts."""
    flat, at = words_of(texts, lower=False)
    coded = flat.dictionary_encode()  # each distinct word is made plain and looked up once
    kinds = pc.index_in(_plain(coded.dictionary), value_set=known)
    ids = np.asarray(pc.fill_null(kinds, -1))[np.asarray(coded.indices)] if len(flat) else np.empty(0, np.int32)
    sizes = np.diff(at)
    first = np.concatenate([[0], np.cumsum(-(-sizes // CHUNK))])
    chunk = np.repeat(first[:-1], sizes) + (np.arange(len(flat)) - np.repeat(at[:-1], sizes)) // CHUNK
    return ids, at, chunk


def _segment_sums(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``table[rows]`` over the segments that begin at ``starts``: one step adds a row to every segment that has it."""
    sizes = np.diff(np.append(starts, len(rows)))
    by = np.argsort(-sizes, kind="stable")
    begin, left = starts[by], -sizes[by]
    out = table[rows[begin]]
    step, many = 1, int(np.searchsorted(left, -1))
    while many > 64:
        out[:many] += table[rows[begin[:many] + step]]
        step += 1
        many = int(np.searchsorted(left, -step))
    for k in range(many):  # the few long ones
        out[k] += table[rows[begin[k] + step : begin[k] - left[k]]].sum(0)
    back = np.empty_like(out)
    back[by] = out
    return back


def _frequencies(docs: DataFrame, text: str, blocks: Blocks) -> tuple[np.ndarray, int]:
    """In how many chunks of the corpus each word stands, and the number of chunks."""
    words, n = blocks.words, len(blocks.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known, seen = 0, pa.array(words, pa.large_string()), np.zeros(n, np.int64)
        for batch in slices(batches, "text", 2 << 20):
            ids, at, chunk = _read(batch.column("text"), known)
            total += int((-(-np.diff(at) // CHUNK)).sum())
            hit = ids >= 0
            pair = np.unique(chunk[hit] * n + ids[hit])
            seen += np.bincount(pair % n, minlength=n)
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], total))], names=["word", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(n, np.int64), 0
    for r in rows:  # at most the vocabulary of the blocks that share a scan
        if r["word"] < 0:
            total = r["n"]
        else:
            out[r["word"]] = r["n"]
    return out, total


def _neighbours(own: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chunks in order: which have the next chunk of their text right after them, and which are their text's first."""
    text = np.searchsorted(first, own, side="right") - 1
    return np.flatnonzero((own[1:] == own[:-1] + 1) & (text[1:] == text[:-1])), own == first[text]


def _singular_vectors(docs: DataFrame, text: str, blocks: Blocks, weights: list[np.ndarray], rank: int) -> list[np.ndarray]:
    """Right singular vectors (words x rank) of each block's TF-IDF passage matrix, from one pass (Nystroem form)."""
    words, sizes = blocks.words, [len(x.words) for x in blocks.parts]
    starts = [np.random.default_rng(7).standard_normal((n, min(n, rank + 8))).astype(np.float32) for n in sizes]
    local = blocks.local

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = pa.array(words, pa.large_string()), [np.zeros_like(g) for g in starts]
        scaled = [g * w[:, None] for g, w in zip(starts, weights, strict=True)]
        for batch in slices(batches, "text", 2 << 20):
            every, at, chunk = _read(batch.column("text"), known)
            first = np.concatenate([[0], np.cumsum(-(-np.diff(at) // CHUNK))])
            for k, weight in enumerate(weights):
                ids = local[k][every]
                use = np.flatnonzero((ids >= 0) & (weight[ids] > 0))
                if not len(use):
                    continue
                mine, at_chunk = ids[use], chunk[use]
                new = np.concatenate([[True], at_chunk[1:] != at_chunk[:-1]])
                row, own = np.cumsum(new) - 1, at_chunk[new]
                sums = _segment_sums(scaled[k], mine, np.flatnonzero(new))
                # A word stands in the passage that its chunk begins and in the one that its chunk ends.
                follows, opens = _neighbours(own, first)
                made = np.where(opens, 1, 2).astype(np.float32)[:, None] * sums
                made[follows] += sums[follows + 1]
                made[follows + 1] += sums[follows]
                order = np.argsort(mine, kind="stable")
                begin = np.flatnonzero(np.concatenate([[True], mine[order][1:] != mine[order][:-1]]))
                which = mine[order][begin]
                out[k][which] += _segment_sums(made, row[order], begin) * weight[which][:, None]
        for k, n in enumerate(sizes):
            step = max(1, -(-n // 16))
            cuts = range(0, n, step)
            yield pa.record_batch([pa.array([k] * len(cuts), pa.int32()), pa.array([c // step for c in cuts], pa.int32()), pa.array([out[k][c : c + step].tobytes() for c in cuts], pa.binary())], names=["part", "block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"part": table.column("part")[:1], "block": table.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, block int, sums binary"
    rows = docs.select(F.col(text).alias("text")).mapInArrow(part, schema).groupBy("part", "block").applyInArrow(add, schema).collect()
    rows.sort(key=lambda r: (r["part"], r["block"]))
    out = []
    for k, start in enumerate(starts):
        got = [np.frombuffer(r["sums"], np.float64) for r in rows if r["part"] == k]
        y = np.concatenate(got).reshape(start.shape) if got else np.zeros(start.shape)
        core = start.astype(np.float64).T @ y
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        values = np.maximum(values, values.max() * 1e-9 if values.max() > 0 else 1.0)
        u, _, _ = np.linalg.svd(y @ vectors / np.sqrt(values), full_matrices=False)
        out.append(_fold_in(u[:, :rank], blocks.parts[k], weights[k]).astype(np.float32))
    return out


def _fold_in(u: np.ndarray, bench: Benchmark, weight: np.ndarray, least: float = 0.3) -> np.ndarray:
    """Directions are added for items of which the corpus' main directions hold less than ``least``, so none is out of reach."""
    poor = []
    for item in bench.items:
        words, times = np.unique(np.array(item.ids, np.int64), return_counts=True)
        row = times * weight[words].astype(np.float64)
        norm = np.linalg.norm(row)
        if norm > 0 and np.linalg.norm(row @ u[words]) < least * norm:
            poor.append(np.zeros(len(weight)))
            poor[-1][words] = row / norm
    if not len(poor):
        return u
    rest = np.array(poor)
    _, size, more = np.linalg.svd(rest - rest @ u @ u.T, full_matrices=False)
    return np.concatenate([u, more[size > 1e-3].T], axis=1)


def _lcs(masks: dict[int, int], size: int, ids: list[int]) -> int:
    """Length of the longest common subsequence, all of the item's words at once in one integer."""
    state = full = (1 << size) - 1
    for x in ids:
        if (m := masks.get(x)) is not None:
            u = state & m
            state = ((state + u) | (state - u)) & full
    return size - state.bit_count()


class _Bounds:
    """Candidates by bounds that every leak meets, whatever its words weigh.

    A stretch whose common subsequence has ``m`` of an item's ``s`` words misses at most ``s - m`` of them.
    So of the item's ``s - m + r`` rarest words at least ``r`` stand in it; the others need no look. A
    stretch that leaks by its answer holds the answer word for word. ``r`` is a quarter of ``m``: any
    choice is complete, a larger one reads more common words and proposes less.
    """

    def __init__(self, bench: Benchmark, idf: np.ndarray, enough: float):
        items, n = bench.items, len(bench.words)
        self.spans = np.array([_span(len(x.ids)) for x in items], np.int64)
        self.least, self.need = np.zeros((2, len(items)), np.int64)
        self.member = np.zeros((n + 1, -(-len(items) // 8)), np.uint8)  # a bit for each item; the last row: words that aren't the benchmark's
        rare, told = [], []
        for k, x in enumerate(items):
            size = len(x.ids)
            m = min(size, max(1, math.ceil(enough * size)))
            self.least[k], self.need[k] = max(1, m // 4), m
            self.member[list(x.ids), k // 8] |= 1 << k % 8
            by_rarity = sorted(x.ids, key=lambda w: (-idf[w], w))
            rare += [(w, k, 0) for w in dict.fromkeys(by_rarity[: size - m + int(self.least[k])])]
            told.append(max((idf[w], w, k, o) for o, w in enumerate(x.answer))[1:])
        self.rare, self.told = _postings(rare, n), _postings(told, n)
        longest = max((len(x.answer) for x in items), default=0)
        self.answers = np.array([[*x.answer, *[-2] * (longest - len(x.answer))] for x in items], np.int64).reshape(len(items), longest)

    def places(self, ids: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, from, to): every stretch of an item's span that leaks lies in one of these, within its text."""
        spots, which, _ = _meet(self.rare, ids)
        order = np.argsort(which * (len(ids) + 1) + spots)
        spots, which = spots[order], which[order]
        last = np.arange(len(spots)) + self.least[which] - 1
        inside = np.flatnonzero(last < len(spots))
        last = last[inside]
        close = (which[last] == which[inside]) & (spots[last] - spots[inside] < self.spans[which[inside]])
        inside, last = inside[close], last[close]
        text = np.searchsorted(at, spots[inside], side="right") - 1
        same = spots[last] < at[text + 1]
        likely = self._full(self._cells(text[same], which[inside][same], spots[inside][same], at), ids)

        spots, which, offset = _meet(self.told, ids)
        text = np.searchsorted(at, spots, side="right") - 1
        spots = spots - offset
        fits = spots >= at[text]
        text, which, spots = text[fits], which[fits], spots[fits]
        for j in range(self.answers.shape[1]):
            want = self.answers[which, j]
            there = (want == -2) | ((spots + j < at[text + 1]) & (ids[np.minimum(spots + j, len(ids) - 1)] == want))
            text, which, spots = text[there], which[there], spots[there]
        cells = np.unique(np.concatenate([likely, self._cells(text, which, spots, at)]), axis=0)
        return [tuple(x) for x in cells.tolist()]

    def _cells(self, text: np.ndarray, which: np.ndarray, spots: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of text, item, from, to; places that begin in the same half span are looked at together."""
        cells = np.unique(np.stack([text, which, (spots - at[text]) // (self.spans[which] // 2)], axis=1), axis=0)
        text, which, span = cells[:, 0], cells[:, 1], self.spans[cells[:, 1]]
        begin = at[text] + cells[:, 2] * (span // 2)
        return np.stack([text, which, np.maximum(at[text], begin - span), np.minimum(at[text + 1], begin + span // 2 + span)], axis=1)

    def _full(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The places with a stretch in which ``m`` words are the item's."""
        out = [cells[:0]]
        for block in range(0, len(cells), _ROWS):
            part = cells[block : block + _ROWS]
            which, lo, hi = part[:, 1], part[:, 2], part[:, 3]
            spots = lo[:, None] + np.arange((hi - lo).max() + 1)
            words = np.where(spots < hi[:, None], ids[np.minimum(spots, len(ids) - 1)], -1)
            many = np.cumsum(self.member[words, which[:, None] // 8] >> (which[:, None] % 8).astype(np.uint8) & 1, axis=1)
            ends = np.minimum(np.arange(many.shape[1]) + self.spans[which][:, None], many.shape[1] - 1)
            inside = np.take_along_axis(many, ends, axis=1) - many
            most = np.maximum(inside.max(axis=1), np.take_along_axis(many, np.minimum(self.spans[which][:, None] - 1, many.shape[1] - 1), axis=1)[:, 0])
            out.append(part[most >= self.need[which]])
        return np.concatenate(out)


def _span(size: int) -> int:
    """Words in a stretch of 1.5 item lengths."""
    return size + size // 2 + 2


def _postings(rows: list[tuple[int, int, int]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, item, offset) by word: where each word's rows begin (words that aren't the benchmark's have none), items, offsets."""
    table = np.array(sorted(rows), np.int64).reshape(len(rows), 3)
    starts = np.searchsorted(table[:, 0], np.arange(n + 1))
    return np.append(starts, len(table)), table[:, 1], table[:, 2]


def _meet(postings: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's place with each of its rows: places, items, offsets."""
    starts, items, offsets = postings
    sizes = np.diff(starts)
    spots = np.flatnonzero((ids >= 0) & (sizes[ids] > 0))
    many = sizes[ids[spots]]
    row = np.repeat(starts[ids[spots]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.repeat(spots, many), items[row], offsets[row]


class Searcher:
    """What a task needs for the last pass."""

    def __init__(self, bench: Benchmark, weight: np.ndarray, idf: np.ndarray, vectors: np.ndarray, cosine: float, enough: float, with_answer: float):
        self.bench, self.cosine, self.enough, self.with_answer = bench, cosine, enough, with_answer
        self.weight, self.project = weight, vectors * weight[:, None]
        rows, owner, words, shares = [], [], [], []
        for k, item in enumerate(bench.items):
            ids = np.array(item.ids)
            for at in range(0, max(1, len(ids) - CHUNK), CHUNK):
                part = ids[at : at + 2 * CHUNK]
                rows.append(self.project[part].sum(0))
                owner.append(k)
                part = np.unique(part)
                words.append(np.pad(part, (0, 2 * CHUNK - len(part)), constant_values=-2))
                shares.append(np.pad(idf[part] / max(idf[part].sum(), 1e-9), (0, 2 * CHUNK - len(part))))
        z = np.array(rows, np.float32).reshape(len(rows), vectors.shape[1])
        size = np.linalg.norm(z, axis=1, keepdims=True)
        self.items, self.sizes, self.owner = z / np.where(size > 0, size, 1), size.ravel(), np.array(owner)
        #: Of each item window, its words and what each brings: two rows of a window's length, whatever the vocabulary.
        self.words, self.shares = np.array(words, np.int32).reshape(len(rows), 2 * CHUNK), np.array(shares, np.float32).reshape(len(rows), 2 * CHUNK)
        self.bounds = _Bounds(bench, idf, enough)
        self.masks: list[dict[int, int]] = []
        for item in bench.items:
            masks: dict[int, int] = {}
            for k, x in enumerate(item.ids):
                masks[x] = masks.get(x, 0) | 1 << k
            self.masks.append(masks)

    def _brought(self, passages: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """What each passage's words bring of its window."""
        out = np.empty(len(windows), np.float32)
        for block in range(0, len(windows), 1024):
            mine = windows[block : block + 1024]
            met = (passages[block : block + 1024, :, None] == self.words[mine][:, None, :]).sum(1)
            out[block : block + 1024] = (met * self.shares[mine]).sum(1)
        return out

    def settle(self, k: int, ids: np.ndarray, lo: int, hi: int) -> tuple[int, bool] | None:
        """The best common subsequence within 1.5 item lengths inside ids[lo:hi], if it is enough."""
        item, size = self.bench.items[k], len(self.bench.items[k].ids)
        span = _span(size)
        words = ids[max(0, lo) : hi].tolist()
        most = _lcs(self.masks[k], size, words)  # no stretch inside has more
        if most < self.with_answer * size or (most < self.enough * size and not _has(words, item.answer)):
            return None
        best, answered = 0, False
        for at in range(0, max(1, len(words) - span + 1)):
            part = words[at : at + span]
            n = _lcs(self.masks[k], size, part)
            found = n >= self.with_answer * size and _has(part, item.answer)
            if (n >= self.enough * size, n) > (best >= self.enough * size, best) or (found and not answered):
                best, answered = max(n, best), answered or found
        return (best, answered) if best >= self.enough * size or answered else None

    def likeness(self, k: int, ids: np.ndarray, lo: int, hi: int) -> float:
        """The best cosine of a passage inside ids[lo:hi] with a window of the item."""
        mine, best = self.items[self.owner == k], 0.0
        for at in range(lo, max(lo + 1, hi - CHUNK), CHUNK):
            part = ids[at : min(hi, at + 2 * CHUNK)]
            z = self.project[part[part >= 0]].sum(0)
            best = max(best, float((mine @ z).max() / max(float(np.linalg.norm(z)), 1e-9)))
        return best

    def leaks(self, ids: np.ndarray, at: np.ndarray, chunk: np.ndarray) -> list[list[dict[str, Any]]]:
        """The leaked items of each text (as ``_read`` gives them, with the block's own ids), each once, by item order."""
        out: list[dict[int, dict[str, Any]]] = [{} for _ in range(len(at) - 1)]
        use = np.flatnonzero((ids >= 0) & (self.weight[ids] > 0)) if len(ids) else np.empty(0, np.int64)
        if len(use) and len(self.items):
            mine = chunk[use]
            new = np.concatenate([[True], mine[1:] != mine[:-1]])
            own, sums = mine[new], _segment_sums(self.project, ids[use], np.flatnonzero(new))
            # A passage is a chunk with the next one; a passage whose first chunk is blank starts one before.
            padded = np.append(ids, -1)
            sizes = -(-np.diff(at) // CHUNK)
            first = np.concatenate([[0], np.cumsum(sizes)])
            doc = np.searchsorted(first, own, side="right") - 1
            pair = np.zeros_like(sums)
            follows, _ = _neighbours(own, first)
            pair[follows] = sums[follows + 1]
            least = np.where(self.sizes > 0, COVER * self.sizes, np.inf).astype(np.float32)
            for block in range(0, len(own), _ROWS):
                z = sums[block : block + _ROWS] + pair[block : block + _ROWS]
                length = np.linalg.norm(z, axis=1, keepdims=True)
                dot = z @ self.items.T
                where = np.nonzero(dot >= np.maximum(self.cosine * length, least))
                score = dot[where] / np.maximum(length[where[0], 0], 1e-9)
                starts = at[doc[block : block + _ROWS]] + (own[block : block + _ROWS] - first[doc[block : block + _ROWS]]) * CHUNK
                spots = starts[where[0]][:, None] + np.arange(2 * CHUNK)
                spots = np.where(spots < at[doc[block + where[0]] + 1][:, None], spots, len(ids))
                sure = np.flatnonzero(self._brought(padded[spots].astype(np.int32), where[1]) >= OVERLAP)
                for r, c, s in zip(where[0][sure].tolist(), where[1][sure].tolist(), score[sure].tolist(), strict=True):
                    d, k = int(doc[block + r]), int(self.owner[c])
                    if k in out[d]:
                        continue
                    size = len(self.bench.items[k].ids)
                    begin = int(starts[r])
                    lo, hi = max(int(at[d]), begin - size), min(int(at[d + 1]), begin + 2 * CHUNK + size)
                    if settled := self.settle(k, ids, lo, hi):
                        out[d][k] = {"item_id": self.bench.items[k].item_id, "cosine": float(s), "lcs": settled[0], "n_item_words": size, "answer": settled[1]}
        for d, k, lo, hi in self.bounds.places(ids, at) if len(ids) and len(self.bench.items) else ():
            if k not in out[d] and (settled := self.settle(k, ids, lo, hi)):
                out[d][k] = {"item_id": self.bench.items[k].item_id, "cosine": self.likeness(k, ids, lo, hi), "lcs": settled[0], "n_item_words": len(self.bench.items[k].ids), "answer": settled[1]}
        return [[x[k] for k in sorted(x)] for x in out]


def _has(words: list[int], part: tuple[int, ...]) -> bool:
    n = len(part)
    return any(words[i] == part[0] and tuple(words[i : i + n]) == part for i in range(len(words) - n + 1))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None,
    cosine: float = 0.3, enough: float = 0.6, with_answer: float = 0.45, rank: int = RANK, column: str = "leaks",
) -> DataFrame:
    """``docs`` with ``leaks``, the benchmark items that each text repeats or paraphrases.

    An item leaks where its longest common subsequence with a stretch of 1.5 item lengths covers
    ``enough`` of its words, or ``with_answer`` of them and its answer stands there word for word. Every
    such item is found; ``cosine`` only says which candidates latent retrieval brings.
    Words compare lower-cased A-Z and without marks at their ends. All whole texts are searched. Rows
    stay (nulls, repeated ids, empty texts have no leaks of their own), extra columns stay, and a column
    named like ``column`` is an error. Items without words, or with a null id or text, are left out;
    repeated items count once. The benchmark is worked on in blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_WORDS`` words,
    ``BLOCKS_AT_ONCE`` a scan, which bounds all that is broadcast, however long items are (a single one is not cut).
    """
    ship(docs.sparkSession)
    refuse(docs.columns, [column])
    picked = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a"))
    picked = picked.where(F.col("i").isNotNull() & F.col("t").isNotNull())
    size = picked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(F.split(F.trim("t"), SPACES))), F.lit(0)).alias("words")).first()
    blocks = int(max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["words"] // BLOCK_WORDS)))
    block = F.pmod(F.xxhash64("i"), F.lit(blocks))
    out = docs.withColumn(column, F.array().cast(LEAKS))
    for b in range(0, blocks, BLOCKS_AT_ONCE):
        rows = picked.where((block >= b) & (block < b + BLOCKS_AT_ONCE)).select(block.alias("b"), "i", "t", "a").distinct().collect()
        by_block = [sorted((tuple(r)[1:] for r in rows if r["b"] == k), key=lambda r: (r[0], r[1])) for k in range(b, b + BLOCKS_AT_ONCE)]
        shared = together([x for x in map(read_items, by_block) if x.items])
        if not shared.parts:
            continue
        seen, total = _frequencies(docs, text, shared)
        weights = [word_weights(x, seen[np.flatnonzero(ids[:-1] >= 0)][np.argsort(ids[ids >= 0])], total) for x, ids in zip(shared.parts, shared.local, strict=True)]
        vectors = _singular_vectors(docs, text, shared, [w for w, _ in weights], rank)
        searchers = [Searcher(x, w, idf, v, cosine, enough, with_answer) for x, (w, idf), v in zip(shared.parts, weights, vectors, strict=True)]
        out = _search(out, shared, searchers, text, column)
    return out


def word_weights(bench: Benchmark, seen: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights in the passage matrix, and plain inverse chunk frequencies. In the matrix common words weigh nothing unless they are among an item's rarest."""
    idf = np.log((2 + total) / (1 + seen))
    kept = {x for item in bench.items for x in sorted(set(item.ids), key=lambda x: (seen[x], x))[:KEPT]}
    common = seen > COMMON * total
    common[sorted(kept)] = False
    return np.where(common, 0.0, idf).astype(np.float32), idf.astype(np.float32)


def _search(docs: DataFrame, blocks: Blocks, searchers: list[Searcher], text: str, column: str) -> DataFrame:
    spark = docs.sparkSession
    shared, names = spark.sparkContext.broadcast((blocks.words, blocks.local, searchers)), docs.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, local, found_by = shared.value
        known = pa.array(words, pa.large_string())
        for batch in slices(batches, text, 2 << 20):
            every, at, chunk = _read(batch.column(text), known)
            kept = list(batch.columns)
            place = names.index(column)
            found = kept[place].to_pylist()
            for ids, s in zip(local, found_by, strict=True):
                found = [o + f for o, f in zip(found, s.leaks(ids[every], at, chunk), strict=True)]
            kept[place] = pa.array(found, kept[place].type)
            yield pa.record_batch(kept, names=names)

    return docs.mapInArrow(search, T.StructType(docs.schema.fields))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options: Any) -> DataFrame:
    """``docs`` without the rows that leak an item; the same columns, all other rows."""
    column = fresh(docs.columns, "leaks")
    return find_leaks(docs, benchmark, column=column, **options).where(F.size(column) == 0).drop(column)
