"""Exact removal of repeated strings of ``length`` bytes, with deep-shallow suffix sorting.

Every window of ``length`` bytes is owned by one anchor, the smallest of its ``GRAM``-byte hashes, so
equal windows have equal anchors. Runs of windows with one anchor are intervals.

1. Each task cuts its documents (in chunks of about 1.5 MB) into intervals and sends the pair (anchor hash,
   content hash) of each, once for a chunk, to buckets of the hash space.
2. Buckets answer: an interval whose content stands elsewhere is covered; one whose anchor stands
   elsewhere with other contents is asked for its bytes.
3. The asked contents of an anchor meet in one task. All their windows are sorted, dealt to parts by ranges of their
   first bytes, and equal ones marked. An anchor with very many contents (a passage that a large share of
   all documents has) is split: its windows travel by their own 128-bit hashes, which spread evenly and decide.
4. Chunks remove what is covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import inverse, mix, powers, prefix_hash, release, slices, written
from evidentia.llm.near_duplicates import _squeeze, _unsqueeze
from evidentia.llm.suffix_sort import eights, equal_windows
from evidentia.ship import ship

GRAM = 32
CHUNK_BYTES = 3 << 19
#: Windows that are sorted at once.
SORT_AT_ONCE = 200_000
#: Contents of an anchor above which its windows travel by hash.
MANY = 2_000
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_COVERED, _ASKED, _SPLIT, _LONE = 1, 2, 4, 8


def _rolling(data: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Hash of the ``width`` bytes at each place; the last places are left out."""
    total = prefix_hash(data, base)
    with np.errstate(over="ignore"):
        return mix((total[width:] - total[:-width]) * powers(inverse(base), len(data) + 1)[: len(total) - width])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def intervals(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each interval of the documents in ``data``, anchor and content hash."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram = min(GRAM, length)
    hashes = _rolling(data, gram)
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_sliding_min(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int32)
    begins = np.concatenate([[0], ends[:-1]])
    fits = ends - begins >= length
    valid[begins[fits]] += 1
    np.subtract.at(valid, ends[fits] - length + 1, 1)
    inside = np.cumsum(valid)[: len(anchor)] > 0
    anchor[~inside] = -1
    # A document that ends where the next one's first window starts leaves no gap when its length is the window's.
    edge = np.zeros(len(anchor) + 1, bool)
    edge[begins[begins < len(edge)]] = True
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | edge[1 : len(anchor)]) + 1
    first = np.concatenate([[0], change])
    last = np.append(change, len(anchor)) - 1
    keep = anchor[first] >= 0
    first, last = first[keep], last[keep]
    at = anchor[first]
    total = prefix_hash(data, _OTHER)
    with np.errstate(over="ignore"):
        content = (total[last + length] - total[first]) * powers(inverse(_OTHER), len(data) + 1)[first]
        content = mix(content + (at - first).astype(np.uint64) * np.uint64(_BASE) + (last - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    # Anchors are minima, so their hashes are small: mixed again, they spread evenly over the buckets.
    return first, last, mix(hashes[at] + np.uint64(1)), content


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts in order, and where each text ends; null counts as empty."""
    blobs = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(blobs.buffers()[1], np.int64, len(blobs) + 1, blobs.offset * 8)
    if not blobs.buffers()[2]:
        return np.empty(0, np.uint8), np.zeros(len(blobs), np.int64)
    return np.frombuffer(blobs.buffers()[2], np.uint8)[off[0] : off[-1]], (off - off[0])[1:]


_CHUNK = "chunk long, kind int, bucket int, data binary, more binary"
_FIELDS = (("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary()), ("more", pa.binary()))


def _table(rows: list[tuple]) -> pa.Table:
    release()
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(_FIELDS, cols, strict=True)})


def _edges(buckets: int) -> np.ndarray:
    return ((np.arange(1, buckets, dtype=object) << 64) // buckets).astype(np.uint64) if buckets > 1 else np.empty(0, np.uint64)


def _cut(docs: DataFrame, length: int, buckets: int, chunk_bytes: int) -> DataFrame:
    """Kind 0: a chunk itself (bytes, ids, intervals, what is covered within it). Kind 1: its pairs for a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, pack = TaskContext.get().partitionId() << 40, zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text", chunk_bytes):
            data, ends = _bytes_of(batch.column("text"))
            # Equal texts within the chunk are worked on once.
            begins, seen, lone, twin = np.concatenate([[0], ends[:-1]]), {}, [], np.zeros(len(ends), np.int64)
            whole = data.tobytes()
            for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
                twin[i] = seen.setdefault(whole[a:b], len(lone))
                if twin[i] == len(lone):
                    lone.append(i)
            if len(lone) < len(ends):
                data = np.frombuffer(b"".join(whole[begins[i] : ends[i]] for i in lone), np.uint8)
                ends = np.cumsum((ends - begins)[lone])
            first, last, anchor, content = intervals(data, ends, length)
            copies = np.bincount(twin, minlength=len(ends))
            times = copies[np.searchsorted(ends, first, side="right")]
            order = np.lexsort((content, anchor))
            a, c = anchor[order], content[order]
            start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])) if len(a) else np.empty(0, np.int64)
            total = np.add.reduceat(times[order], start) if len(a) else np.empty(0, np.int64)
            here = np.zeros(len(first), bool)
            here[order] = np.repeat(total > 1, np.diff(np.append(start, len(a))))
            sink = pa.BufferOutputStream()
            about = pa.table({"doc_id": batch.column("doc_id"), "twin": pa.array(twin)})
            with pa.ipc.new_stream(sink, about.schema) as out:
                out.write_table(about)
            spans = _squeeze(first.astype(np.uint32), (last - first).astype(np.uint32), here.astype(np.uint8))
            sizes = [np.array([len(data), len(ends), len(spans)], np.int64).tobytes(), ends.astype(np.int64).tobytes(), spans]
            rows = [(chunk, 0, -1, pack.compress(data.tobytes()), b"".join(sizes) + sink.getvalue().to_pybytes())]
            a, c, total, index = a[start], c[start], np.minimum(total, 2).astype(np.uint8), order[start].astype(np.uint32)
            at = np.concatenate([[0], np.searchsorted(a, _edges(buckets)), [len(a)]])
            for b in range(buckets):
                s = slice(at[b], at[b + 1])
                if at[b + 1] > at[b]:
                    rows.append((chunk, 1, b, _squeeze(a[s], c[s], total[s], index[s]), None))
            chunk += 1
            yield from _table(rows).combine_chunks().to_batches()

    return docs.mapInArrow(run, _CHUNK)


def _answer(group: pa.Table, many: int) -> pa.Table:
    """A bucket's answers: which intervals are covered, which are asked for their bytes, and which of these stand alone."""
    chunks, parts = group.column("chunk").to_pylist(), [_unsqueeze(x, np.uint64, np.uint64, np.uint8, np.uint32) for x in group.column("data").to_pylist()]
    anchor, content, times, index = (np.concatenate(x) for x in zip(*parts, strict=True))
    owner = np.repeat(np.arange(len(chunks)), [len(p[0]) for p in parts])
    order = np.lexsort((content, anchor))
    anchor, content, times, index, owner = (x[order] for x in (anchor, content, times, index, owner))
    new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    new = new_anchor | np.concatenate([[True], content[1:] != content[:-1]])
    start = np.flatnonzero(new)
    sizes = np.diff(np.append(start, len(new)))
    total = np.repeat(np.add.reduceat(times.astype(np.int64), start), sizes)
    group_start = np.flatnonzero(new_anchor)
    contents = np.repeat(np.add.reduceat(new.astype(np.int64), group_start), np.diff(np.append(group_start, len(new))))
    flag = np.where((total > 1) & (times == 1), _COVERED, 0)
    flag |= np.where(new & (contents > 1), _ASKED | np.where(contents > many, _SPLIT, 0) | np.where(total == 1, _LONE, 0), 0)
    use = np.flatnonzero(flag)
    by = use[np.argsort(owner[use], kind="stable")]
    ends = np.searchsorted(owner[by], np.arange(len(chunks) + 1))
    rows = []
    for k, chunk in enumerate(chunks):
        part = by[ends[k] : ends[k + 1]]
        if len(part):
            rows.append((chunk, 2, -1, _squeeze(anchor[part], index[part], flag[part].astype(np.uint8)), None))
    return _table(rows)


def _answered(cut: DataFrame, many: int) -> DataFrame:
    return cut.where("kind = 1").groupBy("bucket").applyInArrow(lambda g: _answer(g, many), _CHUNK)


class _Chunk:
    def __init__(self, data: bytes, more: bytes):
        n, docs, packed = np.frombuffer(more, np.int64, 3).tolist()
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        self.ends = np.frombuffer(more, np.int64, docs, 24)
        at = 24 + 8 * docs
        self.first, self.more, self.here = _unsqueeze(more[at : at + packed], np.uint32, np.uint32, np.uint8)
        about = pa.ipc.open_stream(more[at + packed :]).read_all()
        self.doc_id, self.twin = about.column("doc_id").combine_chunks(), np.asarray(about.column("twin"))


def _rows(group: pa.Table, kind: int) -> list[tuple[bytes, bytes]]:
    part = group.filter(pc.equal(group.column("kind"), kind))
    return list(zip(part.column("data").to_pylist(), part.column("more").to_pylist(), strict=True))


def _contents(length: int, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        """A chunk sends the bytes it was asked for (kind 3), or their windows' hashes (kind 4)."""
        asked = [_unsqueeze(data, np.uint64, np.uint32, np.uint8) for data, _ in _rows(group, 2)]
        if not asked:
            return _table([])
        me = _Chunk(*_rows(group, 0)[0])
        anchor, index, flag = (np.concatenate(x) for x in zip(*asked, strict=True))
        use = (flag & _ASKED) > 0
        anchor, index, flag = anchor[use], index[use], flag[use]
        chunk, edges, rows = group.column("chunk")[0].as_py(), _edges(buckets), []
        order = np.argsort(anchor, kind="stable")
        anchor, index, flag = anchor[order], index[order], flag[order]
        plain = (flag & _SPLIT) == 0
        a, i, lone = anchor[plain], index[plain], (flag[plain] & _LONE > 0).astype(np.uint8)
        at = np.concatenate([[0], np.searchsorted(a, edges), [len(a)]])
        pack = zstandard.ZstdCompressor(level=1)
        for b in range(buckets):
            if at[b + 1] > at[b]:
                part = i[at[b] : at[b + 1]]
                first, more = me.first[part].astype(np.int64), me.more[part].astype(np.int64)
                text = b"".join(me.data[f : f + m + length].tobytes() for f, m in zip(first.tolist(), more.tolist(), strict=True))
                rows.append((chunk, 3, b, _squeeze(part, more.astype(np.uint32), lone[at[b] : at[b + 1]]), pack.compress(text)))
        i = index[~plain]
        if len(i):
            first, more = me.first[i].astype(np.int64), me.more[i].astype(np.int64)
            start = np.repeat(first - np.concatenate([[0], np.cumsum(more + 1)[:-1]]), more + 1) + np.arange(int((more + 1).sum()))
            one, two = _rolling(me.data, length)[start], _rolling(me.data, length, _OTHER)[start]
            order = np.argsort(one, kind="stable")
            one, two, start = one[order], two[order], start[order].astype(np.uint32)
            at = np.concatenate([[0], np.searchsorted(one, edges), [len(one)]])
            for b in range(buckets):
                s = slice(at[b], at[b + 1])
                if at[b + 1] > at[b]:
                    rows.append((chunk, 4, b, _squeeze(one[s], two[s], start[s]), None))
        return _table(rows)

    return run


def _equal(text: np.ndarray, starts: np.ndarray, length: int, at_once: int) -> np.ndarray:
    """Indices of the windows that have an equal one, sorted part by part of ranges of their first eight bytes."""
    parts = -(-len(starts) // at_once)
    if parts > 1:
        key = eights(text)[starts].astype(np.uint64)
        edges = np.sort(key[:: max(1, len(key) // (parts * 64))])
        part = np.searchsorted(edges[len(edges) // parts :: max(1, len(edges) // parts)], key, side="right")
        by = np.argsort(part, kind="stable")
        pieces = np.split(by, np.flatnonzero(np.diff(part[by])) + 1)
    else:
        pieces = [np.arange(len(starts))]
    out = [piece[np.fromiter(chain.from_iterable(equal_windows(text, starts[piece], length)), np.int64)] for piece in pieces]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _sorted(length: int, at_once: int):
    def run(group: pa.Table) -> pa.Table:
        """Equal windows among the contents of a bucket: starts within their interval (kind 5) or chunk (kind 6)."""
        out: list[tuple] = []
        ours = group.filter(pc.equal(group.column("kind"), 3))
        if ours.num_rows:
            unpack = zstandard.ZstdDecompressor()
            parts = [_unsqueeze(x, np.uint32, np.uint32, np.uint8) for x in ours.column("data").to_pylist()]
            index, more, lone = (np.concatenate(x) for x in zip(*parts, strict=True))
            owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            text = np.frombuffer(b"".join(unpack.decompress(x) for x in ours.column("more").to_pylist()), np.uint8)
            more = more.astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(more + length)[:-1]])
            windows = more + 1
            place = np.repeat(np.arange(len(index)), windows)
            shift = np.arange(int(windows.sum())) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
            flat = _equal(text, begin[place] + shift, length, at_once)
            flat = flat[lone[place[flat]] > 0] if len(flat) else flat
            flat = flat[np.argsort(owner[place[flat]], kind="stable")] if len(flat) else flat
            ends = np.searchsorted(owner[place[flat]], np.arange(len(parts) + 1)) if len(flat) else np.zeros(len(parts) + 1, np.int64)
            for k, chunk in enumerate(ours.column("chunk").to_pylist()):
                mine = flat[ends[k] : ends[k + 1]]
                if len(mine):
                    out.append((chunk, 5, -1, _squeeze(index[place[mine]], shift[mine].astype(np.uint32)), None))
        split = group.filter(pc.equal(group.column("kind"), 4))
        if split.num_rows:
            parts = [_unsqueeze(x, np.uint64, np.uint64, np.uint32) for x in split.column("data").to_pylist()]
            one, two, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            order = np.lexsort((two, one))
            same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            hit = np.zeros(len(one), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            for k, chunk in enumerate(split.column("chunk").to_pylist()):
                mine = np.sort(start[hit & (owner == k)])
                if len(mine):
                    out.append((chunk, 6, -1, _squeeze(mine), None))
        return _table(out)

    return run


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _removed(length: int, digest: bool):
    def run(group: pa.Table) -> pa.Table:
        me = _Chunk(*_rows(group, 0)[0])
        mark = np.zeros(len(me.data) + length + 1, np.int32)
        ranges = [np.flatnonzero(me.here)]
        for data, _ in _rows(group, 2):
            _, index, flag = _unsqueeze(data, np.uint64, np.uint32, np.uint8)
            ranges.append(index[(flag & _COVERED) > 0])
        for i in ranges:
            first = me.first[i].astype(np.int64)
            np.add.at(mark, first, 1)
            np.subtract.at(mark, first + me.more[i].astype(np.int64) + length, 1)
        starts = [me.first[i].astype(np.int64) + s for i, s in (_unsqueeze(d, np.uint32, np.uint32) for d, _ in _rows(group, 5))]
        starts += [_unsqueeze(d, np.uint32)[0].astype(np.int64) for d, _ in _rows(group, 6)]
        for s in starts:
            np.add.at(mark, s, 1)
            np.subtract.at(mark, s + length, 1)
        gone = np.cumsum(mark)[: len(me.data)] > 0
        begins = np.concatenate([[0], me.ends[:-1]]).astype(np.int64)
        removed = np.concatenate([[0], np.cumsum(gone)])
        opens = gone & ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        opens = opens.copy()
        at = begins[(begins < len(gone)) & (me.ends > begins)]
        opens[at] = gone[at]
        spans = np.concatenate([[0], np.cumsum(opens)])
        kept = []
        for a, b in zip(begins.tolist(), me.ends.tolist(), strict=True):
            rest = me.data[a:b] if removed[a] == removed[b] else me.data[a:b][~gone[a:b]]
            kept.append(hashlib.sha256(rest).digest() if digest else rest.tobytes())
        per = lambda x: pa.array((x[me.ends] - x[begins])[me.twin].astype(np.int64))
        return pa.table({"doc_id": me.doc_id, "n_bytes": pa.array((me.ends - begins)[me.twin]), "n_removed": per(removed), "n_spans": per(spans), "kept": pa.array([kept[t] for t in me.twin.tolist()], pa.binary())})

    return run


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, digest: bool = False, many: int = MANY, at_once: int = SORT_AT_ONCE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row: ``kept`` is what stays of its UTF-8 bytes,
    or with ``digest`` its sha256.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the input,
    the same text included; overlaps count and all strings are judged on the input. Matches never cross
    texts. Null texts are empty, texts under ``length`` bytes can't be covered, repeated rows cover each
    other, null ids stay, other columns are not read, and an empty table gives no rows. ``many``, ``at_once``
    and ``chunk_bytes`` change the work, not the result. One text is one chunk's work, however long.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(max(8, -(-total // (16 << 20))))
    cut = written(_cut(rows, length, buckets, chunk_bytes))
    chunks = cut.where("kind = 0")
    answers = written(_answered(cut, many))
    contents = chunks.unionByName(answers).groupBy("chunk").applyInArrow(_contents(length, buckets), _CHUNK)
    equal = written(contents.groupBy("bucket").applyInArrow(_sorted(length, at_once), _CHUNK))
    return chunks.unionByName(answers).unionByName(equal).groupBy("chunk").applyInArrow(_removed(length, digest), _OUT)
