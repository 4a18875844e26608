"""Exact Jaccard join of word n-gram sets by token-combination prefixes, and its connected components.

1. Each task hashes the shingles of its documents, collapses equal sets within a chunk of documents,
   and sends sorted, packed tokens to buckets of the hash space. A token frequent within a chunk is sent
   as one count.
2. Each bucket counts its tokens and returns those found twice or more to their chunks. Tokens found
   once can't be shared, so a document can only link if 3/4 of its tokens come back.
3. Remaining sets are ordered rare tokens first (by count, then hash), frequent tokens last (by hash).
   Rare tokens of the prefix of n - ceil(0.75 n) + 1 tokens are signatures of their own; frequent
   tokens only as combinations of two that follow each other, in the longer prefix of n/2 + 2. Let x and
   y be the tokens that only one of two linked sets has: 2x + y <= n/2. The first shared token lies in
   both short prefixes. If it is rare it is a shared signature. If not, all shared tokens are frequent;
   of the pairs of neighbours among those in the longer prefix at most x + y are parted by other
   tokens, so at least one pair is left, and it is a shared signature. Then 3/4 of both sets' tokens are frequent
   too; other sets (such as pages that share half their text with very many) need no combinations and
   stay out of these large groups.
4. Sets that share a signature are verified: small groups pair by pair, large ones against a pivot first.
   Then only sets outside the pivot's component are compared with sets of other components, and by the
   triangle inequality of the Jaccard distance only those whose distances to the pivot differ by 0.25 at
   most, and by numbers of repeated tokens in classes of the hash space, of which two sets share the
   smaller at most. So a group of near copies takes about as many checks as it has members, and no link that connects
   different components is lost. Groups of the same sets (near copies share many signatures) count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import fresh, hash64, mix, release, slices, small, split_join, words_of, written
from evidentia.ship import ship

#: Times a token must be found to be frequent. Any value gives the same links.
FREQUENT = 64
#: Up to so many sets a group is compared pair by pair.
PAIRWISE = 20
#: Classes of tokens (by hash) whose numbers, up to so many each, bound what two sets share.
CLASSES, LEVELS = 128, 8
_LONGS = CLASSES * LEVELS // 64
#: Members of a large group that sets outside its main component are tried against before all others.
MORE_PIVOTS = 12
#: Members of a large group's last comparison that one task tries against the others.
DEALT = 4_000
#: Rows up to which a table with a sketch (17 longs) a row is broadcast.
SMALL_SKETCHES = 100_000
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a text of fewer words has one, without words none."""
    words, at = words_of(texts)
    h = hash64(words)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            rolled += h[k : k + len(rolled)] * _STEP[k % 5] + np.uint64(k)
        rolled = mix(rolled)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(rolled[a : b - size + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for x in h[a:b]:
                    whole = mix(np.array([whole * np.uint64(0x9E3779B97F4A7C15) + x], np.uint64))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of one length, sorted by the first, as deltas in byte planes."""
    first = columns[0]
    delta = np.diff(first, prepend=np.zeros(1, first.dtype))
    planes = [np.array([len(first)], np.int64).tobytes()]
    for x in (delta, *columns[1:]):
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unsqueeze(blob: bytes, *kinds: type) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, out = int(data[:8].view(np.int64)[0]), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


_SENT = "bucket int, chunk long, kind int, data binary, about binary"


def _send(docs: DataFrame, buckets: int, size: int, frequent: int, chunk_bytes: int) -> DataFrame:
    """Rows for the buckets: packed tokens of a chunk (kind 0), and the chunk's own documents (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", chunk_bytes):
            sets = shingle_sets(batch.column("text"), size)
            keys, lone, seen = [], [], {}
            for i, s in enumerate(sets):
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""
                keys.append(key)
                if len(s) and seen.setdefault(key, i) == i:
                    lone.append(i)
            sizes = np.array([len(s) for s in sets], np.int64)
            token = np.concatenate([sets[i] for i in lone]) if lone else np.empty(0, np.uint64)
            doc = np.repeat(np.array(lone, np.uint32), sizes[lone]) if lone else np.empty(0, np.uint32)
            order = np.argsort(token, kind="stable")
            token, doc = token[order], doc[order]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
            times = np.diff(np.append(start, len(token)))
            hot = np.repeat(times >= frequent, times)
            sums, counts = token[start][times >= frequent], times[times >= frequent].astype(np.uint32)
            mine, mine_doc, token, doc = token[hot], doc[hot], token[~hot], doc[~hot]
            edges = ((np.arange(1, buckets, dtype=object) << 64) // buckets).astype(np.uint64) if buckets > 1 else np.empty(0, np.uint64)
            cut, cut_hot = (np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in (token, sums))
            rows: list[tuple] = []
            for b in range(buckets):
                a, z, c, y = cut[b], cut[b + 1], cut_hot[b], cut_hot[b + 1]
                if z > a or y > c:
                    rows.append((b, uid, 0, _squeeze(token[a:z], doc[a:z]), _squeeze(sums[c:y], counts[c:y])))
            about = pa.table({"doc_id": batch.column("doc_id"), "r1": batch.column("r1"), "r2": batch.column("r2"), "n": pa.array(sizes), "key": pa.array(keys, pa.binary())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, about.schema) as out:
                out.write_table(about)
            rows.append(((uid * 2654435761 >> 7) % buckets, uid, 1, _squeeze(mine, mine_doc), sink.getvalue().to_pybytes()))
            uid += len(sets)
            for k in range(0, len(rows), 64):
                cols = list(zip(*rows[k : k + 64], strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "kind", "data", "about"])

    return docs.mapInArrow(run, _SENT)


def _count(group: pa.Table, frequent: int) -> pa.Table:
    """A bucket's tokens found twice or more, with their counts, packed for each chunk; chunks' own rows pass."""
    out: list[tuple] = []
    tokens, docs, whose, sums, counts = [], [], [], [], []
    for chunk, kind, data, about in zip(*(group.column(c).to_pylist() for c in ("chunk", "kind", "data", "about")), strict=True):
        if kind == 1:
            out.append((chunk, 1, data, about))
            continue
        t, d = _unsqueeze(data, np.uint64, np.uint32)
        tokens.append(t)
        docs.append(d)
        whose.append((chunk, len(t)))
        for x, to in zip(_unsqueeze(about, np.uint64, np.uint32), (sums, counts), strict=True):
            to.append(x)
    if tokens:
        token, doc = np.concatenate(tokens), np.concatenate(docs)
        owner = np.repeat(np.arange(len(whose), dtype=np.int32), [n for _, n in whose])
        order = np.argsort(token, kind="stable")
        token, doc, owner = token[order], doc[order], owner[order]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
        times = np.diff(np.append(start, len(token)))
        known, extra = np.concatenate(sums), np.concatenate(counts).astype(np.int64)
        if len(known) and len(start):
            at = np.searchsorted(token[start], known)
            ok = (at < len(start)) & (token[start][np.minimum(at, len(start) - 1)] == known)
            np.add.at(times, at[ok], extra[ok])
        df = np.repeat(np.minimum(times, frequent), np.diff(np.append(start, len(token)))).astype(np.uint8)
        keep = df >= 2
        token, doc, owner, df = token[keep], doc[keep], owner[keep], df[keep]
        by = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[by], np.arange(len(whose) + 1))
        for k, (chunk, _) in enumerate(whose):
            part = by[ends[k] : ends[k + 1]]
            if len(part):
                out.append((chunk, 0, _squeeze(token[part], doc[part], df[part]), b""))
    cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
    release()
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("chunk", "kind", "data", "about"), cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)})


def _signatures(token: np.ndarray, df: np.ndarray, n: int, frequent: int) -> np.ndarray:
    """Signatures of a set of ``n`` tokens whose repeated ones are given in the common order (rare first)."""
    once = n - len(token)
    short, long = n - (3 * n + 3) // 4 + 1 - once, n // 2 + 2 - once
    first = int(np.searchsorted(df, frequent))
    single = token[: max(0, min(short, first))]
    if 4 * (len(token) - first) < 3 * n:
        return single
    shared = token[first : max(first, long)]
    with np.errstate(over="ignore"):
        pairs = mix(shared[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(shared[1:]))
    return np.concatenate([single, pairs])


def _sketch(token: np.ndarray) -> np.ndarray:
    """Numbers of tokens by class, each as so many bits of ``LEVELS``, and how many tokens are beyond that."""
    counts = np.bincount((token % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES)
    bits = np.packbits(counts[None, :] > np.arange(LEVELS)[:, None], bitorder="little").view(np.int64)
    return np.append(bits, np.maximum(counts - LEVELS, 0).sum())


_SETS = "uid long, doc_id long, r1 long, r2 long, n long, k1 long, k2 long, tokens array<long>, signatures array<long>, sketch array<long>"


def _gather(group: pa.Table, frequent: int) -> pa.Table:
    """A chunk's documents; those of which 3/4 of the tokens came back carry these, ordered, and their signatures."""
    release()
    base, about, parts = group.column("chunk")[0].as_py(), None, []
    for kind, data, more in zip(*(group.column(c).to_pylist() for c in ("kind", "data", "about")), strict=True):
        if kind == 1:
            about = pa.ipc.open_stream(more).read_all()
            t, d = _unsqueeze(data, np.uint64, np.uint32)
            parts.append((t, d, np.full(len(t), frequent, np.uint8)))
        else:
            parts.append(tuple(_unsqueeze(data, np.uint64, np.uint32, np.uint8)))
    token, doc, df = (np.concatenate(x) for x in zip(*parts, strict=True))
    n = np.asarray(about.column("n"))
    back = np.bincount(doc, minlength=len(n))
    may = (4 * back >= 3 * n) & (back > 0)
    keep = may[doc]
    token, doc, df = token[keep], doc[keep], df[keep]
    order = np.lexsort((token, df, doc))
    token, doc, df = token[order], doc[order], df[order]
    ends = np.searchsorted(doc, np.arange(len(n) + 1))
    sets, signs, sketches = [], [], []
    for i in range(len(n)):
        if may[i]:
            t, f = token[ends[i] : ends[i + 1]], df[ends[i] : ends[i + 1]]
            sets.append(t.view(np.int64))
            signs.append(_signatures(t, f, int(n[i]), frequent).view(np.int64))
            sketches.append(_sketch(t))
        else:
            sets.append(None)
            signs.append(None)
            sketches.append(None)
    keys = [np.frombuffer(k, np.int64).tolist() if k else (None, None) for k in about.column("key").to_pylist()]
    lists = lambda xs: pa.array([None if x is None else x.tolist() for x in xs], pa.list_(pa.int64()))
    return pa.table(
        {
            "uid": pa.array(base + np.arange(len(n))), "doc_id": about.column("doc_id"), "r1": about.column("r1"), "r2": about.column("r2"), "n": pa.array(n),
            "k1": pa.array([k[0] for k in keys], pa.int64()), "k2": pa.array([k[1] for k in keys], pa.int64()), "tokens": lists(sets), "signatures": lists(signs), "sketch": lists(sketches),
        }
    )


def _may_link(na: Column, ka: Column, nb: Column, kb: Column) -> Column:
    """Whether two sets can link: of each class of tokens they share what the poorer one has at most."""
    most = F.least(ka[_LONGS], kb[_LONGS])
    for i in range(_LONGS):
        most = most + F.bit_count(ka[i].bitwiseAND(kb[i]))
    return 100 * most >= 75 * (na + nb - most)


def _may(na: Column, ra: Column, nb: Column, rb: Column, percent: int) -> Column:
    """Whether two sets can be so similar: what they share is among the repeated tokens (r) of both."""
    most = F.least(ra, rb)
    return 100 * most >= percent * (na + nb - most)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, linked, distance`` of distinct pairs."""
    side = lambda x: sets.select(F.col("uid").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    both = F.size(F.array_intersect("ta", "tb"))
    checked = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("i"), (F.col("na") + F.col("nb") - both).alias("u"))
    return checked.select("a", "b", (100 * F.col("i") >= 75 * F.col("u")).alias("linked"), (1 - F.col("i") / F.col("u")).alias("distance"))


def _fewest_lone(members: DataFrame) -> DataFrame:
    """``s, b, nb, kb``: of each group and each of ``MORE_PIVOTS`` classes of its members, the one with the fewest lone tokens."""
    lone = F.struct(((F.col("n") - F.col("r")) / F.col("n")).alias("lone"), F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    picked = members.groupBy("s", F.pmod(F.xxhash64("uid"), F.lit(MORE_PIVOTS)).alias("k")).agg(F.min(lone).alias("m"))
    return picked.select("s", "m.b", "m.nb", "m.kb")


def links(sets: DataFrame, pairwise: int = PAIRWISE, dealt: int = DEALT) -> DataFrame:
    """``a, b``: links between different sets that connect all sets that any links connect."""
    rows = sets.select("uid", "n", F.size("tokens").alias("r"), "sketch", F.explode(F.array_distinct("signatures")).alias("s"))
    seal = [F.bit_xor(F.xxhash64("uid")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "uid")).alias("h2")]
    shared = rows.groupBy("s").agg(F.count("*").alias("c"), F.min(F.struct(((F.col("n") - F.col("r")) / F.col("n")).alias("lone"), "uid", "n", "r")).alias("p"), *seal).where("c > 1")
    # Near copies share many signatures: groups of the same sets are worked on once.
    groups = written(shared.groupBy("c", "p", "h1", "h2").agg(F.min("s").alias("s")).select("s", "c", F.col("p.uid").alias("a"), F.col("p.n").alias("na"), F.col("p.r").alias("ra")))
    live = written(split_join(rows, groups, ["s"]))
    few = live.where(F.col("c") <= pairwise).select("s", "uid", "n", "sketch")
    other = few.select("s", F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    pairs = few.join(other, "s").where((F.col("uid") < F.col("b")) & _may_link(F.col("n"), F.col("sketch"), F.col("nb"), F.col("kb"))).select(F.col("uid").alias("a"), "b")
    # Large groups of one pivot are worked on as one.
    stars = live.where((F.col("c") > pairwise) & (F.col("uid") != F.col("a"))).withColumnRenamed("uid", "b")
    stars = written(stars.groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("n", "r", "sketch", "na", "ra")]).withColumn("s", F.col("a")))
    near = stars.where(_may(F.col("n"), F.col("r"), F.col("na"), F.col("ra"), 50)).select("a", "b")
    done = written(_verify(pairs.unionByName(near).distinct(), sets))
    found = done.where("linked").select("a", "b")
    if stars.isEmpty():
        return found
    label = components(found)
    state = stars.join(done, ["a", "b"], "left").select("s", "a", F.col("b").alias("uid"), "n", "r", "sketch", F.coalesce("linked", F.lit(False)).alias("linked"), "distance")
    named = state.join(label.select(F.col("node").alias("uid"), "label"), "uid", "left").join(label.select(F.col("node").alias("a"), F.col("label").alias("own")), "a", "left")
    named = written(named.select("s", "uid", "n", "r", "sketch", "linked", "distance", F.coalesce("label", "uid").alias("label"), F.coalesce("own", "a").alias("own")))
    # Sets outside the pivot's component are tried against its members with the fewest lone tokens first.
    best = _fewest_lone(named.where("linked"))
    tried = named.where("label <> own").join(small(best, SMALL_SKETCHES), "s").where(_may_link(F.col("n"), F.col("sketch"), F.col("nb"), F.col("kb"))).select(F.least("uid", "b").alias("a"), F.greatest("uid", "b").alias("b")).distinct()
    more = written(_verify(tried, sets))
    done = done.unionByName(more)
    found = written(found.unionByName(more.where("linked").select("a", "b")))
    label = components(found)
    named = named.drop("label", "own").join(label.select(F.col("node").alias("uid"), "label"), "uid", "left").withColumn("a", F.col("s")).join(label.select(F.col("node").alias("a"), F.col("label").alias("own")), "a", "left")
    named = written(named.select("s", "uid", "n", "r", "sketch", "linked", "distance", F.coalesce("label", "uid").alias("label"), F.coalesce("own", "a").alias("own")))
    # Sets outside the pivot's component meet those of other components, unless sizes or the triangle inequality rule
    # it out: distances to the pivot (over 0.5 where they weren't worth computing) differ by 0.25 at most.
    outside = named.where("label <> own").select("s", F.col("uid").alias("x"), F.col("n").alias("nx"), F.col("r").alias("rx"), F.col("sketch").alias("kx"), F.col("distance").alias("dx"), F.col("label").alias("lx"))
    far = F.abs(F.coalesce("dx", F.greatest(F.lit(0.5), "distance")) - F.coalesce("distance", F.greatest(F.lit(0.5), "dx"))) > 0.25 + 1e-9
    # The outside members of a large group are dealt to many tasks, each of which meets all members once.
    parts = named.groupBy("s").agg(F.ceil(F.count("*") / dealt).cast("int").alias("parts"))
    outside = outside.join(parts, "s").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")).drop("parts")
    every = named.join(parts, "s").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    last = outside.join(every, ["s", "part"]).where((F.col("lx") != F.col("label")) & ((F.col("label") == F.col("own")) | (F.col("x") < F.col("uid"))) & ~F.coalesce(far, F.lit(False)) & _may(F.col("nx"), F.col("rx"), F.col("n"), F.col("r"), 75) & _may_link(F.col("nx"), F.col("kx"), F.col("n"), F.col("sketch")))
    last = last.select(F.least("x", "uid").alias("a"), F.greatest("x", "uid").alias("b")).distinct().join(done.select("a", "b"), ["a", "b"], "left_anti")
    return found.unionByName(written(_verify(last, sets)).where("linked").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node each node of ``edges`` (a, b) is connected with, by repeated minima and jumps.

    A node with very many edges is dealt to many tasks, and minima are combined before they meet.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = split_join(both, labels.withColumnRenamed("node", "b"), ["b"]).groupBy("a").agg(F.min("label").alias("least"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "least").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = written(met.join(jump, "new", "left").select("node", "old", F.least("new", F.coalesce("far", "new")).alias("label")))
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, row: tuple[str, str] | None = None, frequent: int = FREQUENT, pairwise: int = PAIRWISE, chunk_bytes: int = 2 << 20, dealt: int = DEALT) -> DataFrame:
    """``doc_id, n_shingles, component_id, keeps`` for every row of ``docs`` (and the two ``row`` columns, if named).

    Words are lower-cased A-Z; sets hold distinct shingles of ``size`` words; two rows link where
    100 * intersection >= 75 * union. ``component_id`` is the smallest id reachable by links; ``keeps`` is
    true on one row of each component. Components are given, not all links: a pair whose component is
    known already isn't compared. Null and empty texts have no set and link with nothing; a null id
    is never the smallest; repeated rows link as equal sets; an empty table gives no rows; other columns
    are not read. ``frequent`` (at most 255), ``pairwise``, ``chunk_bytes`` and ``dealt`` change the work, not the result.
    """
    ship(docs.sparkSession)
    r1, r2 = (F.col(row[0]), F.col(row[1])) if row else (F.lit(0), F.lit(0))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), r1.cast("long").alias("r1"), r2.cast("long").alias("r2"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # A bucket holds the tokens of about 6 MB of text, whatever the input's size.
    buckets = max(8, -(-total // (6 << 20)))
    counted = _send(rows, int(buckets), size, frequent, chunk_bytes).groupBy("bucket").applyInArrow(lambda g: _count(g, frequent), "chunk long, kind int, data binary, about binary")
    known = written(counted.groupBy("chunk").applyInArrow(lambda g: _gather(g, frequent), _SETS))

    nodes = written(known.where("k1 is not null").groupBy("k1", "k2").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least")))
    sets = written(known.where("tokens is not null").select("uid", "n", "tokens", "signatures", "sketch").join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi"))
    labels = components(links(sets, pairwise, dealt))
    labelled = nodes.join(labels, "node", "left").select("k1", "k2", "least", F.coalesce("label", "node").alias("label"))
    by_label = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    found = written(labelled.join(by_label, "label").select("k1", "k2", "label", "component_id"))
    thin = known.select("uid", "doc_id", "r1", "r2", "n", "k1", "k2").join(small(found, 250_000), ["k1", "k2"], "left")
    # One row of each component stays: the one with the smallest id, then the first read.
    chosen = thin.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid")).alias("m")).select(F.col("m.uid").alias("uid"), F.lit(True).alias("chosen"))
    out = thin.join(chosen, "uid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("label").isNull() | F.coalesce("chosen", F.lit(False))).alias("keeps"), "r1", "r2"
    )
    return out.withColumnsRenamed({"r1": row[0], "r2": row[1]}) if row else out.drop("r1", "r2")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """``docs`` with one row of each component of near duplicates; the same columns, all other rows.

    Rows are told apart by file and place, so repeated and null ids do no harm; a table that isn't read
    from files is written first.
    """
    file, row = fresh(docs.columns, "file"), fresh(docs.columns, "row")
    place = lambda df: df.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    try:
        placed = place(docs)
    except AnalysisException:
        placed = place(written(docs))
    gone = written(near_duplicates(placed, doc_id, text, size, (file, row)).where("not keeps").select(file, row))
    return placed.join(small(gone), [file, row], "left_anti").select(*[f"`{c}`" for c in docs.columns])
