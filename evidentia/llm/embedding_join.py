"""Epsilon grid order join of unit vectors, and the components of its links.

Unit vectors link where their distance is at most epsilon = sqrt(2 - 2 * similarity). An orthonormal projection never
lengthens a distance, so vectors that lie further apart in some leading principal dimensions can't link.

1. Equal vectors of a label become one, with a count; only different ones are joined.
2. Principal directions come from a bounded sample (``SAMPLE`` vectors a length); whatever they are, the result is the
   same, they only decide how much is skipped.
3. Vectors are sorted by label and grid cell (cells of width epsilon, dimension by dimension: the epsilon grid order),
   and cut into sequence intervals (blocks) with a bounding box each. A label with very many vectors is many blocks.
4. Stretches of ``STRETCH`` neighbouring intervals are paired by their boxes; pairs further apart than epsilon are skipped.
5. Each remaining pair is joined in a task by halving: intervals whose boxes lie too far apart are skipped, short
   ones multiplied in double precision. Only numbers of links and a spanning forest of the pair's links leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import release, small, split_join, written
from evidentia.llm.near_duplicates import components
from evidentia.ship import ship

#: Leading principal dimensions that make the grid, vectors of a sequence interval, and intervals of a stretch.
DIMENSIONS, BLOCK, STRETCH = 8, 1024, 16
#: Vectors of one length that directions are fitted on.
SAMPLE = 20_000
#: Up to this size two intervals are multiplied.
LEAF = 128
#: Boxes (two short arrays each) up to which one side of their join is broadcast.
SMALL_BOXES = 50_000
_BLOCKS = "stretch long, label string, size int, low array<double>, high array<double>, data binary, uids binary, counts binary"


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither tiny nor huge components leave the range of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _directions(classes: DataFrame, dimensions: int, sample: int) -> dict[int, np.ndarray]:
    """Orthonormal leading directions by vector length; at most ``sample`` vectors of a length are read, by hash order."""
    sizes = [r["size"] for r in classes.groupBy("size").count().orderBy(F.desc("count")).limit(16).collect()]
    out = {}
    for size in sizes:
        mine = classes.where(F.col("size") == size)
        few = mine.orderBy(F.xxhash64("uid")).limit(max(1, min(sample, (256 << 20) // (8 * size)))) if size <= 4096 else mine.limit(0)
        x = few.select("vec").toArrow()["vec"]
        if len(x):
            x = _unit(_matrix(x))
            x = x - x.mean(axis=0)
            out[size] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :dimensions]
    return out


def _project(x: np.ndarray, directions: dict[int, np.ndarray], dimensions: int) -> np.ndarray:
    """Leading coordinates, padded with zeros; the first components where no directions are known."""
    y = x @ directions[x.shape[1]] if x.shape[1] in directions else x[:, :dimensions]
    return np.pad(y, ((0, 0), (0, dimensions - y.shape[1])))


def _apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray, reach: float) -> bool:
    gap = np.maximum(0, np.maximum(low - other_high, other_low - high))
    return bool((gap * gap).sum() > reach * reach)


def _join(a: slice, b: slice, x: tuple, y: tuple, least: float, reach: float, hits: list) -> None:
    """Appends the links of two sequence intervals: halves the longer one until both are short, and skips distant ones."""
    p, q = x[1][a], y[1][b]
    if _apart(p.min(axis=0), p.max(axis=0), q.min(axis=0), q.max(axis=0), reach):
        return
    n, m = len(p), len(q)
    if max(n, m) <= LEAF:
        i, j = np.nonzero(x[0][a] @ y[0][b].T >= least)
        hits.append((i + a.start, j + b.start))
    elif n >= m:
        half = a.start + n // 2
        for part in (slice(a.start, half), slice(half, a.stop)):
            _join(part, b, x, y, least, reach, hits)
    else:
        half = b.start + m // 2
        for part in (slice(b.start, half), slice(half, b.stop)):
            _join(a, part, x, y, least, reach, hits)


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes is connected with by the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few edges that connect what the given ones connect."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _least(ends[: len(a)], ends[len(a) :], len(nodes))
    return nodes, nodes[root]


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label", similarity: float = 0.93, dimensions: int = DIMENSIONS, block: int = BLOCK, stretch: int = STRETCH, sample: int = SAMPLE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Rows link where their labels are equal and not null (or all may, with ``label=None``) and the cosine of their vectors, in double
    precision, is at least ``similarity`` (over 0). Null or empty vectors, zero vectors and those with a null or non-finite component link
    with nothing; neither do vectors of different lengths. ``n_links`` counts the other rows linked directly, copies too;
    ``component_id`` is the smallest id reachable by links, a row's own included; ``kept`` says whether it is the row's own. Every pair is
    decided, none sampled. Rows with a null id are kept and counted; a null id is never the smallest, and where no
    row of a component has one ``component_id`` is null and ``kept`` true. Repeated ids keep a row each. An empty
    table gives no rows; other columns aren't read. ``dimensions``, ``block``, ``stretch`` and ``sample`` change the work, not the result.
    """
    spark = vectors.sparkSession
    ship(spark)
    reach = math.sqrt(2 - 2 * similarity) + 1e-6
    tag = F.lit("") if label is None else F.col(label).cast("string")
    vec = F.col(vector).cast("array<double>")
    fine = tag.isNotNull() & F.coalesce(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(fine, tag).alias("label"), F.when(fine, F.col(vector)).alias("vec"))
    rows = rows.withColumns({"k1": F.when(F.col("vec").isNotNull(), F.xxhash64("vec", "label")), "k2": F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec", F.lit(1)))})
    rows = written(rows.select("vec_id", "label", "k1", "k2", "vec"))
    # Both keys make 128 bits of hash; copies are combined in each task before they meet.
    classes = rows.where("vec is not null").groupBy("label", "k1", "k2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("uid"), F.size("vec").alias("size"), "*"))
    directions = _directions(classes, dimensions, sample)

    kind = np.float32 if classes.schema["vec"].dataType.elementType == T.FloatType() else np.float64
    arrow = pa.from_numpy_dtype(kind)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column("size"))
            for s in np.unique(size):
                part = batch.filter(pa.array(size == s))
                y = _project(_unit(_matrix(part.column("vec"))), directions, dimensions)
                cells = pa.array(np.floor(y / reach).astype(np.int32).tolist(), pa.list_(pa.int32()))
                yield pa.record_batch([part.column("label"), part.column("size"), cells, part.column("uid"), part.column("n"), part.column("vec").cast(pa.list_(arrow))], names=["label", "size", "cells", "uid", "n", "vec"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sequence intervals of a task's sorted vectors: one label and length each, numbered by stretches in order."""
        from pyspark import TaskContext

        base, run, held, of = TaskContext.get().partitionId() << 32, 0, [], None

        def made() -> pa.RecordBatch:
            nonlocal run
            x, uids, counts = (np.concatenate([h[k] for h in held]) for k in range(3))
            y = _project(_unit(x), directions, dimensions)
            row = [base + run // stretch, *of, y.min(axis=0).tolist(), y.max(axis=0).tolist(), x.astype(kind).tobytes(), uids.tobytes(), counts.tobytes()]
            run += 1
            held.clear()
            types = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            names, sizes = batch.column("label").to_pylist(), batch.column("size").to_pylist()
            borders = [i for i in range(len(names)) if not i or (names[i], sizes[i]) != (names[i - 1], sizes[i - 1])] + [len(names)]
            for i, j in zip(borders, borders[1:], strict=False):
                if (names[i], sizes[i]) != of:
                    if held:
                        yield made()
                    of, run = (names[i], sizes[i]), -(-run // stretch) * stretch  # a stretch holds one label
                part = batch.slice(i, j - i)
                x, uids, counts = _matrix(part.column("vec")), np.asarray(part.column("uid")), np.asarray(part.column("n"))
                at = 0
                while at < len(x):
                    to = at + block - sum(len(h[0]) for h in held)
                    held.append((x[at:to], uids[at:to], counts[at:to]))
                    if sum(len(h[0]) for h in held) == block:
                        yield made()
                    at = to
        if held:
            yield made()

    placed = written(classes.select("label", "size", "uid", "n", "vec").mapInArrow(place, f"label string, size int, cells array<int>, uid long, n long, vec array<{'float' if kind == np.float32 else 'double'}>"))
    parts = max(1, -(-placed.count() // (block * stretch)))
    ordered = placed.repartitionByRange(parts, "label", "size", "cells", "uid").sortWithinPartitions("label", "size", "cells", "uid")
    blocks = written(ordered.select("label", "size", "uid", "n", "vec").mapInArrow(cut, _BLOCKS))

    def join(group: pa.Table) -> pa.Table:
        """One pair of stretches: interval by interval, so that the links held at once are those of two intervals."""
        at, sides = 0, {}
        for s, data, uids, counts in zip(*(group.column(c).to_pylist() for c in ("stretch", "data", "uids", "counts")), strict=True):
            uids = np.frombuffer(uids, np.int64)
            x = _unit(np.frombuffer(data, kind).astype(np.float64).reshape(len(uids), -1))
            sides.setdefault(s, []).append((at, x, _project(x, directions, dimensions), uids, np.frombuffer(counts, np.int64)))
            at += len(uids)
        first, last = group.column("one")[0].as_py(), group.column("two")[0].as_py()
        links, edges = np.zeros(at, np.int64), []
        for k, one in enumerate(sides[first]):
            for two in sides[last][k if first == last else 0 :]:
                hits: list = []
                _join(slice(0, len(one[1])), slice(0, len(two[1])), one[1:], two[1:], similarity, reach, hits)
                if not hits:
                    continue
                i, j = (np.concatenate([h[c] for h in hits]) for c in range(2))
                if one is two:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    i, j = i + one[0], j + two[0]
                    links += np.bincount(i, two[4][j - two[0]], at).astype(np.int64) + np.bincount(j, one[4][i - one[0]], at).astype(np.int64)
                    edges.append(_spanning(i, j))
        uids = np.concatenate([b[3] for b in sorted((b for side in sides.values() for b in side), key=lambda b: b[0])])
        root = _least(*(np.concatenate([e[c] for e in edges]) if edges else np.empty(0, np.int64) for c in range(2)), at)
        live = np.flatnonzero(links)
        release()
        return pa.table({"uid": uids[live], "links": links[live], "root": uids[root[live]]})

    near = _near_stretches(blocks, reach)
    tiles = near.select("one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("stretch")).join(blocks.select("stretch", "data", "uids", "counts"), "stretch")
    found = written(tiles.groupBy("one", "two").applyInArrow(join, "uid long, links long, root long"))
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    group = components(found.where("uid <> root").select(F.col("uid").alias("a"), F.col("root").alias("b")))
    known = classes.select("uid", "label", "k1", "k2", "n", "least").join(links, "uid", "left").join(group.withColumnRenamed("label", "grp").withColumnRenamed("node", "uid"), "uid", "left")
    known = written(known.where("links is not null or n > 1").select("label", "k1", "k2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("grp", "uid").alias("grp")))
    least = known.groupBy("grp").agg(F.min("least").alias("component_id"))
    known = written(known.join(least, "grp").select("label", "k1", "k2", "n_links", "component_id", F.lit(True).alias("linked")))
    out = split_join(rows.select("vec_id", "label", "k1", "k2"), known, ["label", "k1", "k2"], "left")
    own = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, own.isNull()).alias("kept"))


def _near_stretches(blocks: DataFrame, reach: float) -> DataFrame:
    """``one, two`` (one <= two): stretches of one label and length whose boxes lie within ``reach`` of each other."""
    fold = lambda c, pick: F.aggregate(F.collect_list(c), F.first(c), lambda s, v: F.zip_with(s, v, pick))
    boxes = written(blocks.groupBy("stretch", "label", "size").agg(fold("low", lambda x, y: F.least(x, y)).alias("low"), fold("high", lambda x, y: F.greatest(x, y)).alias("high")))
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    gaps = F.zip_with(less("low", "h"), less("l", "high"), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    far = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v * v) > reach * reach
    other = boxes.select(F.col("stretch").alias("two"), "label", "size", F.col("low").alias("l"), F.col("high").alias("h"))
    return boxes.withColumnRenamed("stretch", "one").join(small(other, SMALL_BOXES), ["label", "size"]).where((F.col("one") <= F.col("two")) & ~far).select("one", "two")
