"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and a proof for each row.

A leaf is the sha256 of a row's fields. In a group, leaves ascend by a key; while several nodes remain, every
``ARITY`` consecutive ones (the last run may be shorter) become the sha256 of their hex digests.

1. Leaves are sorted into ranges of (group, key); repeated rows are told apart by their place, so copies of one row
   spread over ranges as others do.
2. Each partition says how many rows of its first and its last group it has: two numbers a partition reach the
   driver, and give each partition the place of its first row in its group, and the sizes of groups that span partitions.
3. Each partition builds the complete aligned subtrees over its rows. A node whose parent needs nodes of another
   partition is ragged: at most ``ARITY - 1`` at either end of each level.
4. Ragged nodes meet by coordinate, the aligned block of ``ARITY ** height`` leaves that they lie in; blocks grow by
   ``CLIMB`` levels a round, so a task gets the nodes of few partitions, and a few rounds end in the groups' roots.
5. The groups' roots are leaves of the last tree, built alike. A row's proof is put together from the parts:
   to its ragged node, through the rounds, and from its group's root to the root.

A proof is a row of levels: a byte (own place in the run * 16 + siblings), then the siblings' digests, left to right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import split_join, written
from evidentia.ship import ship

ARITY = 3
#: Rows of a sorted partition: so many, and more where that makes over ``MANY_PARTS`` partitions, up to ``MOST_ROWS``.
PART_ROWS, MANY_PARTS, MOST_ROWS = 10_000, 2_000, 250_000
#: Levels that blocks of ragged nodes grow by in a round.
CLIMB = 5
#: Proof parts (up to about 2 kB each) that are broadcast; more are joined by a shuffle.
SMALL_PROOFS = 10_000
_NODES = "grp string, level int, at long, size long, digest binary, proof binary, up_level int, up_at long"


def row_digest(fields: list[Column]) -> Column:
    """sha256 (hex) of the fields: ``-`` for null, else the value's number of UTF-8 bytes, a colon and the value."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]), 256)


def parent(children: list[bytes]) -> bytes:
    """The digest of a run of nodes."""
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def _step(run: list[bytes], own: int) -> bytes:
    """One level of a proof: a node's place in its run, and its siblings."""
    return bytes([own * 16 + len(run) - 1]) + b"".join(run[:own] + run[own + 1 :])


def fold(node: bytes, proof: bytes) -> tuple[bytes, bytes]:
    """The root that a node and its proof give, and the sha256 of the proof's siblings."""
    at, siblings = 0, hashlib.sha256()
    while at < len(proof):
        own, n = divmod(proof[at], 16)
        run = [proof[at + 1 + 32 * k : at + 33 + 32 * k] for k in range(n)]
        siblings.update("".join([x.hex() for x in run]).encode())
        run.insert(own, node)
        node, at = parent(run), at + 1 + 32 * n
    return node, siblings.digest()


def _height(size: int, rows: int = 1) -> int:
    """Levels above the leaves of a tree of ``size`` leaves until a level has ``rows`` nodes or fewer."""
    height = 0
    while size > rows:
        size, height = -(-size // ARITY), height + 1
    return height


def _climb(low: int, nodes: list[bytes], size: int) -> list[tuple[int, list[bytes], int]]:
    """``first place, nodes, size of the whole level`` of the complete nodes over the leaves ``low, low + 1, ...``, level by level."""
    levels = [(low, nodes, size)]
    while size > 1 and nodes:
        above = -(-size // ARITY)
        first, end = -(-low // ARITY), above if low + len(nodes) == size else (low + len(nodes)) // ARITY
        nodes = [parent(nodes[ARITY * m - low : ARITY * (m + 1) - low]) for m in range(first, end)]
        low, size = first, above
        levels.append((low, nodes, size))
    return levels


def _ways(levels: list[tuple[int, list[bytes], int]], level: int, above: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """For each node of a level: level and place of the highest complete node over it, and the proof up to that; ``above`` are the next level's."""
    low, nodes, _ = levels[level]
    first = levels[level + 1][0] if level + 1 < len(levels) else 0
    for k in range(len(nodes)):
        up = (low + k) // ARITY - first
        if 0 <= up < len(above):
            begin = ARITY * (up + first) - low
            top, at, rest = above[up]
            yield top, at, _step(nodes[begin : begin + ARITY], k - begin) + rest
        else:
            yield level, low + k, b""


def _summary(place: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """``place, first group, its rows, last group, its rows, rows`` of a sorted partition; nothing of an empty one."""
    first = last = None
    firsts = lasts = total = 0
    for key, _ in rows:
        total += 1
        first = key[0] if first is None else first
        firsts += key[0] == first
        lasts = lasts + 1 if key[0] == last else 1
        last = key[0]
    if total:
        yield place, first, firsts, last, lasts, total


def _borders(parts: list[tuple]) -> dict[int, tuple[int, dict[bytes, int]]]:
    """For each partition: rows of its first group in earlier ones, and the whole sizes of its first and its last group."""
    size: dict[bytes, int] = {}
    before: dict[int, int] = {}
    for place, first, firsts, last, lasts, _ in parts:
        before[place] = size.get(first, 0)
        size[first] = before[place] + firsts
        if last != first:
            size[last] = lasts
    return {place: (before[place], {g: size[g] for g in (first, last)}) for place, first, _, last, _, _ in parts}


def _build(borders: dict[int, tuple[int, dict[bytes, int]]]):
    """A sorted partition's rows with their ways up, and (without an id) its ragged nodes and the roots it completes."""

    def run(place: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        before, sizes = borders.get(place, (0, {}))
        for group, mine in groupby(rows, lambda r: r[0][0]):
            own = list(mine)
            levels = _climb(before, [key[2] for key, _ in own], sizes.get(group, len(own)))
            before, name, size = 0, group.decode(), levels[0][2]
            above: list[tuple[int, int, bytes]] = []
            for level in range(len(levels) - 1, 0, -1):
                above = list(_ways(levels, level, above))
                yield from ((name, None, None, None, level, at, size, node, None) for (top, at, _), node in zip(above, levels[level][1], strict=True) if top == level)
            for (top, at, proof), (key, presented) in zip(_ways(levels, 0, above), own, strict=True):
                if top == 0:
                    yield name, None, None, None, 0, at, size, key[2], None
                yield name, key[1][1] if key[1][0] else None, key[2], presented, top, at, size, None, proof

    return run


def _finish(height: int):
    """The nodes of one aligned block of ``ARITY ** height`` leaves: each one's way to the block's top, and the top."""

    def run(item: tuple) -> Iterator[tuple]:
        (name, _), found = item
        have: dict[int, dict[int, bytes]] = {}
        for level, at, size, digest in found:
            have.setdefault(level, {})[at] = digest
        entries = [(level, at) for level, nodes in have.items() for at in nodes]
        level, wide = 0, size
        while level < height and wide > 1:
            for up in sorted({at // ARITY for at in have.get(level, ())}):
                run_of = [have[level][c] for c in range(ARITY * up, min(ARITY * up + ARITY, wide))]
                have.setdefault(level + 1, {})[up] = parent(run_of)
            level, wide = level + 1, -(-wide // ARITY)
        ((top, digest),) = have[level].items()
        ways = {(level, top): b""}
        for k in range(level - 1, -1, -1):
            wide = -(-size // ARITY**k)
            for at in have.get(k, ()):
                begin = at // ARITY * ARITY
                ways[k, at] = _step([have[k][c] for c in range(begin, min(begin + ARITY, wide))], at - begin) + ways[k + 1, at // ARITY]
        for at in entries:
            yield name, *at, size, None, ways[at], level, top
        yield name, level, top, size, digest, None, None, None

    return run


def _forest(rows: DataFrame, kind: T.DataType, part_rows: int, climb: int) -> tuple[DataFrame, DataFrame]:
    """Trees over ``grp, id, digest, presented, row``: ``grp, id, digest, presented, proof`` (to the group's root), and ``grp, subroot``."""
    spark, total = rows.sparkSession, rows.count()
    parts = max(1, -(-total // MOST_ROWS), min(MANY_PARTS, -(-total // part_rows)))
    plain = lambda i: (False, 0) if i is None else (True, bytes(i) if isinstance(i, bytearray) else i)
    keyed = rows.rdd.map(lambda r: ((r.grp.encode(), plain(r.id), bytes(r.digest), r.row), r.presented))
    ranged: RDD = keyed.sortByKey(numPartitions=parts)
    summary = sorted(ranged.mapPartitionsWithIndex(_summary).collect())  # one row a partition
    largest = max((total for *_, total in summary), default=1)
    borders = _borders(summary)
    spanning = max((n for _, sizes in borders.values() for n in sizes.values()), default=1)
    schema = T.StructType(
        [T.StructField(n, t) for n, t in (("grp", T.StringType()), ("id", kind), ("leaf", T.BinaryType()), ("presented", T.BinaryType()), ("level", T.IntegerType()), ("at", T.LongType()), ("size", T.LongType()), ("digest", T.BinaryType()), ("proof", T.BinaryType()))]
    )
    built = written(spark.createDataFrame(ranged.mapPartitionsWithIndex(_build(borders)), schema, verifySchema=False))
    leaves = built.where("leaf is not null").select("grp", "id", "leaf", "presented", "level", "at", "proof")
    nodes = built.where("leaf is null").select("grp", "level", "at", "size", "digest")
    done = F.ceil(F.col("size") / F.pow(F.lit(float(ARITY)), "level")) <= 1
    roots, nodes, ways = nodes.where(done), nodes.where(~done), None
    height = _height(largest) + climb
    while _height(spanning) > 0 and not nodes.isEmpty():
        block = lambda r, h=height: ((r.grp, r.at * ARITY**r.level // ARITY**h), (r.level, r.at, r.size, bytes(r.digest)))
        risen = nodes.rdd.map(block).groupByKey(parts).flatMap(_finish(height))
        risen = written(spark.createDataFrame(risen, _NODES, verifySchema=False))
        way = risen.where("proof is not null").select("grp", "level", "at", "proof", "up_level", "up_at")
        if ways is None:
            ways = way
        else:
            later = way.select("grp", F.col("level").alias("up_level"), F.col("at").alias("up_at"), F.col("proof").alias("more"), F.col("up_level").alias("l"), F.col("up_at").alias("a"))
            ways = written(ways.join(later, ["grp", "up_level", "up_at"], "left").select("grp", "level", "at", F.concat("proof", F.coalesce("more", F.lit(b""))).alias("proof"), F.coalesce("l", "up_level").alias("up_level"), F.coalesce("a", "up_at").alias("up_at")))
        tops = risen.where("proof is null").select("grp", "level", "at", "size", "digest")
        roots, nodes = roots.unionByName(tops.where(done)), tops.where(~done)
        if _height(spanning) <= height:
            break
        height += climb
    if ways is not None:
        ways = ways.select("grp", "level", "at", F.col("proof").alias("more"))
        leaves = split_join(leaves, ways, ["grp", "level", "at"], "left", SMALL_PROOFS).withColumn("proof", F.concat("proof", F.coalesce("more", F.lit(b""))))
    return leaves.select("grp", "id", "leaf", "presented", "proof"), roots.select("grp", F.col("digest").alias("subroot"))


def manifest(docs: DataFrame, fields: list[str], group: str = "source", key: str = "doc_id", presented: Column | None = None, part_rows: int = PART_ROWS, climb: int = CLIMB) -> DataFrame:
    """For every row: ``key, group, leaf, presented, subroot, root`` (hex digests) and ``proof`` (binary, see the module).

    A leaf is the digest of ``fields`` (each ``-`` if null). In each group (null is a group, and comes first) leaves ascend by ``key``
    (null first; ties by digest, so equal rows stand together and each has its own proof), groups by their UTF-8 bytes.
    ``presented`` is the digest that is shown later instead of the leaf (null: the leaf itself), for ``checked``. A group of one row is its
    own leaf; an empty table gives no rows; other columns, whatever their names, are not read. ``part_rows``
    and ``climb`` change the work, not the result.
    """
    spark = docs.sparkSession
    ship(spark)
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    shown = F.lit(None).cast("binary") if presented is None else F.unhex(presented)
    leaf = F.unhex(row_digest([F.col(c) for c in fields]))
    rows = written(docs.select(name.alias("grp"), F.col(key).alias("id"), leaf.alias("digest"), shown.alias("presented"), F.monotonically_increasing_id().alias("row")))
    leaves, subroots = _forest(rows, docs.select(key).schema[0].dataType, part_rows, climb)
    subroots = written(subroots)
    over = subroots.select(F.lit("-").alias("grp"), F.encode("grp", "UTF-8").alias("id"), F.col("subroot").alias("digest"), F.lit(None).cast("binary").alias("presented"), F.lit(0).cast("long").alias("row"))
    tops, root = _forest(over, T.BinaryType(), part_rows, climb)
    tops = subroots.join(tops.select(F.decode("id", "UTF-8").alias("grp"), F.col("proof").alias("rest")), "grp")
    found = root.first()
    whole = F.lit(found["subroot"].hex() if found else None).cast("string")
    out = split_join(leaves, written(tops), ["grp"], "inner", SMALL_PROOFS)
    hexed = lambda c: F.lower(F.hex(c))
    return out.select(
        F.col("id").alias(key), F.when(F.col("grp") != "-", F.substr("grp", F.lit(2))).alias(group), hexed("leaf").alias("leaf"), hexed(F.coalesce("presented", "leaf")).alias("presented"),
        hexed("subroot").alias("subroot"), whole.alias("root"), F.concat("proof", "rest").alias("proof"),
    )


def checked(entries: DataFrame) -> DataFrame:
    """The manifest's rows and ``proof_sha256`` (of the siblings), ``folded_root`` (of ``presented`` and the proof) and ``verified``."""
    ship(entries.sparkSession)
    schema = T.StructType([*entries.schema, *[T.StructField(c, T.StringType()) for c in ("proof_sha256", "folded_root")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [fold(bytes.fromhex(shown), proof) for shown, proof in zip(batch.column("presented").to_pylist(), batch.column("proof").to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array([d.hex() for _, d in both], pa.string()), pa.array([r.hex() for r, _ in both], pa.string())], names=[*batch.schema.names, "proof_sha256", "folded_root"])

    return entries.mapInArrow(run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))
