"""Shared pieces: the scratch folder, word splitting in Arrow, and row-local bindings."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One or more of these separate words: space and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Rows up to which a table of a few numbers a row may be broadcast (about 12 MB at 40 bytes).
SMALL_ROWS = 300_000


def scratch_dir(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder is set only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/evidentia-{uuid.uuid4().hex}"


def written(df: DataFrame, *cluster_by: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read again.

    This cuts lineage: a lost executor costs a re-read, not a recomputation. The files are
    removed when the driver process ends.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already; the folder is scratch
        return


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (a shuffled join follows)."""
    return F.broadcast(df) if df.count() <= rows else df


#: Parts that a hot key is dealt to where the other side of a join is too large to be broadcast.
SALTS = 16


def split_join(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner", most: int | None = None, salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``keys`` (each key once): broadcast up to ``most`` keys, else each key's rows are dealt to ``salts`` tasks.

    So a key that holds a large share of ``rows`` is no single task's work. ``how`` is inner, left, left_semi or left_anti.
    """
    if keys.count() <= (SMALL_ROWS if most is None else most):
        return rows.join(F.broadcast(keys), on, how)
    salt = fresh([*rows.columns, *keys.columns], "salt")
    dealt = rows.withColumn(salt, F.monotonically_increasing_id() % salts)
    copies = keys.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, [*on, salt], how).drop(salt)


def fresh(taken: list[str], name: str) -> str:
    """A working column's name that no column of ``taken`` has, whatever its case."""
    have, name = {x.lower() for x in taken}, f"__{name}"
    while name.lower() in have:
        name = f"_{name}"
    return name


def refuse(columns: list[str], made: list[str]) -> None:
    """An error where a new column is named like one there is, in any case (Spark folds it)."""
    have = {c.lower() for c in columns}
    if clash := sorted(c for c in made if c.lower() in have):
        raise ValueError(f"columns exist already: {clash}; give a prefix")


def clear_prefix(columns: list[str], made: list[str]) -> str:
    """A prefix with which none of the new names clashes."""
    prefix = "__"
    while {c.lower() for c in columns} & {(prefix + c).lower() for c in made}:
        prefix += "_"
    return prefix


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, mod 5; a null id counts as the text ``''``."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5).cast("int")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``most`` bytes in each; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
        release()


def release() -> None:
    """Gives memory that a worker has freed back to the system, for the tasks beside it."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the offset of each text's first word (one more at the end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))])
    full = np.asarray(pc.greater(pc.binary_length(flat), 0), dtype=bool)
    if not full.all():
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        flat = flat.filter(pa.array(full))
    # Lower-casing comes last: on a slice of an array, ascii_lower reads the wrong bytes.
    return (pc.ascii_lower(flat) if lower else flat), ends


def hash64(strings: pa.Array, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each string, vectorised: a polynomial over its bytes, then mixed."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    strings = strings.cast(pa.large_string())
    n = len(strings)
    if not n:
        return np.empty(0, np.uint64)
    off = np.frombuffer(strings.buffers()[1], np.int64, n + 1, strings.offset * 8)
    data = np.frombuffer(strings.buffers()[2], np.uint8)[off[0] : off[-1]] if strings.buffers()[2] else np.empty(0, np.uint8)
    off = off - off[0]
    total, out = prefix_hash(data, base), np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        out[:] = (total[off[1:]] - total[off[:-1]]) * powers(inverse(base), len(data) + 1)[off[:-1]]
        return mix(out + (off[1:] - off[:-1]).astype(np.uint64))


_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None
_POWERS: dict[int, np.ndarray] = {}


def inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


_BYTE = np.array([(b * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) % (1 << 64) for b in range(256)], np.uint64)


def prefix_hash(data: np.ndarray, base: int) -> np.ndarray:
    """P with P[i] = sum of value(data[j]) * base**j for j < i, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(_BYTE)[data] * powers(base, len(data)), out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
