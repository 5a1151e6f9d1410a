"""Shared pieces of the training-data operators: storage, hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of ``[^\x20\x09-\x0D]+``; ``bytes.split()`` uses the same set.
WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The separators as a Java regular expression.
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised step holds; word arrays take about ten times as much.
BLOCK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, one of our own, which only a local master may have: all its tasks see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="echolens-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Tables written since each open ``scratch`` began.
_SCRATCH: list[list[tuple[SparkSession, str]]] = []


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, tag: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and no executor's loss takes it.

    The table goes with ``discard``, at the end of the ``scratch`` around it (unless it is ``lasting``), or with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/echolens-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _path(spark, path)
    files.deleteOnExit(where)
    if _SCRATCH and not lasting:
        _SCRATCH[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._echolens_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        files, where = _path(df.sparkSession, df._echolens_path)
        files.delete(where, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end: for a step whose result has itself been written."""
    own: list[tuple[SparkSession, str]] = []
    _SCRATCH.append(own)
    try:
        yield
    finally:
        _SCRATCH.remove(own)
        for spark, path in own:
            files, where = _path(spark, path)
            files.delete(where, True)


def row_key(identity: str, text: str = "text") -> Column:
    """128 bits (binary) that tell rows apart by id and text: rows that agree in both share a key, and get the same result."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(part(identity), F.lit("\x00"), part(text)).cast("binary")))


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores in front as it takes not to be one of ``taken`` (case aside)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def with_columns_after(columns: list[str], new: list[str]) -> list[int]:
    """Places of the ``columns`` that stay when columns named ``new`` are added: a new column takes the place of an old one of its name."""
    low = {x.lower() for x in new}
    return [k for k, c in enumerate(columns) if c.lower() not in low]


def crc_of(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def held_out(column: str, modulus: int) -> Column:
    return F.coalesce(crc_of(column, modulus) == 2, F.lit(False))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def handed_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker, which is used again, gives the memory that it no longer holds back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# ---- word hashes without a Python object for each word -------------------------------------------------------------

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[list(WHITESPACE)] = True
_POWERS: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Powers that a worker keeps between texts; those of longer texts are made anew.
_KEPT_POWERS = 1 << 22


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n."""
    if _POWERS and len(_POWERS[0]) > n:
        return _POWERS[0], _POWERS[1]
    size = max(n + 1, 1 << 16)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    both = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size <= _KEPT_POWERS:
        _POWERS[:] = both
    return both


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[s:e] for each range that depends on the values alone, not on their place."""
    up, down = powers(len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BYTE[7])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``limit`` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows and, as n + 1 bounds, which are whose."""
    low, high = int(offsets[0]), int(offsets[-1])
    text, at = data[low:high], offsets - low
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    space = _SPACE[text]
    fresh = np.ones(len(text), bool)
    fresh[1:] = space[:-1]
    inner = at[(at > 0) & (at < len(text))]
    fresh[inner] = True
    last = np.ones(len(text), bool)
    last[:-1] = space[1:]
    last[inner - 1] = True
    starts, ends = np.flatnonzero(fresh & ~space), np.flatnonzero(last & ~space) + 1
    return range_hash((_BYTE_LOWER if lower else _BYTE)[text], starts, ends), np.searchsorted(starts, at)


# ---- connected components ------------------------------------------------------------------------------------------


def components(edges: DataFrame, tag: str, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node with an edge.

    Large-star and small-star in turn. Every step is a pre-aggregated minimum and an equi-join that adaptive execution
    may split, so a node that touches a third of all edges is no task's lot. Each round is a table in the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), f"{tag}-edges")
    for k in range(rounds):
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = materialize(both.groupBy(a).agg(F.min(b).alias("m")).select(a.alias("k"), F.least(a, "m").alias("m")), f"{tag}-{k}-least")
        large = both.join(least, a == F.col("k")).where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy(a).agg(F.min(b).alias("m")).select(a.alias("k"), "m")
        hung = large.join(small_least, a == F.col("k"))
        small = hung.select(F.explode(F.array(F.struct(a.alias("a"), F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where(a != b).distinct()
        after = materialize(small, f"{tag}-{k}")
        # a forest of stars: every node has one parent, and no parent has a parent
        many = after.groupBy(a).count().where("count > 1").limit(1)
        deep = after.select(b.alias("k")).distinct().join(after.select(a.alias("k")).distinct(), "k").limit(1)
        now = after
        if many.isEmpty() and deep.isEmpty():
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(a.alias("node"), b.alias("root")).unionByName(now.select(b.alias("node"), b.alias("root")).distinct())
