"""Shared plumbing: Arrow text buffers, rolling hashes, scratch tables, tiles and components.

Everything here works on whole columns of a batch at once.  Batches are cut into chunks of a few
megabytes of text, so memory stays bounded by the longest single document plus one chunk.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


# ---------------------------------------------------------------- text buffers


def flat_utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets (n + 1, absolute); null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, values = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data, off.astype(np.int64)


def chunks(off: np.ndarray, limit: int):
    """Row ranges (lo, hi) of at most ``limit`` bytes each; a longer single text is a range of its own."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def binary_column(data: bytes | np.ndarray, off: np.ndarray, kind=None) -> pa.Array:
    """A binary (or string) array over one buffer and its offsets."""
    kind = kind or pa.binary()
    data = pa.py_buffer(np.ascontiguousarray(data)) if isinstance(data, np.ndarray) else pa.py_buffer(data)
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(np.asarray(off, np.int32)), data])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def fresh(name: str, taken) -> str:
    """A column name like ``name`` that none of ``taken`` equals, whatever its case."""
    lower = {t.lower() for t in taken}
    name = f"_{name}"
    while name.lower() in lower:
        name += "_"
    return name


# ---------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (the one of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class RollingHash:
    """Hash of any substring [s, e) of one byte buffer, modulo 2**64, in constant time."""

    _powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inv = self._up_to(n)[1]
        terms = _BYTE_CODE[data]
        terms *= self._up_to(n)[0][:n]
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(terms, out=self.prefix[1:])

    @classmethod
    def _up_to(cls, n: int):
        if len(cls._powers[0]) < n + 1:
            size = max(n + 1, 1 << 20)
            up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
            up[0] = down[0] = 1
            cls._powers = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
        return cls._powers

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.inv[start] + (end - start).astype(U64))

    def windows(self, k: int) -> np.ndarray:
        """The hash of every k-byte window."""
        n = len(self.prefix) - 1
        if n < k:
            return np.zeros(0, U64)
        return mix64((self.prefix[k:] - self.prefix[: n - k + 1]) * self.inv[: n - k + 1])


_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit codes of the byte ranges [start, end): a mixed chain over blocks of eight bytes.

    Unlike a polynomial modulo 2**64 the chain has no strings that collide by their structure; ranges of
    more than 256 bytes take a cryptographic hash.
    """
    length = (end - start).astype(np.int64)
    code = mix64(length.astype(U64) + U64(0x243F6A8885A308D3))
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    todo = np.flatnonzero((length > 0) & (length <= 256))
    at, left = start[todo], length[todo]
    while len(todo):
        block = lanes[at].view("<u8").ravel() & _LANE[np.minimum(left, 8)]
        code[todo] = mix64((code[todo] ^ block) * U64(0xD6E8FEB86659FD93) + U64(0x13198A2E03707344))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > 256).tolist():
        code[i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return code


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for all pairs."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


# ---------------------------------------------------------------- batches and scratch tables

BATCH_BYTES = 4 << 20


def frugal(run):
    """``run`` over batches; when a task ends, what it freed goes back to the system, as its worker stays."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return inner


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the session's Arrow batches to ``BATCH_BYTES``: executors hold a batch several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name)
    if not now.isdigit() or int(now) > BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        import tempfile

        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        root = spark.conf.get("stratlens.scratch.fallback", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="stratlens-")
            spark.conf.set("stratlens.scratch.fallback", root)
            atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended; the folder is then the cluster's to clean
        pass


class Scratch:
    """Tables written to shared storage: they cut the lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        atexit.register(_remove, spark, self.base)

    def keep(self, df: DataFrame, name: str, drop: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` and read it back; then delete the tables named in ``drop``."""
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.tables[name] = path
        for old in drop:
            self.drop(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        if name in self.tables:
            _remove(self.spark, self.tables.pop(name))


# ---------------------------------------------------------------- tiles of a hot group


HOT_KEYS = 100_000


def tiled(df: DataFrame, key: str, tie: str, size: int, weight: str | None = None, most: int = 0) -> DataFrame:
    """Rows of every key with at least two rows, once for each tile pair (``_i`` <= ``_j``) they belong to.

    Adds ``_i``, ``_j`` and the row's own tile ``_t``.  Any two rows of a key meet in exactly one pair
    of tiles (or in all pairs of their common tile; see ``_i`` = ``_j``), and no pair of tiles holds
    more than about 2 * ``size`` rows, or 2 * ``most`` of the column ``weight``, however hot the key is.
    Keys of up to 1.5 times that are one tile.

    ``df`` is read twice.  Keys of several tiles get their tile in a broadcast join, so they are never one
    task's: there are at most rows / ``size`` of them, and they are broadcast if they are no more than
    ``HOT_KEYS``; beyond, a shuffled join (which AQE splits) takes their place.
    """
    heavy = F.sum(weight) if weight else F.lit(0)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), heavy.cast("long").alias("_w")).where("_n > 1")
    by = [F.when(F.col("_n") <= int(size * 1.5), F.lit(1)).otherwise(F.ceil(F.col("_n") / size))]
    if weight:
        by.append(F.when(F.col("_w") <= int(most * 1.5), F.lit(1)).otherwise(F.least("_n", F.ceil(F.col("_w") / most))))
    counts = counts.select(key, (F.greatest(*by) if weight else by[0]).cast("int").alias("_m"))
    hot = counts.where("_m > 1")
    few = hot.limit(HOT_KEYS + 1).count()
    out = df.join(counts, key)
    if 0 < few <= HOT_KEYS:
        hot = F.broadcast(hot)
        out = df.join(hot.select(key), key, "left_anti").join(counts.where("_m = 1"), key).unionByName(df.join(hot, key))
    out = out.withColumn("_t", F.when(F.col("_m") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(F.col(tie), F.lit(7)), F.col("_m")).cast("int")))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return out.withColumn("_i", F.least("_t", "_o")).withColumn("_j", F.greatest("_t", "_o")).drop("_o", "_m")


# ---------------------------------------------------------------- components


def union_find(n: int, left, right) -> np.ndarray:
    """The smallest index reachable, for each of 0..n-1, over the given edges."""
    parent = list(range(n))
    for a, b in zip(left, right):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for i in range(n):
        parent[i] = parent[parent[i]]
    return np.array(parent, np.int64)


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v), component being the smallest node reachable.

    Alternating large-star and small-star contraction: every round is two aggregations over the edges,
    the number of rounds grows with the logarithm of the longest chain, and each round is a written table.
    Only counts and a checksum reach the driver.
    """
    cur = scratch.keep(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{tag}-0"
    )
    last = None
    for k in range(1, max_rounds + 1):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        nxt = scratch.keep(small, f"{tag}-{k}", drop=(f"{tag}-{k - 1}",))
        now = tuple(nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        cur = nxt
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
