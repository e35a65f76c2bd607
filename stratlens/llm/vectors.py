"""Reading embedding columns as arrays, and the cosine both vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, binary_column, flat_utf8, frugal, mix64, small_batches


def element(df: DataFrame, vector: str) -> str:
    """The type vectors are carried in: single precision where the column has no more, which loses nothing."""
    return "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"


def usable(df: DataFrame, ident: str, vector: str, dim: int | None = None) -> DataFrame:
    """(id, cls, vec): rows whose vector has a direction, as little-endian numbers, and a 128-bit hash of it.

    Vectors that are null, empty or zero, hold null or non-finite components, or are not of ``dim``
    components, are left out.
    """
    kind = element(df, vector)

    def run(batches):
        for batch in batches:
            col = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(sizes == dim)
            if not len(rows):
                continue
            x = pc.list_flatten(col.take(pa.array(rows))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
            good = np.isfinite(x).all(axis=1)
            good[good] &= (x[good] != 0).any(axis=1)
            rows, x = rows[good], np.ascontiguousarray(x[good]) + 0.0  # a negative zero equals a zero
            bits = x.view("<u8").reshape(len(rows), -1)
            place = np.arange(dim, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
            h = np.column_stack([mix64(bits + mix64(place + U64(s))[None, :]).sum(axis=1, dtype=np.uint64) for s in (1, 2)])
            body = x.astype(kind)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)), binary_column(np.ascontiguousarray(h).view(np.uint8).ravel(), np.arange(len(rows) + 1) * 16),
                    binary_column(body.view(np.uint8).ravel(), np.arange(len(rows) + 1) * dim * body.itemsize),
                ],
                ["id", "cls", "vec"],
            )

    rows = small_batches(df).where(F.col(ident).isNotNull()).select(F.col(ident).cast("long"), F.col(vector).cast("array<double>"))
    return rows.mapInArrow(frugal(run), "id long, cls binary, vec binary")


def dimension(df: DataFrame, vector: str) -> int:
    """The most common number of components (the smaller of equals); 0 without vectors."""
    row = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(row["d"]) if row else 0


def sampled(base: DataFrame, rows: int, n: int) -> DataFrame:
    """About ``rows`` of the ``n`` rows, and no more, by a hash of their id; few more than that are sorted."""
    share = min(1.0, 1.2 * rows / max(1, n) + 1e-9)
    near = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    return base.where(near).orderBy(F.xxhash64("id"), "id").limit(rows)


def matrix(column, kind: str) -> np.ndarray:
    """Rows of a binary column of numbers, in double precision, each scaled by a power of two to about 1."""
    data, off = flat_utf8(column)
    n = len(off) - 1
    if not n:
        return np.zeros((0, 0))
    x = np.frombuffer(data[off[0] : off[-1]].tobytes(), kind).reshape(n, -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same two vectors always give the same number."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
