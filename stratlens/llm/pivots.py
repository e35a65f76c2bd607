"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its ``prefix`` nearest pivots (reference points), in order.  Inverted lists
are kept for pairs of pivots, so two vectors meet exactly where they share at least two; a pair is
looked at in the list of its two smallest shared pivots only.  There the order counts: of each shared
pivot, how many of the nested prefixes hold it for both (pivots near the front of both count most).
Pairs that reach ``least`` are verified by cosine in double precision.

The index is fitted on a bounded sample (``4 * pivots`` rows by a hash, at least ``LEAST`` and at most ``4 * MOST``); every vector
is indexed.  Pivots are taken from it, centred on its mean, so that vectors that all point one way are
told apart too.  ``prefix`` and ``least`` are the smallest and the largest that keep ``recall`` of the sample's
own links (or, where it has few, of made ones at the very threshold).  The number of pivots grows with the
square root of the number of vectors, so lists keep their length.

Equal vectors are one class and count with their number.  A list of any length is compared in tiles of
bounded size, which emit counts and a spanning forest, not pairs.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components link with nothing; rows with null ids are left out; rows that share an id have one
row, with the most links of any and the component of the smallest id that any reaches.  Extra columns
are ignored; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary_column, components, frugal, ranges, tiled, union_find
from .minhash import _by_tile, _groups
from .vectors import cosine, dimension, element, matrix, sampled, unit, usable

MOST, LEAST = 8192, 4096
TILE = 512
PAIRS = 1 << 19
PREFIXES = (3, 4, 5, 6, 7, 8, 10, 12)


def choose(x: np.ndarray, count: int) -> list[int]:
    """Up to ``count`` of the unit vectors, by their places, none of them close to another; closer ones only where there are too few."""
    picked: list[int] = []
    for apart in (0.8, 0.9, 0.97, 0.999):
        far = np.ones(len(x), bool) if not picked else (x @ x[picked].T < apart).all(axis=1)
        for i in range(len(x)):
            if len(picked) == count:
                return picked
            if far[i]:
                picked.append(i)
                far &= x @ x[i] < apart
    return picked or [0]


def _agreement(a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, how many pivots the ordered prefixes share (of those smaller than ``below``, if given) and, over
    all nested prefixes, how many they have in common."""
    size = a.shape[1]
    shared, depth = np.zeros(len(a), np.int16), np.zeros(len(a), np.int16)
    for i in range(size):
        for j in range(size):
            same = a[:, i] == b[:, j]
            depth += same * np.int16(size - max(i, j))
            shared += same if below is None else same & (a[:, i] < below)
    return shared, depth


class Index:
    """Centre, pivots, prefix length and least agreement."""

    def __init__(self, sample: np.ndarray, count: int, threshold: float, recall: float = 0.995):
        x = unit(sample)
        self.centre = x.mean(axis=0) if len(x) > 16 else np.zeros(x.shape[1])
        picked = choose(self.centred(x), count)
        self.pivots = self.centred(x[picked])
        rest = np.delete(x, picked, axis=0)  # pivots describe themselves too well
        a, b = self._links(rest if len(rest) > 100 else x, threshold)
        top = min(PREFIXES[-1], len(self.pivots))
        pa_, pb = self.describe(a, top), self.describe(b, top)
        for self.prefix in [p for p in PREFIXES if p < top] + [top]:
            shared, depth = _agreement(pa_[:, : self.prefix], pb[:, : self.prefix])
            if not len(a) or (shared >= 2).mean() >= recall:
                break
        met = np.sort(depth[shared >= 2])
        self.least = int(met[int(len(met) * (1 - recall))]) if len(met) else 0

    def centred(self, u: np.ndarray) -> np.ndarray:
        x = u - self.centre
        size = np.sqrt((x * x).sum(axis=1))[:, None]
        return np.where(size > 1e-9, x / np.maximum(size, 1e-9), u)

    @staticmethod
    def _links(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of the sample; made ones, turned by just the angle allowed towards another vector, if they are few."""
        x = x[:4096]
        near = np.triu(x @ x.T, 1)
        a, b = np.nonzero((near >= threshold) & (near < 1 - 1e-9))
        if len(a) >= 100:
            few = np.random.default_rng(2).permutation(len(a))[:4096]
            return x[a[few]], x[b[few]]
        y = x[:1024]
        w = x[(np.arange(len(y)) * 7 + 1) % len(x)] - x[(np.arange(len(y)) * 11 + 2) % len(x)]
        w -= (w * y).sum(axis=1)[:, None] * y
        size = np.sqrt((w * w).sum(axis=1))
        y, w = y[size > 1e-6], w[size > 1e-6] / size[size > 1e-6][:, None]
        return y, threshold * y + np.sqrt(1 - threshold**2) * w

    def describe(self, x: np.ndarray, prefix: int | None = None) -> np.ndarray:
        """The nearest pivots of each row, nearest first (ties to the smaller pivot)."""
        prefix = min(prefix or self.prefix, len(self.pivots))
        near = -(self.centred(unit(x)) @ self.pivots.T)
        part = np.argpartition(near, prefix - 1, axis=1)[:, :prefix]
        part.sort(axis=1)
        return np.take_along_axis(part, np.argsort(np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1).astype(np.int16)


def _index(index: Index, kind: str):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                perm = index.describe(matrix(part.column(2), kind))
                low = np.sort(perm, axis=1).astype(np.int64)
                i, j = np.triu_indices(perm.shape[1], 1)
                keys = low[:, i] * (len(index.pivots) + 1) + low[:, j] if len(i) else low
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(perm) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                perms = binary_column(np.ascontiguousarray(perm).view(np.uint8).ravel(), np.arange(len(perm) + 1) * perm.shape[1] * 2)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), perms, lists], ["cls", "n", "vec", "perm", "keys"])

    return run


def _verify(index: Index, kind: str, threshold: float):
    def solve(held):
        """Many lists at once: ``held`` are (key, whether it is one tile, rows)."""
        rows = pa.concat_tables([r for _, _, r in held]).combine_chunks()
        size = np.array([r.num_rows for _, _, r in held])
        high = np.repeat([k % (len(index.pivots) + 1) for k, _, _ in held], size)
        two = np.repeat([not one for _, one, _ in held], size)
        end = np.repeat(np.cumsum(size), size)
        ids = rows.column("cls").combine_chunks()
        name = np.unique(np.array([x.as_py() for x in ids], object), return_inverse=True)[1]
        first = np.unique(name, return_index=True)[1]
        mult, tile = rows.column("n").to_numpy(), rows.column("_t").to_numpy()
        perm = np.frombuffer(b"".join(rows.column("perm").to_pylist()), np.int16).reshape(len(name), -1)
        x = matrix(rows.column("vec"), kind)
        links, u, v = np.zeros(len(first), np.int64), [], []
        after = end - np.arange(len(name)) - 1
        total, lo = np.cumsum(after), 0
        while lo < len(name):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] - after[lo] + PAIRS, side="right")))
            a = np.repeat(np.arange(lo, hi), after[lo:hi])
            b = ranges(np.arange(lo + 1, hi + 1), after[lo:hi])
            lo = hi
            apart = ~two[a] | (tile[a] != tile[b])  # pairs inside one of two tiles belong to that tile's own list
            a, b = a[apart], b[apart]
            if perm.shape[1] > 1:
                smaller, depth = _agreement(perm[a], perm[b], high[a])
                mine = (smaller == 1) & (depth >= index.least)
                a, b = a[mine], b[mine]
            for k in range(0, len(a), 1 << 15):
                p, q = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
                sure = cosine(x[p], x[q]) >= threshold
                p, q = p[sure], q[sure]
                np.add.at(links, name[p], mult[q])
                np.add.at(links, name[q], mult[p])
                u.append(name[p])
                v.append(name[q])
        some = np.flatnonzero(links)
        if not len(some):
            return
        root = union_find(len(first), np.concatenate(u).tolist(), np.concatenate(v).tolist())
        moved = np.flatnonzero(root != np.arange(len(first)))
        take = lambda k: ids.take(pa.array(first[k]))
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([take(some), take(moved)]), pa.array(np.concatenate([links[some], np.zeros(len(moved), np.int64)])), pa.concat_arrays([pa.nulls(len(some), pa.binary()), take(root[moved])])],
            ["u", "n", "v"],
        )

    def run(batches):
        held, size = [], 0
        for (key, i, j), rows in _groups(batches, 3):
            held.append((int(key), i == j, rows))
            size += rows.num_rows
            if size >= 4096:
                yield from solve(held)
                held, size = [], 0
        if held:
            yield from solve(held)

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.95, ident: str = "vec_id", vector: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id (the smallest id reachable over links) and kept."""
    scratch = scratch or Scratch(df.sparkSession, "pivots")
    every = df.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("vec_id")).distinct()
    kind = element(df, vector)
    base = scratch.keep(usable(df, ident, vector, dimension(df, vector)), "vectors")
    classes = scratch.keep(base.groupBy("cls").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")), "classes")
    n = classes.count()
    if n == 0:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    count = int(min(MOST, max(16, 2 ** round(np.log2(max(1.0, n) ** 0.5)))))
    index = Index(matrix(sampled(classes, max(LEAST, 4 * count), n).select("vec").toArrow().column("vec"), kind), count, threshold)
    lists = classes.select("cls", "n", "vec").mapInArrow(frugal(_index(index, kind)), "cls binary, n long, vec binary, perm binary, keys array<long>")
    lists = scratch.keep(lists, "lists").select(F.explode("keys").alias("key"), "cls", "n", "vec", "perm")
    work = _by_tile(tiled(lists, "key", "cls", TILE), ["key", "_i", "_j", "_t", "cls", "n", "vec", "perm"])
    found = scratch.keep(work.mapInArrow(frugal(_verify(index, kind, threshold)), "u binary, n long, v binary"), "links")
    links = found.where("v is null").groupBy("u").agg(F.sum("n").alias("far"))
    linked = scratch.keep(components(found.where("v is not null").select("u", "v"), scratch), "linked")
    per = classes.select("cls", "id", "n").join(links, F.col("cls") == F.col("u"), "left").join(linked, F.col("cls") == F.col("node"), "left")
    per = scratch.keep(per.select("cls", "id", "component", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links")), "per")
    least = per.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    tops = per.join(least, "component", "left").select("cls", "n_links", F.coalesce("least", "id").alias("top"))
    rows = base.select("id", "cls").join(tops, "cls").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("top").alias("top"))
    out = every.join(rows, F.col("vec_id") == F.col("id"), "left")
    top = F.coalesce("top", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), top.alias("component_id"), (top == F.col("vec_id")).alias("kept"))
