"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted by balanced k-means on a bounded sample (``SAMPLE`` rows by a hash); a graph of
nearest centroids, searched best-first in memory, finds the lists of a vector.  A vector goes to its
nearest list and, near a boundary, to more: to each list whose centroid is at most ``spill`` times
as far, unless a list it is in already is nearer to that centroid (such copies add little).  A query
reads the lists whose centroids are at most ``ratio`` times as far as its nearest one; where the nearest
lists are too short to hold more than ``top`` vectors, as far as the first one with which they do.  A
query that still has fewer than ``top`` results, though there are more vectors, is compared with all.

The number of lists grows with the square root of the number of vectors up to ``MOST``; a search sees a
beam of ``width`` of their centroids, however many there are.  Lists longer
than ``LIST`` (copies of a vector can't be told apart by centroids) are cut into parts by a hash, all
of which are read, and the queries of a part are cut into blocks: no group grows with the data.

Results are exact cosines in double precision on the original vectors; ties go to the smaller id.
Vectors that are null, empty, zero, of another length than most or with null or non-finite components
take no part.  Extra columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, frugal
from .minhash import _groups
from .vectors import cosine, dimension, element, matrix, sampled, unit, usable

SAMPLE = 16384
MOST = 4096
LIST = 4096
QUERIES = 1024


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 8, weight: float = 0.05) -> np.ndarray:
    """k-means on unit vectors; a list's size over its fair share makes it less attractive."""
    rng = np.random.default_rng(5)
    c = x[rng.permutation(len(x))[:k]].copy()
    load = np.full(len(c), len(x) / len(c))
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T - weight * np.log(np.maximum(load, 1) * len(c) / len(x))).argmax(axis=1) for a in range(0, len(x), 4096)])
        count = np.bincount(near, minlength=len(c))
        load = 0.5 * load + 0.5 * count
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = count == 0
        total[empty] = x[rng.integers(0, len(x), int(empty.sum()))]
        c = unit(total + 1e-12)
    return c


class Graph:
    """Nearest-centroid graph with best-first search, for many vectors in step."""

    def __init__(self, c: np.ndarray, degree: int = 24):
        self.c = c
        degree = min(degree, len(c) - 1)
        near = c @ c.T
        np.fill_diagonal(near, -9)
        self.next = np.argsort(-near, axis=1, kind="stable")[:, :degree] if degree > 0 else np.zeros((len(c), 0), np.int64)
        rng = np.random.default_rng(1)
        if len(c) > 2 * degree and degree > 0:  # a few long edges keep it connected
            self.next = np.concatenate([self.next, rng.integers(0, len(c), (len(c), 4)), ((np.arange(len(c)) + 1) % len(c))[:, None]], axis=1)

    def search(self, q: np.ndarray, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids met, nearest first, and their cosines.

        A beam of ``width`` centroids a query; its best unread ones are read, ``at_once`` in a step, until none is left.
        """
        n, k = len(q), len(self.c)
        width = min(width, k)
        start = np.unique(np.linspace(0, k - 1, min(k, max(8, width // 4))).astype(int))
        seen = np.zeros((n, k), bool)
        seen[:, start] = True
        ids = np.full((n, max(width, len(start))), -1)
        score = np.full(ids.shape, -np.inf)
        ids[:, : len(start)], score[:, : len(start)] = start, q @ self.c[start].T
        done = np.zeros(ids.shape, bool)
        alive = np.arange(n)
        step = min(at_once, ids.shape[1])
        while len(alive) and self.next.shape[1]:
            open_ = np.where(done[alive], -np.inf, score[alive])
            best = np.argpartition(-open_, step - 1, axis=1)[:, :step]
            real = np.isfinite(np.take_along_axis(open_, best, 1))
            go = real.any(axis=1)
            alive, best, real = alive[go], best[go], real[go]
            if not len(alive):
                break
            rows = np.arange(len(alive))[:, None]
            done[alive[:, None], best] |= real
            near = self.next[np.where(real, ids[alive[:, None], best], 0)]
            new = real[:, :, None] & ~seen[alive[:, None, None], near]
            r, c = np.divmod(np.unique((rows[:, :, None] * k + near)[new]), k)
            seen[alive[r], c] = True
            cand_id, cand = np.full((len(alive), step * self.next.shape[1]), -1), np.full((len(alive), step * self.next.shape[1]), -np.inf)
            slot = np.arange(len(r)) - np.searchsorted(r, r)
            cand_id[r, slot], cand[r, slot] = c, (q[alive[r]] * self.c[c]).sum(axis=1)
            all_id, all_s = np.concatenate([ids[alive], cand_id], axis=1), np.concatenate([score[alive], cand], axis=1)
            all_d = np.concatenate([done[alive], np.zeros(cand.shape, bool)], axis=1)
            top = np.argpartition(-all_s, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
            ids[alive], score[alive], done[alive] = all_id[rows, top], all_s[rows, top], all_d[rows, top]
        order = np.lexsort((ids, -score))[:, :width]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def _distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cos, 1e-12))


class Index:
    def __init__(self, sample: np.ndarray, lists: int, spill: float, ratio: float, copies: int, width: int):
        x = unit(sample)
        self.graph = Graph(balanced_centroids(x, min(lists, len(x))))
        self.spill, self.ratio, self.copies, self.width = spill, ratio, copies, width

    def postings(self, x: np.ndarray) -> list[np.ndarray]:
        found, cos = self.graph.search(unit(x), 4 * self.copies)
        far = _distance(cos)
        c = self.graph.c
        out = [[int(r[0])] for r in found]
        for k in range(1, found.shape[1]):
            for i in np.flatnonzero(far[:, k] <= self.spill * far[:, 0]):
                mine = out[i]
                if len(mine) < self.copies and (_distance(c[mine] @ c[found[i, k]]) > far[i, k]).all():
                    mine.append(int(found[i, k]))
        return [np.array(r) for r in out]

    def probes(self, q: np.ndarray, held: np.ndarray, top: int) -> list[np.ndarray]:
        """``held``: how many vectors have each list as their nearest."""
        found, cos = self.graph.search(unit(q), self.width)
        far = _distance(cos)
        enough = np.minimum((held[found].cumsum(axis=1) <= top).sum(axis=1), found.shape[1] - 1)  # one is the query
        limit = self.ratio * far[np.arange(len(far)), enough]
        return [f[d <= m] for f, d, m in zip(found, far, limit)]


def _route(index: Index, kind: str, how: str, *more):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                lists = getattr(index, how)(matrix(part.column(1), kind), *more)
                off = np.concatenate([[0], np.cumsum([len(r) for r in lists])])
                col = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(lists).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), col], ["id", "vec", "lists"])

    return run


def _read(top: int, kind: str):
    def run(batches):
        for _, rows in _groups(batches, 3):
            side, ids, x = rows.column("kind").to_numpy(), rows.column("id").to_numpy(), matrix(rows.column("vec"), kind)
            q, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(q) or not len(c):
                continue
            c = c[np.argsort(ids[c], kind="stable")]
            near = unit(x[q]) @ unit(x[c]).T
            near[ids[q][:, None] == ids[c][None, :]] = -9
            new = np.append(True, ids[c][1:] != ids[c][:-1])  # an id that many rows share counts once
            own, count = np.cumsum(new) - 1, int(new.sum())
            if count > top:
                best = near if count == len(c) else np.maximum.reduceat(near, np.flatnonzero(new), axis=1)
                least = np.partition(best, count - top, axis=1)[:, count - top] - 1e-9
            else:
                least = np.full(len(q), -8.0)
            r, k = np.nonzero((near >= least[:, None]) & (near > -8))
            s = cosine(x[q[r]], x[c[k]])
            # the best ``top`` of this part for each query
            order = np.lexsort((ids[c[k]], -s, r))
            order = order[np.sort(np.unique(r[order] * count + own[k[order]], return_index=True)[1])]
            r, k, s = r[order], k[order], s[order]
            first = np.searchsorted(r, r)
            use = np.arange(len(r)) - first < top
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[r[use]]]), pa.array(ids[c[k[use]]]), pa.array(s[use])], ["query_id", "vec_id", "score"])

    return run


def search(df: DataFrame, queries, top: int = 5, ident: str = "vec_id", vector: str = "embedding", spill: float = 1.15, ratio: float = 1.35, copies: int = 4, width: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id and score; ``queries`` is a condition on the column ``id``."""
    scratch = scratch or Scratch(df.sparkSession, "neighbours")
    base = scratch.keep(usable(df, ident, vector, dimension(df, vector)), "vectors")
    n = base.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return df.sparkSession.createDataFrame([], schema)
    lists = int(min(MOST, max(1, round(n**0.5))))
    kind = element(df, vector)
    sample = sampled(base, SAMPLE, n).select("vec").toArrow()
    index = Index(matrix(sample.column("vec"), kind), lists, spill, ratio, copies, width)
    spec = "id long, vec binary, lists array<long>"
    posts = scratch.keep(base.select("id", "vec").mapInArrow(frugal(_route(index, kind, "postings")), spec).select(F.posexplode("lists").alias("nth", "list"), "id", "vec"), "postings")
    # parts of long lists and blocks of many queries; a table of at most MOST rows
    sizes = scratch.keep(posts.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("parts"), F.sum((F.col("nth") == 0).cast("long")).alias("held")), "sizes")
    held = np.zeros(lists, np.int64)
    for r in sizes.collect():
        held[r["list"]] = r["held"]
    asks = scratch.keep(base.where(queries).select("id", "vec").mapInArrow(frugal(_route(index, kind, "probes", held, top)), spec).select(F.explode("lists").alias("list"), "id", "vec"), "probes")
    blocks = asks.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    found = scratch.keep(_compared(posts, asks, sizes.select("list", "parts").join(blocks, "list"), top, kind), "found")
    # what lists can't give (ids that many rows share, vectors the lists hold too few of) comes from all vectors
    most = min(top, base.select("id").distinct().count() - 1)
    have = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    asked = base.where(queries).select("id", "vec")
    short = scratch.keep(asked.join(have, F.col("id") == F.col("query_id"), "left").where(F.coalesce("have", F.lit(0)) < most).select(F.lit(0).cast("long").alias("list"), "id", "vec"), "short")
    left = short.count()
    if left:
        plan = df.sparkSession.range(1).select(F.col("id").alias("list"), F.lit(-(-n // LIST)).cast("int").alias("parts"), F.lit(-(-left // QUERIES)).cast("int").alias("blocks"))
        exact = _compared(base.select(F.lit(0).cast("long").alias("list"), "id", "vec"), short, plan, top, kind)
        found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(exact)
    return found.select("query_id", "rank", "vec_id", "score")


def _compared(posts: DataFrame, asks: DataFrame, plan: DataFrame, top: int, kind: str) -> DataFrame:
    """query_id, vec_id, score and rank of the best ``top`` in the lists asked for; ``plan``: parts and blocks of each list."""
    plan = F.broadcast(plan)
    h = F.xxhash64("id", F.lit(3))
    p = posts.join(plan, "list").withColumn("part", F.pmod(h, F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    q = asks.join(plan, "list").withColumn("block", F.pmod(h, F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = p.select("list", "part", "block", F.lit(1).alias("kind"), "id", "vec").unionByName(q.select("list", "part", "block", F.lit(0).alias("kind"), "id", "vec"))
    work = both.repartition("list", "part", "block").sortWithinPartitions("list", "part", "block")
    found = work.mapInArrow(frugal(_read(top, kind)), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top)


def digest(df: DataFrame) -> DataFrame:
    """The 5 nearest of every row whose vec_id is divisible by 50."""
    return search(df, F.col("id") % 50 == 0)
