"""Every query has as many neighbours as there are candidates, up to ``top``."""

import numpy as np
from pyspark.sql import functions as F

from stratlens.llm import neighbours


def run(spark, ids, x):
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")
    out = {}
    for r in neighbours.search(df, F.col("id") >= 0).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    return {q: [v for _, v in sorted(rows)] for q, rows in out.items()}


def exact(ids, x, q):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    best = {}
    for s in (u[ids == q] @ u.T):
        for i, v in zip(ids.tolist(), s.tolist()):
            if i != q:
                best[i] = max(best.get(i, -9), v)
    return sorted(best, key=lambda i: (-round(best[i], 12), i))[:5]


def test_small_table(spark):
    x = np.random.default_rng(1).normal(size=(4, 64))
    got = run(spark, range(4), x)
    assert got == {q: exact(np.arange(4), x, q) for q in range(4)} and all(len(v) == 3 for v in got.values())


def test_outliers_and_small_clusters(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 64))[rng.integers(0, 20, 400)] + rng.normal(size=(400, 64)) * 0.1
    x[::40] = rng.normal(size=(10, 64))  # alone
    x[1:4] = rng.normal(size=64) + rng.normal(size=(3, 64)) * 0.01
    ids = np.arange(400)
    got = run(spark, ids, x)
    assert {q: len(v) for q, v in got.items()} == dict.fromkeys(range(400), 5)
    assert sum(len(set(got[q]) & set(exact(ids, x, q))) for q in [1, 2, 3, *range(0, 400, 40)]) >= 0.9 * 5 * 13


def test_shared_id(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 16))
    x[:40] = x[0] + rng.normal(size=(40, 16)) * 0.01
    x[40] = x[0] + rng.normal(size=16) * 0.01
    ids = np.where(np.arange(60) < 40, 0, np.arange(60))
    got = run(spark, ids, x)
    assert got[0] == exact(ids, x, 0) and got[40] == exact(ids, x, 40)
    assert {q: len(v) for q, v in got.items()} == dict.fromkeys(set(ids.tolist()), 5)
