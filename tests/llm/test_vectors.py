"""Operators 3 and 9 against brute force: recall at two sizes, one-sided and tied vectors, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratlens.llm import neighbours, pivots

ODD = [(90_000, None), (90_050, []), (91_000, [0.0] * 24), (91_001, [float("nan")] * 24), (91_002, [None] + [1.0] * 23), (None, [1.0] * 24), (91_003, [1.0])]


def data(n, aside=0.0, seed=3):
    """Clusters, near copies and equal rows; ``aside`` turns all vectors one way."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n // 20, 24))[rng.integers(0, n // 20, n)] + rng.normal(size=(n, 24)) * 0.35
    x[n // 3 : n // 2] = x[rng.integers(0, n // 3, n // 2 - n // 3)] * 1.5 + rng.normal(size=(n // 2 - n // 3, 24)) * 0.05
    x[-20:] = x[0]
    x[0] *= 1e-150  # its square is nearly nothing
    return x + aside * np.sqrt(24) * np.eye(24)[0]


def frame(spark, x, odd=ODD):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + odd, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit(1) for c in ("id", "vec", "n", "cls", "key", "perm", "component", "list")})


def cosines(x):
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    return u @ u.T


@pytest.mark.parametrize("n, aside", [(600, 0.0), (2500, 3.0)])
def test_near_duplicates(spark, n, aside):
    x = data(n, aside)
    near = cosines(x) >= 0.95
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in pivots.near_duplicates(frame(spark, x)).collect()}
    found = np.array([got[i]["n_links"] for i in range(n)])
    assert (found <= near.sum(1) + 0).all() and found.sum() >= 0.97 * near.sum() > 0
    assert len(got) == n + 6 and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (90_000, 90_050, 91_000, 91_001, 91_002, 91_003))
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got) and got[n - 1]["component_id"] == got[n - 20]["component_id"] == 0
    for i in np.flatnonzero(found == near.sum(1))[:50]:
        assert got[i]["component_id"] <= min([i, *np.flatnonzero(near[i])])


def test_ties_and_repeats(spark):
    """A cosine of just 0.95 links; ids that two rows share have one row; few rows, and none."""
    a, b = [20.0, 0.0, 0.0], [19.0, float(np.sqrt(39.0)), 0.0]
    exact = float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    rows = [(1, a), (2, b), (2, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 2.0]), (4, [-1.0, 0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_duplicates(frame(spark, [], rows)).collect()}
    tied = exact >= 0.95
    assert got == {1: (int(tied), 1), 2: (1, 1 if tied else 2), 3: (1, 2), 4: (0, 4)}
    assert pivots.near_duplicates(frame(spark, [], [])).collect() == []


@pytest.mark.parametrize("n, aside", [(600, 0.0), (2500, 3.0)])
def test_neighbours(spark, n, aside):
    x = data(n, aside)
    out = {}
    for r in neighbours.digest(frame(spark, x)).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    s = cosines(x)
    assert sorted(out) == list(range(0, n, 50)) and all(sorted(k for k, _, _ in v) == [1, 2, 3, 4, 5] for v in out.values())
    hit = 0
    for q, rows in out.items():
        t = np.round(s[q], 12)
        t[q] = -9
        best = np.lexsort((np.arange(n), -t))[:5]
        hit += len({v for _, v, _ in rows} & set(best.tolist()))
        assert all(score == pytest.approx(s[q, v], abs=1e-12) for _, v, score in rows)
        rows.sort()
        assert all((-a[2], a[1]) <= (-b[2] + 1e-12, b[1] + (a[2] - b[2] > 1e-12) * n) for a, b in zip(rows, rows[1:]))
    assert hit >= 0.9 * 5 * len(out)


def test_graph_sees_a_part(spark):
    """A search of many centroids reads a beam of them, and finds the nearest ones."""
    rng = np.random.default_rng(0)
    c = rng.normal(size=(100, 32))[rng.integers(0, 100, 3000)] + rng.normal(size=(3000, 32)) * 0.5
    c /= np.linalg.norm(c, axis=1)[:, None]
    q = c[:200] + rng.normal(size=(200, 32)) * 0.05
    ids, score = neighbours.Graph(c).search(q, 64)
    best = np.argsort(-(q @ c.T), axis=1)[:, :8]
    assert ids.shape == (200, 64) and (np.diff(score, axis=1) <= 1e-12).all()
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids.tolist(), best.tolist())]) >= 0.9
