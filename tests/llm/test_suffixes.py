"""Suffix arrays and permuted common prefixes against brute force, at lengths that use every path."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratlens.llm import substrings, suffixes

from .test_llm import windows

rng = np.random.default_rng(0)


def texts():
    for _ in range(60):
        yield rng.integers(0, 3, int(rng.integers(1, 50)))
    some = rng.integers(0, 256, 40)
    yield np.tile(rng.integers(0, 4, 97), 80)  # 7,760 symbols with long repeats: names repeat over several levels
    yield rng.integers(0, 256, 6000)
    yield np.concatenate([some[rng.integers(0, 40, 50)] if k % 3 else some for k in range(150)])
    yield np.zeros(5000, int)
    yield np.tile([1, 0], 3000)
    a, b = [0], [0, 1]
    while len(b) < 6000:
        a, b = b, b + a  # a Fibonacci word, the deepest recursion
    yield np.array(b)


def order_of(t):
    b = t.astype(np.uint8).tobytes()
    return sorted(range(len(b)), key=lambda i: b[i:])


def test_order():
    for t in texts():
        assert suffixes.suffix_array(t).tolist() == order_of(t)


@pytest.mark.parametrize("induce", ["_induce", "_induce_names"])
def test_either_induction(induce):
    for t in texts():
        t = t.astype(np.int64)
        s = suffixes.classify(t)
        lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
        want = np.array(order_of(t))
        rank = np.argsort(want)
        assert getattr(suffixes, induce)(t, s, lms[np.argsort(rank[lms])], 256).tolist() == want.tolist()


def test_common_prefixes():
    for t in texts():
        n = len(t)
        sa = suffixes.suffix_array(t)
        ends = np.sort(rng.choice(np.arange(1, n + 1), min(n, 5), replace=False))
        ends[-1] = n
        stop = ends[np.searchsorted(ends, np.arange(n), side="right")]
        b = t.astype(np.uint8).tobytes()
        got = suffixes.permuted_lcp(t.astype(np.uint16), sa, stop)
        for i, j in [(0, None), *zip(range(1, n), range(n - 1))] if n < 60 else [(int(k), int(k) - 1) for k in rng.integers(1, n, 60)]:
            if j is None:
                continue
            x, y = int(sa[i]), int(sa[j])
            p, q = b[x : stop[x]], b[y : stop[y]]
            assert got[x] == next((k for k, (u, v) in enumerate(zip(p, q)) if u != v), min(len(p), len(q)))


def test_long_and_clashing(spark):
    """Texts of more than a piece, one phrase in most of them, and columns named like the operator's own."""
    words = np.array([f"w{k}" for k in range(5000)])
    long = " ".join(rng.choice(words, 150_000))
    rows = [(1, long), (2, long[1000:3000] + "é" * 200), (3, long[-700_000:-600_000]), (4, "x" * 700_000), (5, None), (6, "")]
    assert len(long) > substrings.PIECE
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_of", "_text", "_spans", "_id", "spans", "kept", "begin", "fp", "shard")})
    got = substrings.deduplicate(df)
    assert {"_of", "_text", "_spans"} <= set(got.columns)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"])) for r in got.collect()} == {d: w[:3] for d, w in windows(rows).items()}


def test_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 20)
    base = "a phrase of a good many documents, of more than one hundred bytes as one can see, if one counts them all"
    rows = [(k, f"{k * 7919} {base[: 60 + k % 40]} {k % 9} {base} {k * 31}") for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: tuple(r[1:]) for r in substrings.digest(df).collect()} == windows(rows)


def asked(rows, length=100):
    """The (doc_id, begin, stop) of which the suffix arrays get the bytes."""
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    runs = pa.Table.from_batches(substrings._scan(length, 8)([batch])).sort_by("shard").combine_chunks()
    found = pa.Table.from_batches(substrings._resolve(length)(runs.to_batches()))
    return [(r["doc_id"], r["begin"], r["stop"]) for r in found.to_pylist() if r["fp"] is not None]


def test_only_bytes_that_may_be_common_are_sorted():
    """A phrase too short for a window gives its anchor many contexts, none of which has a window in common with another."""
    some = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    phrase = "that a good many documents have, sixty bytes of it in all..."
    rows = [(k, f"{some(20)} {phrase} {some(20)}") for k in range(200)]
    assert len(phrase) == 60 and len(asked(rows)) < 20  # but for marks of 16 bits that happen to be equal
    rows = rows[:20] + [(500 + k, f"{some(20)} {phrase * 3} {some(20)}") for k in range(3)]
    assert {d for d, _, _ in asked(rows)} >= {500, 501, 502}
    for d, begin, stop in asked(rows):
        at = dict(rows)[d].index(phrase)
        assert stop - begin >= 100 and at - 51 < begin and stop < at + 180 + 51


@pytest.mark.parametrize("length", [24, 26, 61, 100])
def test_edited_copies(spark, length):
    """Copies that differ every few words, so that almost each anchor has several contexts."""
    words = np.array([f"w{k}" for k in range(300)])
    base, rows = rng.choice(words, 400), []
    for k in range(25):
        copy = base.copy()
        edit = rng.random(len(copy)) < k / 200
        copy[edit] = rng.choice(words, edit.sum())
        rows.append((k, " ".join(copy[rng.integers(0, 30) :])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.deduplicate(df, length).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == windows(rows, length)


def test_equal_windows():
    x, y = b"abcabcabc" * 3, b"xxabcabcabcyy"
    off = np.array([0, len(x), len(x) + len(y)])
    place, cls = substrings.equal_windows(np.frombuffer(x + y, np.uint8), off, np.zeros(2), 9)
    spaced = x + b"\0" + y + b"\0"
    assert {spaced[p : p + 9] for p in place} == {w for w in (spaced[p : p + 9] for p in range(len(spaced) - 9)) if b"\0" not in w and spaced.count(w[:1]) and sum(spaced[q : q + 9] == w for q in range(len(spaced))) > 1}
    assert len(set(zip(cls.tolist(), (spaced[p : p + 9] for p in place)))) == len(set(cls.tolist()))


def test_binary_column():
    assert substrings.binary_column(b"abc", np.array([0, 1, 3])).equals(pa.array([b"a", b"bc"]))
