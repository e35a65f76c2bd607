"""Operator 7 against brute force on whole tables, and on the odd cases its docstring defines."""

import itertools
import re

import numpy as np
import pyarrow as pa

from stratlens.llm import minhash, queries
from stratlens.llm.common import flat_utf8, word_codes

SMALL = "/root/testdata/sf0.01"
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent):
    """(doc_id, n_shingles, component_id, kept) of each row, by all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    by, root = {}, list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in {p for members in by.values() for p in itertools.combinations(members, 2)}:
        common = len(sets[i] & sets[j])
        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            root[find(max(i, j))] = find(min(i, j))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(s), least[find(i)] if s else d, (least[find(i)] if s else d) == d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, rows, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(df, minhash.Settings(percent=percent, bands=32, rows=4))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op7_minhash(spark, SMALL).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 85)


def words(seed, n=60):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n)]


def edited(base, *at):
    return " ".join("other" if k in at else w for k, w in enumerate(base))


def test_odd_rows(spark, monkeypatch):
    """Each case has words of its own; they share one table, and one run."""
    text = " ".join

    def pair(k):
        return words(10 * k, 200), words(10 * k + 1, 200)

    (a, b), (c, d), (e, f), g, t = pair(1), pair(2), pair(3), words(4, 200), words(5, 54)
    rows = [(0, text(a)), (1, edited(a, 50)), (1, "")]
    rows += [(18, text(c)), (18, text(d)), (19, edited(c, 5)), (20, edited(d, 5))]
    rows += [(None, text(e)), (None, edited(e, 7)), (33, edited(e, 9)), (None, text(f)), (None, None), (34, None)]
    rows += [(45, "One  two"), (42, "one\ttwo"), (47, "one two three"), (46, " \n"), (41, "É"), (40, "é"), (48, "x" * 3_000_000), (49, "y" * 3_000_000)]
    rows += [(100 + k, text(g)) for k in range(50)] + [(200 + k, edited(g, k % 90, (k * 7) % 90)) for k in range(200)] + [(105, text(g))]
    # similarities at and about the threshold: 50 shingles, and one more for each word at the end
    more = words(6, 10)
    for k in range(4, 11):
        mine = [f"{k}{w}" for w in t]
        rows += [(500 + 10 * k, text(mine)), (501 + 10 * k, text(mine + [f"{k}{w}" for w in more[:k]]))]
    long = words(7, 100_000)
    rows += [(1000, text(long)), (1001, edited(long, 1000))]
    monkeypatch.setattr(minhash, "TILE", 16)  # many tiles of one group
    monkeypatch.setattr(minhash, "TILE_SHINGLES", 3000)
    assert found(spark, rows, 85) == brute(rows, 85)
    assert found(spark, [], 85) == []


def test_extra_columns(spark):
    df = spark.sql("select 1L doc_id, 'a b c d e f' text, 2 n, 3 cls, 4 `row`, 5 component, 6 bands, 7 key, 8 low, 9 `_t`, 10 sig, 11 n_shingles, 12 kept")
    assert [tuple(r) for r in minhash.near_duplicates(df).collect()] == [(1, 2, 1, True)]


def test_structured_words_differ():
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    for n in (128, 256, 1024, 2048, 4096):  # words that collide in any polynomial hash modulo 2**64
        x = bytes(97 + b for b in bits[:n])
        data, off = flat_utf8(pa.array([x, bytes(195 - c for c in x), x], pa.binary()))
        code = word_codes(data, off[:-1], off[1:])
        assert code[0] != code[1] and code[0] == code[2]
