"""Operator 5: words, phrases and votes against plain Python on whole tables, and its odd cases."""

import re
import time
from collections import defaultdict

from stratlens.llm import licenses, queries

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
K = licenses.K


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text):
    """n_words, n_base, first, last, base labels, labels, score and spans, by comparing all grams as words."""
    w = words_of(text)
    base = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    shares, labels, spans = [0.0], {x for _, x in base}, 0
    place = defaultdict(list)
    for i in range(len(w) - K + 1):
        place[tuple(w[i : i + K])].append(i)
    for label, t in licenses.TEMPLATES:
        t = t.split()
        total, votes = len(t) - K + 1, defaultdict(list)
        for k in range(total):
            for i in place.get(tuple(t[k : k + K]), ()):
                votes[i - k].append(i)
        groups, last = [], None
        for d in sorted(votes):
            if last is None or d - last > licenses.GAP:
                groups.append([])
            groups[-1] += votes[d]
            last = d
        for g in groups:
            share = min(1.0, len(g) / total)
            if share >= licenses.SHARE and max(g) + K - min(g) <= 1.5 * len(t):
                shares.append(share)
                labels.add(label)
                spans += 1
    at = [i for i, _ in base]
    return (len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else max(shares), spans)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_spans").collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert rows(queries.op5_licenses(spark, SMALL)) == sorted(((r["doc_id"], *brute(r["text"])) for r in docs), key=str)


def test_odd_rows(spark):
    mit = licenses.TEMPLATES[1][1].split()
    texts = [
        None, "", " .,", "cc by", "CC  by and (General) Public license; All rights reserved", "cc by cc by cc", "Kc by cc", "ccé by", "Licensed under the Apache License, Version 2.0.",
        "permission is hereby granted free of charge to every person obtaining a copy of this software and associated documentation files", " ".join(mit), " ".join(mit).upper(),
        " ".join(mit[:40] + ["very", "much"] + mit[40:]), " ".join(mit[:30] + mit[33:]), " ".join(mit) + " x" * 50 + " " + " ".join(mit), " ".join(mit[:20]), "licensed under the mit license " * 3,
    ]
    table = [(k if k % 5 else None, t) for k, t in enumerate(texts)] + [(3, "cc by"), (3, "all rights reserved")]
    df = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "1 words", "2 `row`", "3 grams", "4 n_words", "5 base", "6 labels", "7 noted", "8 score")
    assert rows(licenses.scan(df)) == sorted(((d, *brute(t)) for d, t in table), key=str)
    assert licenses.scan(df.where("false")).collect() == []


def test_long_texts_are_linear(spark):
    unit = "some words of prose, licensed under the mit license, and the software of the authors " * 2000

    def took(n):
        df = spark.createDataFrame([(1, unit * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert licenses.scan(df).first()["n_words"] == 30_000 * n
        return time.perf_counter() - began

    took(1)
    assert took(16) < 6 * took(4) + 5
