"""Stages of the corpus pipeline, each on a small table where what it decides matters."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratlens.llm import language, minhash, mixing, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """(doc_id, text, lang) rows as documents."""
    return spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], COLUMNS)


def similarity(a, b):
    x, y = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_from_080(spark, tmp_path):
    words = [f"w{i}" for i in range(104)]
    base = " ".join(words)
    for k in (30, 70):
        words[k] = "other"
    between, apart = " ".join(words), " ".join(["more", *words[1:10], "edits", *words[11:]])
    assert 0.80 <= similarity(base, between) < 0.85 and similarity(base, apart) < 0.80
    docs = table(spark, [(1, base, "en"), (2, between, "en"), (3, base.replace("w50 ", "one "), "en")])
    assert [r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()] == [1]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, [(1, base, "en"), (2, between, "en"), (4, apart.replace("w5", "v5"), "en")])).collect()}
    assert got == {1: 1, 2: 1, 4: 4}
    # the query of operator 7 has a threshold of its own
    docs.where("doc_id < 3").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    assert {r["doc_id"]: r["component_id"] for r in queries.op7_minhash(spark, str(tmp_path)).collect()} == {1: 1, 2: 2}


def test_decoder_decides(spark):
    words = {"en": "the of and to in that with for this from".split(), "fr": "les des une dans pour avec être où déjà ça".split()}
    make = lambda g, i, n=40: " ".join(np.random.default_rng(i).choice(words[g], n))
    rows = [(i, make(g, i), g) for i in range(120) for g in ["en" if i % 2 else "fr"]]
    rows += [(1000, make("fr", 7), "en"), (1001, make("en", 8), None), (1002, "123 ...", "en"), (1003, None, "en")]
    # the same shares of both languages, in steps; somewhere the decoder can't tell
    rows += [(2000 + k, make("en", k, 40 - k) + " " + make("fr", k, k), None) for k in range(1, 40)]
    docs = table(spark, rows)
    model = language.fit(docs.where(language.fold("doc_id", 4) != 2).selectExpr("doc_id as key", "text", "lang"))
    said = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    unsure = {i for i, r in said.items() if r["ambiguous"]}
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify(spark, docs, "").collect()}
    assert unsure and min(unsure) >= 2000 and set(got) == set(said) - unsure - {1002, 1003}
    assert got[1000] == "fr" and got[1001] == "en" and all(got[i] == g for i, _, g in rows[:120])
    assert all(got[i] == said[i]["lang_pred"] for i in got)


SMALL = "/root/testdata/sf0.01"


def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    p = mixing.mix(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).cache()
    out = corpus_pipeline.mix(spark, docs, SMALL).select("doc_id").cache()
    assert out.count() > out.distinct().count()
    tokens = [F.sum(F.expr(f"n_tokens * p_{d}")) for d in mixing.TARGETS]
    before, after = p.agg(*tokens).first(), out.join(p, "doc_id").agg(*tokens).first()
    # rates are rounded by chance, document by document: what that spreads each total by
    spread = p.agg(*(F.sqrt(F.sum(F.expr(f"pow(n_tokens * p_{d}, 2) * (rate - floor(rate)) * (1 - rate + floor(rate))"))) for d in mixing.TARGETS)).first()
    for k, share in enumerate(mixing.TARGETS.values()):
        assert after[k] == pytest.approx(share * before[k], abs=3 * spread[k])
    assert after[0] > before[0] and 3 * spread[0] < 0.06 * before[0]
    odd = table(spark, [(None, "a b c d", "en"), (None, "e f g", "en"), (7, "same id", "en"), (7, "other text", "en")])
    lone = corpus_pipeline.mix(spark, docs.limit(50).unionByName(odd), SMALL).where("doc_id is null or source = 's'")
    assert lone.where("doc_id is null").count() > 0 and lone.where("doc_id = 7").count() > 0


def test_near_dedup_of_rows(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a, "en"), (1, a, "en"), (None, a + " more", "en"), (None, b, "en"), (None, b, "en"), (2, c, "en"), (3, c + " more", "en"), (3, d, "en")]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, table(spark, rows), "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (None, b), (2, c), (3, d)], key=str)
