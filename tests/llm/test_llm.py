"""Each operator on small tables: against brute force, and on nulls, empties, ties and clashing names."""

import hashlib
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratlens.llm import bpe, language, mixing, preference, substrings, toxicity
from stratlens.llm.common import flat_utf8
from stratlens.llm.queries import tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    base = text(1, 120)
    edited = base.split()
    edited[60] = "CHANGED"
    rows = [(0, base, "en"), (1, base, "en"), (2, " ".join(edited), "en"), (3, "", "en"), (4, None, None), (5, "Éa ñ", "fr"), (6, "... 123", "en"), (7, base[:150] + " é " + base[:150], "fr"), (8, text(3, 3000), "en"), (8, text(3, 3000), "en"), (9, "one two", None), (None, base, "en")]
    rows += [(20 + i, text(50 + i, 30) + (" idiot scum" if i % 4 == 0 else ""), "en" if i % 2 else "fr") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("score", "ids", "_h", "key", "kept", "n", "bands", "_text", "_letters", "_of", "_spans", "_n")}).cache()


def windows(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted({(d, t or "") for d, t in rows}):
        b = t.encode()
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                mark[i : i + length] = True
            seen.add(s)
        runs = int((mark & ~np.append(False, mark[:-1])).sum())
        out[d] = (len(b), int(mark.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mark])).hexdigest())
    return out


def test_substrings(docs):
    got = {r[0]: tuple(r[1:]) for r in substrings.digest(docs).collect()}
    ref = windows([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])
    assert {k: v for k, v in got.items() if k is not None} == ref and got[None][1] == 0
    assert substrings.digest(docs.where("false")).collect() == []


def test_bpe(docs):
    from tokenizers import Tokenizer

    tok, path = Tokenizer.from_file(tokenizer_path()), tokenizer_path()
    texts = ["", None, "it's  'st don't!'s\n\n x ", "a<|endoftext|>b", "x" * 900, "é　ü 12３ ½ 中文😀", *(r["text"] for r in docs.collect())]
    c = bpe.Codec(path)
    ids, at = c.encode(*flat_utf8(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids
    many = ["x<|endoftext|>" * 400, "<|endoftext|><|endoftext|>", "<|endof<|endoftext|>text|>", "<|endoftext|> b"]
    ids, at = c.encode(*flat_utf8(pa.array(many)))
    for i, t in enumerate(many):
        assert ids[at[i] : at[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids
    began = time.perf_counter()
    assert len(c.encode(*flat_utf8(pa.array(["x<|endoftext|>" * 50_000])))[0]) == 100_000
    assert time.perf_counter() - began < 20  # linear; a quadratic way takes minutes
    out = bpe.decode(bpe.encode(docs, path), path)
    assert out.where("decoded <> coalesce(text, '')").count() == 0 and out.count() == docs.count()


def test_language(docs):
    model = language.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    out = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert [out[k]["lang_pred"] for k in (3, 4, 6)] == ["und"] * 3 and 0 <= out[0]["score"] <= 1
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    assert "_letters" in language.predict(docs, model).columns and language.predict(docs.where("false"), model).collect() == []
    assert out[0]["lang_pred"] == out[1]["lang_pred"] and language.fit(docs.where("false").selectExpr("doc_id as key", "text", "lang")) is None
    code = language.codebook(12).astype(int)
    assert (np.abs(code @ code.T)[~np.eye(12, dtype=bool)] < code.shape[1]).all()


def test_mixing(docs, spark):
    labels = spark.createDataFrame([(20 + i, 1, int(i % 4 == 0)) for i in range(40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels, {"good": 1.0, "toxic": 0.25}).collect()
    assert len(out) == docs.count() and min(r["rate"] for r in out) >= 0
    for d, share in (("good", 1.0), ("toxic", 0.25)):
        now = sum(r["n_tokens"] * r[f"p_{d}"] for r in out)
        assert sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in out) == pytest.approx(share * now, rel=1e-3)
    far = mixing.mix(docs, labels, {"good": 0.0, "toxic": 40.0}).collect()  # rates can't give one without the other
    assert min(r["rate"] for r in far) >= 0 and len({r["rate"] for r in far if r["doc_id"] in (0, 1)}) == 1
    with pytest.warns(UserWarning, match="not settled"):
        mixing.rates(spark.sql("select 10L n_tokens, array(0.5D, 0.5D) p union all select 5L, array(0.9D, 0.1D)"), [1.0, 30.0], mixing.Scratch(spark, "t"), rounds=1)
    assert mixing.mix(docs, labels.where("false")).count() == docs.count()
    assert mixing.mix(docs.where("false"), labels.where("false")).count() == 0


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(20 + i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    out = toxicity.digest(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in toxicity.digest(docs, labels.where("false")).collect()} == {0.0}


def test_preference(spark):
    turn = lambda *x: [{"role": r, "text": t} for r, t in x]
    a = turn(("user", "hi"), ("assistant", "yo"), ("user", "x"), ("assistant", "good"))
    b = turn(("user", "hi"), ("assistant", "yo"), ("user", "x"), ("assistant", "bad"), (None, None))
    df = spark.createDataFrame([(1, a, b), (2, a, a), (3, None, a)], "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r["id"]: r for r in preference.prefer(df).collect()}
    assert got[1]["n_prompt_turns"] == 3 and got[2]["chosen_completion"] == "" and got[3]["prompt"] == ""
    r = got[1]
    s = r["chosen_learn"][0]
    odd = preference.prefer(df.withColumns({c: F.lit(1) for c in ("_c", "_n", "prompt", "_turns", "_at")}))
    assert odd.columns.count("prompt") == 1 and {x["id"]: x["prompt"] for x in odd.collect()} == {k: x["prompt"] for k, x in got.items()}
    few = [(-(2**63), 1, "user", "a"), (-(2**63), 1, "user", "a"), (5, 1, None, None), (5, 2, "assistant", ""), (None, 1, "user", "b")]
    flat = spark.createDataFrame(few, "conv_id long, turn int, role string, text string")
    assert {x["conv_id"]: x["n_prompt_turns"] for x in preference.digest(flat).collect()} == {-(2**63): 2, 5: 2} and preference.digest(flat.where("false")).collect() == []
    assert r["chosen_completion"][s["begin"] : s["stop"]] == "good<|end|>\n" and len(r["rejected_learn"]) == 1
