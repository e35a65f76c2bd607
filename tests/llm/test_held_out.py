"""Operators 1 and 10 on rows that they did not learn from."""

import zlib

from stratlens.llm import mixing, queries

LARGER = "/root/testdata/sf0.1"


def test_language(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    out = queries.op1_language(spark, LARGER).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out if r["held_out"]]
    assert len(held) > 2000 and sum(held) >= 0.98 * len(held)


def test_domains(spark):
    """Posteriors of operator 6 tell the domains of labelled rows that the fit did not see."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    known = mixing.domain(labels)
    learn, rest = known.where("doc_id % 4 <> 1"), known.where("doc_id % 4 = 1")
    model = mixing.fit(docs, learn)
    got = mixing.posteriors(docs.join(rest, "doc_id"), model, "domain").collect()
    right = sum(model[0][max(range(3), key=lambda k: r["p"][k])] == r["domain"] for r in got)
    common = rest.groupBy("domain").count().agg({"count": "max"}).first()[0]
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in got) and right > common + 0.02 * len(got)
