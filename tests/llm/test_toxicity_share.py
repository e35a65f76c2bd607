"""Scores of operator 10 mean the same whatever part of a class was sampled, and hold on rows not used for fitting."""

import pytest
from pyspark.sql import functions as F

from stratlens.llm import toxicity
from stratlens.llm.language import fold

LARGER = "/root/testdata/sf0.1"


def test_share_and_held_out(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "toxic").cache()
    learn = labels.where(fold("doc_id", 5) != 0)
    held = docs.join(labels.where(fold("doc_id", 5) == 0), "doc_id").cache()
    share = held.agg(F.avg("toxic")).first()[0]
    few = learn.groupBy("toxic").count().agg(F.min("count")).first()[0]
    for per_class in (few, 2000):  # equal parts of both classes, and the larger class nearly whole
        out = toxicity.score(held, toxicity.fit(docs, learn, per_class=per_class), keep_text=False).cache()
        mean, false = out.agg(F.avg("score"), F.avg(F.expr("if(toxic = 0, predicted, null)"))).first()
        assert mean == pytest.approx(share, abs=0.03) and false <= 0.05
