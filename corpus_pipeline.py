"""A corpus pipeline of five stages, each of which works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns documents; ``run`` writes each result to the
shared folder and reads it again.  The last stage adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlens.llm import bpe, language, minhash, mixing, substrings
from stratlens.llm.common import Scratch
from stratlens.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (operator 1): ``lang`` becomes the prediction; documents without a letter, or ambiguous ones, go.

    Ambiguous is what the decoder calls so: two languages whose losses differ by less than ``language.fit``'s margin
    of 1, a likelihood ratio below e.  Of the documents of sf0.1 these are 4 in 10,000, of its held-out ones none.
    """
    model = language.fit(docs.where(language.fold("doc_id", 4) != 2).select(F.col("doc_id").alias("key"), "text", "lang"))
    out = language.predict(docs, model).where("lang_pred <> 'und' and not ambiguous")
    return out.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (operator 7) at a similarity of 0.8 or more: one row of each group, that of the smallest doc_id, stays.

    Rows are told apart by their doc_id and text (a hash of both stands for the id): a null doc_id counts as the
    largest, equal rows are one, and different texts of one doc_id are judged each by itself.
    """
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    near = minhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), minhash.Settings(percent=80, bands=32, rows=4))
    near = near.select(F.col("doc_id").alias("_row"), "component_id").distinct().join(rows.select("_row", "doc_id").distinct(), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    keep = near.groupBy("component_id").agg(first).select("first._row")
    return rows.join(keep, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup (operator 4): passages that start earlier go; a document of which nothing is left goes."""
    out = substrings.deduplicate(docs, characters=True)
    text = F.decode("kept", "UTF-8")
    return out.where(F.octet_length("kept") > 0).withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (operator 6): every row stays as many times as its fitted rate says, so also more than once.

    Rows are told apart by their doc_id and text; equal rows have equal rates.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    copies = mixing.mix(rows, labels, keep=("doc_id", "_row"), by="_row").groupBy("_row").agg(F.max("copies").alias("copies")).where("copies > 0")
    return rows.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding (operator 8): token ids, and whether they decode to the text."""
    out = bpe.encode(docs.select(*COLUMNS), tokenizer_path(), decoded=True)
    return out.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [("language ID", identify), ("MinHash near-dedup", one_of_each), ("suffix-array dedup", cut_repeats), ("mixing", mix), ("BPE", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}", drop=(f"stage-{k - 1}",))
    return docs
