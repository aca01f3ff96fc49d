"""A corpus pipeline of five stages over the documents, each by one operator of evigraph.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import bpe, decontamination, ngram_join, secrets, toxicity
from evigraph.llm.shared import Scratch, parted

TOXIC = 0.7
#: Near duplicates: words of a shingle, and similarity in percent.
WIDTH, PERCENT = 5, 80
#: Stretches of text whose encodings a worker keeps; fewer than usual, as workers have run other stages before.
PIECES = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored TOXIC or higher go; the model learns from two thirds of the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)), F.lit(0)) != 1
    model = toxicity.fit(docs, "doc_id", "text", labels, "doc_id", "toxic", learn)
    return toxicity.drop_toxic(docs, "text", model, TOXIC)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the smallest id stays; rows that repeat its id and text count as one.

    Documents without words, or without an id, are in no group and stay.
    """
    grouped = ngram_join.similar_texts(docs, "doc_id", "text", WIDTH, PERCENT).filter("doc_id is not null")
    tally = grouped.groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    odd = Scratch(spark, "groups").save(tally.filter("_n = 0 or _rows > 1"), "odd")
    # most documents stay as they are, and their texts are not shuffled
    plain, rest = parted(docs, "doc_id", odd)
    rest = rest.join(odd, "doc_id", "left").filter("_n is null or _n > 0")
    if not odd.filter("_rows > 1").isEmpty():
        once = rest.filter("_rows > 1").dropDuplicates(["doc_id", "text"])
        rest = rest.filter("_rows is null or _rows = 1").unionByName(once)
    return plain.unionByName(rest.select(docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item within its error budget go."""
    return decontamination.drop_leaks(docs, "text", spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by marks; n_chars is that of the new text."""
    named = docs.withColumn("_repository", F.concat_ws("/", "source", "lang"))
    out = secrets.redact_secrets(named, "text", "_repository", "source").drop("_repository")
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded to byte-pair tokens and decoded again."""
    return bpe.encode_digests(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("byte-level BPE", encode),
]

#: SQL can't express a learned model or byte-pair merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order over documents; every stage's rows are written before the next begins."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{k}")
    return docs
