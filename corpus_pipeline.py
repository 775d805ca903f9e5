"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

quality classifier -> quality rules -> SimHash near-dedup -> mixing sources -> BPE.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm import bpe, mixing, quality, repetition, simhash
from tabsmith.llm.queries import tokenizer_file
from tabsmith.functions.core import q
from tabsmith.session import scratch_path
from tabsmith.sources.tables import read_table


def _columns(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*[F.col(q(c)) for c in docs.columns])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts (score of 0.3 or more)."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), cut=0.3)
    return _columns(docs, quality.score(docs, model, name="__score").filter(F.col("__score") >= 0.3))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the quality rules."""
    return repetition.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (4-word shingles, at most 4 differing bits)."""
    return simhash.drop_near_copies(docs, shingle=4, max_bits=4)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document of the mix, and digests of them and of the text they decode to."""
    columns = [c for c in ("doc_id", "source", "text") if c in docs.columns]
    out = bpe.encode(docs.select(*[F.col(q(c)) for c in columns]), tokenizer_file(), decoded_col="decoded")
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", classify), ("quality rules", rules), ("SimHash near-dedup", near_dedup),
          ("mixing sources", mixed),
          ("BPE encoding", tokenized)]

# The classifier, the fingerprints and the tokenizer have no SQL form: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"{folder}/{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
