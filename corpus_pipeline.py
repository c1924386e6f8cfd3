"""A corpus pipeline: toxic documents go, then later similar lines, near copies and repeated passages; what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corollary.llm import line_dedup, minhash_dedup, packing, substring_dedup, toxicity
from corollary.llm.common import Scratch, returning
from corollary.shipping import ship


def counted(docs: DataFrame) -> DataFrame:
    """With n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def start(spark: SparkSession) -> None:
    """Ships the package and lets the driver forget finished stages: Spark cleans shuffles and broadcasts whose plans are gone, and its heap shrinks."""
    ship(spark)
    with returning(spark.sparkContext._gateway):
        spark.sparkContext._jvm.System.gc()


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    start(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    start(spark)
    return counted(line_dedup.remove(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    start(spark)
    return minhash_dedup.keep_first(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    start(spark)
    return counted(substring_dedup.remove(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    start(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", drop_passages),
    ("packing", pack),
]

#: SQL has no tokenizer and no lexicon automaton; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written before the next one reads it."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, "stage")
    return docs
