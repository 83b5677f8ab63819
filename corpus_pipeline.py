"""Cleans a corpus and mixes its sources: five stages, each over all that the one before has kept.

Each stage first lets the driver forget the plans of the one before, so that one driver runs all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanweave.llm import decontamination, mixing, near_dedup, private_data, quality
from loanweave.llm.common import release, table
from loanweave.session import scratch_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    release(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    release(spark)
    return near_dedup.without_copies(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    release(spark)
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def no_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates."""
    release(spark)
    return private_data.with_surrogates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document that it takes, with its text, how often, and its words in all."""
    release(spark)
    key = {"id": "doc_id", "of": "source", "words": "size"}
    # Rows alike in id, source and size have one rate; their copies are summed here and dealt out again by number.
    mix = mixing.mix_to_weights(docs).withColumnsRenamed({v: k for k, v in key.items()}).groupBy(*key)
    mix = mix.agg(F.min("source_size").alias("source_size"), F.min("target").alias("target"), F.sum("copies").alias("all_copies"), F.count(F.lit(1)).alias("alike"))
    texts = docs.select("doc_id", "source", "lang", "text", mixing.n_words(F.col("text")).alias("size"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("words"))
    found = texts.join(mix.filter("all_copies > 0"), same)
    alone = found.filter("alike = 1").withColumn("copies", F.col("all_copies"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text", "lang"), "text", "lang"))
    others = found.filter("alike > 1").withColumn("number", number)
    others = others.withColumn("copies", F.expr("all_copies div alike + IF(number <= all_copies % alike, 1, 0)")).drop("number")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return alone.unionByName(others).filter("copies > 0").select("doc_id", "lang", "text", "source", "size", "source_size", "target", "copies", taken)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each_group),
    ("benchmark decontamination", no_benchmark),
    ("private data", no_private_data),
    ("mixing sources", mixed),
]

#: Learned scores, hashes and draws aren't SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_folder(spark, "corpus")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
