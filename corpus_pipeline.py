"""Corpus pipeline: filter, deduplicate, mix and pack `documents`.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; it is written as Parquet below
spark.checkpoint.dir and read again.  All stages but the last return the columns of documents: toxic texts go, one
document of each near-duplicate class stays, passages that also stand earlier are cut from the texts, and rows of
small sources are repeated until the mixture has its target weights.  The last gives the place of every piece of
text in its packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsframe.llm import mixing, packing, simhash, suffixes, toxicity
from oddsframe.llm.shared import documents, keep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.cleaned(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, max_repeats=2.0, seed=7)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_neardup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("temperature_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None  # the classifier and the fingerprints have no SQL form; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
