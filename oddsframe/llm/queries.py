"""Registered queries of the corpus operators over the driver tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oddsframe.llm import alignment, htmltext, langid, merkle, mixing, packing, search, sharding, simhash, suffixes, toxicity, twins, urlfilter, winnowing
from oddsframe.llm.shared import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("allow", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op3_sharding", twins.sharding(16, 42))
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), shards=16, seed=42)


@query("op1_temperature_mixing", twins.mixing(max_repeats=2.0, block_tokens=100_000, seed=7))
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir), max_repeats=2.0, block_tokens=100_000, seed=7)


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query("op5_simhash_neardup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op9_suffix_array_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(documents(spark, sf_dir))


@query("op4_winnowing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(documents(spark, sf_dir))


@query("op2_rank_order_langid")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


@query("op10_subsequence_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op7_block_max_search", twins.search(k=10, every=100))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return search.search(docs, docs.where("doc_id % 100 = 0"), k=10)


@query("op8_html_layout_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.pages_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op11_url_reputation", twins.url_filter(URL_RULES, urlfilter.LIMIT, urlfilter.Z))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in ("pages", "labels"))
    return urlfilter.judge(pages, urlfilter.page_outcomes(pages, labels), URL_RULES)


@query("op12_merkle_manifest", twins.merkle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(documents(spark, sf_dir))


@query("op13_interval_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(documents(spark, sf_dir))
