"""Queries over the given tables, one per operator; each returns its whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk.llm import (
    decontaminate,
    fill_in_middle,
    filter_audit,
    fingerprint,
    forest,
    html_blocks,
    language,
    mixing,
    near_dup,
    quality,
    substring_dedup,
    tool_calls,
    toxicity,
)
from docrisk.llm.oracles import ORACLES


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.digest(quality.score(docs, quality.learn(docs, read(spark, sf_dir, "labels"))))


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_blocks.digest(html_blocks.extract(pages, html_blocks.learn(pages)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(read(spark, sf_dir, "documents")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.digest(language.predict(docs, language.learn(docs)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels"))))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.turns(read(spark, sf_dir, "conversations"))
    linked = tool_calls.link(calls, results, tool_calls.TURN_TOOLS)
    return linked.withColumn("violations", F.array_join("violations", "; "))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(read(spark, sf_dir, "documents")))


def op10_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(fingerprint.edited(read(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.transform(read(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


__all__ = ["ORACLES", "QUERIES", "read"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_dup,
        op2_decontaminate,
        op3_quality,
        op4_html_blocks,
        op5_mixing,
        op6_language,
        op7_toxicity,
        op8_tool_calls,
        op9_substring_dedup,
        op10_forest,
        op11_fingerprint,
        op12_fill_in_middle,
        op13_filter_audit,
    )
}
