"""Corpus preparation: five stages over ``documents``, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet into
the shared folder and reads it again as the next one's documents. All but the last return the
columns they were given.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk.llm import decontaminate, mixing, near_dup, substring_dedup, toxicity
from docrisk.llm.queries import read
from docrisk.llm.scratch import shared_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5, by a model learned from them and the labels (7).

    Null and empty texts are not toxic and stay.
    """
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.5").select("document.*")


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest ``doc_id`` (1).

    Rows without ``doc_id``, and null texts, are in no group and stay.
    """
    return near_dup.representatives(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that also start earlier in the corpus (9).

    ``n_chars``, where given, is that of the text that is left. Documents of which nothing is left
    go; those that had no words before stay.
    """
    removed = substring_dedup.remove_repeats(docs)
    columns = []
    for c in docs.columns:
        old = F.col("document").getField(c)
        # texts that lost nothing stay as they are, and so does what was counted on them
        new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema[c].dataType)}.get(c, old)
        columns.append(F.when(F.col("n_removed") > 0, new).otherwise(old).alias(c))
    return removed.where("n_removed < n_words or n_words = 0").select(columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs (2)."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix (5): documents that are taken, with all their columns, and in ``mix`` their size, their
    source's size and target, how often they are taken and how many words that makes (in place of a
    column of that name, if there is one)."""
    mixed = mixing.mix(docs).where("copies > 0")
    columns = [F.col("document").getField(c).alias(c) for c in docs.columns if c != "mix"]
    return mixed.select(*columns, F.struct("size", "source_size", "target", "copies", "taken").alias("mix"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", keep_representatives),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
]

#: Learned models and edit distances have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The mix is returned flat: ``doc_id``, ``size``, ``source_size``,
    ``target``, ``copies`` and ``taken`` of every document in it."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs.select("doc_id", "mix.*")
