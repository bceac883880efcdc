"""Mixing sources to target weights by subset sums.

A source's target is met in whole documents. Where it exceeds the source's size, every document is
taken once and the rest is filled. To fill a budget exactly, documents are counted by exact length;
of each length a share of documents close to the budget's share of the source is taken, and
bounded-knapsack dynamic programming over the lengths chooses the rest, so that the words taken come
as near to the budget as whole documents allow. Which documents of a length are taken is decided by
a seeded hash.

The tables that meet in one task hold one row for each source, or for each different length of one
source; lengths that differ are at most the square root of twice a source's words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrisk.llm.scratch import cut

#: Sources in the order of their names weigh these, again and again.
WEIGHTS = (3, 1, 2)
#: The mix takes this share of all words, and of no source more than CAP times its words.
SHARE, CAP = 1.5, 2.0
#: A length's documents are told apart by this many buckets of their hash.
SLOTS = 1 << 16


def targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of ``source`` and ``source_size``.

    Weighted shares of the whole budget; what a source cannot take is shared again by weight among
    the others. In the end every target is the smaller of its cap and one level times its weight;
    the level is found by adding up sources in the order of cap by weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    sized = sizes.withColumn("weight", weight).withColumn("cap", F.lit(CAP) * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        sized.withColumn("budget", F.lit(SHARE) * F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("rest"))
        # levels only fall once a source is not filled: the highest such level holds for all after it
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_size", target.alias("target"))


def chosen_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 1 << 16) -> np.ndarray:
    """How many documents of each length make up ``budget`` words, or as near below as can be.

    All lengths, in order, give their common share, rounded so that no fraction of a document is
    lost on the way; it stays about half a ``window`` of words below the budget. Bounded subset
    sums, kept as bit sets, settle what is missing from the documents left. Where single documents
    are longer than that, whole ones are put back or added first, longest before others.
    """
    size = int((lengths * counts).sum())
    if budget >= size or not len(lengths):
        return counts.copy()
    share = max(budget - window // 2, 0) / size
    taken = np.diff(np.floor(np.concatenate([[0], np.cumsum(counts * share)]))).astype(np.int64)
    missing = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        if missing < 0:
            more = -min(int(taken[i]), -(missing // length))
        else:
            more = min(int(counts[i] - taken[i]), max(missing - window, 0) // max(length, 1))
        taken[i] += more
        missing -= more * length
    # bit s of reach: s words can be made of what came so far, longest first
    bound = (1 << (missing + 1)) - 1
    reach, steps = 1, []
    for i in np.argsort(-lengths, kind="stable"):
        left, length, part = int(counts[i] - taken[i]), int(lengths[i]), 1
        left = min(left, missing // length) if length else 0
        while left > 0 and not reach >> missing & 1:
            n = min(part, left)
            steps.append((i, n, reach))
            reach |= (reach << (n * length)) & bound
            left -= n
            part *= 2
    s = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> s & 1:
            taken[i] += n
            s -= n * int(lengths[i])
    return taken


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """One source's lengths with how many documents of each are taken, ``base`` times all and ``n`` once more."""
    rows = rows.sort_values("size", ignore_index=True)
    lengths, counts = rows["size"].to_numpy(np.int64), rows["docs"].to_numpy(np.int64)
    target, size = round(float(rows["target"].iloc[0])), int((lengths * counts).sum())
    base = min(target // size, int(CAP)) if size else 0
    n = chosen_counts(lengths, counts, target - base * size) if base < CAP else np.zeros(len(rows), np.int64)
    return rows.assign(base=base, n=n)


def mix(docs: DataFrame, *, seed: int = 5) -> DataFrame:
    """How many words of every document the mix takes.

    One row per given row: ``document`` (a struct of all given columns), ``size`` (words of the
    text), ``source_size`` and ``target`` (of its source), ``copies`` (how often the document is
    taken) and ``taken`` (``copies`` times ``size``). Words are longest runs of other code points
    than U+0020 and U+0009 to U+000D. Null and empty texts have size 0 and are not taken. Null is a
    source like any other, the last. Of rows that agree in ``doc_id`` and size, any may be taken.
    An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    source = F.col("source").cast("string")
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
        source.alias("source"),
        # a source as part of a join's key: never null
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        size.alias("size"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(SLOTS)).alias("slot"),
    )
    cells = cut(sized.groupBy("source", "key", "size", "slot").agg(F.count("*").alias("docs")))
    lengths = cells.groupBy("source", "key", "size").agg(F.sum("docs").alias("docs"))
    sources = lengths.groupBy("source").agg(F.sum(F.col("docs") * F.col("size")).alias("source_size"))
    budgets = targets(sources).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    plan = (
        lengths.drop("source").join(budgets, "key")
        .groupBy("key")
        .applyInPandas(_fill, "key string, size long, docs long, source_size long, target double, base long, n long")
        .drop("docs")
    )
    before = Window.partitionBy("key", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    quotas = (
        cells.drop("source").withColumn("before", F.coalesce(F.sum("docs").over(before), F.lit(0)))
        .join(plan, ["key", "size"])
        .withColumn("quota", F.greatest(F.lit(0), F.least("docs", F.col("n") - F.col("before"))))
        .select("key", "size", "slot", "source_size", "target", "base", "quota")
    )
    place = Window.partitionBy("key", "size", "slot").orderBy(F.col("document.doc_id"))
    copies = F.when(F.col("size") > 0, F.col("base") + (F.col("place") <= F.col("quota")).cast("long")).otherwise(F.lit(0)).cast("long")
    return (
        sized.join(quotas, ["key", "size", "slot"])
        .withColumn("place", F.row_number().over(place))
        .select("document", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    )


def digest(mixed: DataFrame) -> DataFrame:
    """The contract's columns of ``mix``."""
    return mixed.select(F.col("document.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")
