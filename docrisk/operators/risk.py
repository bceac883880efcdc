"""The weighted risk engine.

Scores are folded in a fixed order as one expression per category, so the result does not
depend on how rows were shuffled: scoring is a narrow projection without any exchange.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk import dims
from docrisk.functions.scoring import risk_label, suspicious
from docrisk.functions.values import clamp, half_up, is_finite, is_true


_MAX = f"{sys.float_info.max}D"


def _usable(check: str) -> str:
    """SQL: the clamped score of a check; NULL when it is missing, unknown or no number.

    The range test also leaves out NaN, which sorts above every number.
    """
    score = f"CAST({check}.score AS DOUBLE)"
    return (
        f"CASE WHEN NOT ({check}.status <=> 'unknown') AND {score} BETWEEN -{_MAX} AND {_MAX} "
        f"THEN greatest(0D, least(100D, {score})) END"
    )


def _mean(weights: dict[str, float]) -> str:
    """SQL: the weighted mean over the usable scores, summed left to right; 0 without any.

    A score that is not usable enters both sums as zero, so the fold is plain arithmetic.
    """
    total = weight = "0D"
    for name, w in weights.items():
        score = f"_usable[{dims.CHECK_NAMES.index(name)}]"
        total += f" + coalesce({score}, 0D) * {w}D"
        weight += f" + CASE WHEN {score} IS NOT NULL THEN {w}D ELSE 0D END"
    # without any usable score both sums are 0, and so is the quotient
    return f"CAST(round(({total}) / greatest({weight}, 0.1D)) AS INT)"


def category_risks(df: DataFrame, checks: str = "checks") -> DataFrame:
    """Add ``categories``, the five category risks, from a struct of checks."""
    usable = ", ".join(_usable(f"`{checks}`.{n}") for n in dims.CHECK_NAMES)
    means = ", ".join(f"{_mean(w)} AS {c}" for c, w in dims.CHECK_WEIGHTS.items())
    return (
        df.withColumn("_usable", F.expr(f"array({usable})"))
        .withColumn("categories", F.expr(f"struct({means})"))
        .drop("_usable")
    )


def arithmetic_bonus(amount: Column) -> Column:
    """Extra points when a document's own arithmetic is given and does not add up."""
    difference = amount["difference"]
    off = is_finite(difference) & (F.abs(difference) > dims.AMOUNT_TOLERANCE)
    hit = amount["inconsistent"] & amount["calculated_given"] & amount["total_given"] & off
    return F.when(hit, F.lit(dims.ARITHMETIC_BONUS)).otherwise(F.lit(0))


def overall_risk(df: DataFrame, categories: str = "categories", amount: str | None = "amount") -> DataFrame:
    """Add ``overall_risk``, ``risk_label`` and ``suspicious``."""
    total = None
    for name, weight in dims.CATEGORY_WEIGHTS.items():
        term = F.col(categories)[name] * F.lit(weight)
        total = term if total is None else total + term
    if amount:
        total = total + arithmetic_bonus(F.col(amount))
    return (
        df.withColumn("overall_risk", half_up(clamp(total)))
        .withColumn("risk_label", risk_label(F.col("overall_risk")))
        .withColumn("suspicious", suspicious(F.col("overall_risk")))
    )


def score_documents(df: DataFrame, checks: str = "checks", amount: str | None = "amount") -> DataFrame:
    return overall_risk(category_risks(df, checks), amount=amount)


def weights_table(spark) -> DataFrame:
    """The 39 check weights as a table: category, check, tenths."""
    rows = [(c, n, round(w * 10)) for c, weights in dims.CHECK_WEIGHTS.items() for n, w in weights.items()]
    return spark.createDataFrame(rows, "category string, check string, tenths int")


def category_risks_long(checks: DataFrame, weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """Category risks from long check rows (key, check, status, score) and a weight table.

    Weights are whole tenths and scores are taken to six decimals, so the sums are exact in any
    order. ``weights`` has one row per category and check. Every document has all five categories: one
    without a usable check has risk 0.
    """
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.col("score").cast("double")))
    usable = F.when(F.col("score").isNotNull() & ~is_true(F.col("status") == "unknown"), F.round(score * 1000000).cast("bigint"))
    # one row of weights a check, so that a check stays one row and all five sums come out of one aggregation
    tenths = {c: f"_{c}" for c in dims.CATEGORY_WEIGHTS}
    of_check = weights.groupBy("check").agg(*[F.sum(F.when(F.col("category") == c, F.col("tenths"))).alias(w) for c, w in tenths.items()])
    scored = checks.select(key, "check", usable.alias("_s")).join(of_check, "check", "left")
    sums = scored.groupBy(key).agg(
        *[F.coalesce(F.sum(F.col("_s") * F.col(w)), F.lit(0)).alias(f"{w}_n") for w in tenths.values()],
        *[F.coalesce(F.sum(F.when(F.col("_s").isNotNull(), F.col(w))), F.lit(0)).alias(f"{w}_d") for w in tenths.values()],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"{w}_n").alias("n"), F.col(f"{w}_d").alias("d")) for c, w in tenths.items()])
    mean = F.when(F.col("r.d") == 0, F.lit(0)).otherwise(F.expr("(2 * r.n + 1000000 * r.d) div (2000000 * r.d)"))
    return sums.select(key, F.explode(rows).alias("r")).select(key, "r.category", mean.cast("int").alias("risk"))


def independent_signals(df: DataFrame, min_count: int = 2, checks: str = "checks") -> DataFrame:
    """Add the number of suspicious template checks and whether they are enough to count."""
    statuses = F.array(*[F.col(checks)[n]["status"] for n in dims.TEMPLATE_CHECKS])
    hits = F.size(F.filter(statuses, lambda s: is_true(s == "suspicious")))
    return df.withColumn("n_suspicious", hits).withColumn("counts_as_signal", F.col("n_suspicious") >= min_count)
