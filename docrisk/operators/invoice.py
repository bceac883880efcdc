"""Invoice arithmetic and amount notation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.functions.amounts import amount_style
from docrisk.functions.values import is_true

ADDED = ["subtotal", "vat", "other_tax", "fee", "commission"]
SUBTRACTED = ["discount"]


def reconcile_invoice(lines: DataFrame, key: str = "doc_id", tolerance: float = 0.01) -> DataFrame:
    """Compare the total a document shows with the total its parts give.

    ``lines`` holds (key, kind, amount). Parts of one kind add up. Without a subtotal or a shown
    total, or with any amount unreadable (NULL), nothing is calculated and ``consistent`` is
    false. One pass of partial sums per document: a document with very many lines stays cheap.
    """
    kind, amount = F.col("kind"), F.col("amount")
    signed = F.when(kind.isin(ADDED), amount).when(kind.isin(SUBTRACTED), -amount)
    sums = lines.groupBy(key).agg(
        F.sum(signed).alias("_calculated"),
        F.sum(F.when(kind == "subtotal", amount)).alias("subtotal"),
        F.sum(F.when(kind.isin("vat", "other_tax"), amount)).alias("tax"),
        F.sum(F.when(kind == "shown_total", amount)).alias("shown"),
        F.max(amount.isNull()).alias("_unreadable"),
    )
    enough = F.col("subtotal").isNotNull() & F.col("shown").isNotNull() & ~F.col("_unreadable")
    return (
        sums.withColumn("calculated", F.when(enough, F.col("_calculated")))
        .withColumn("difference", F.col("calculated") - F.col("shown"))
        .withColumn("consistent", is_true(F.abs(F.col("difference")) <= F.lit(tolerance).cast("decimal(18,2)")))
        .select(key, "subtotal", "tax", "calculated", "shown", "difference", "consistent")
    )


def amount_analysis(reconciled: DataFrame) -> DataFrame:
    """The reconciliation in the shape the risk engine's bonus takes, as column ``amount``."""
    return reconciled.withColumn(
        "amount",
        F.struct(
            (~F.col("consistent")).alias("inconsistent"),
            F.col("calculated").isNotNull().alias("calculated_given"),
            F.col("shown").isNotNull().alias("total_given"),
            F.col("difference").cast("double").alias("difference"),
            F.lit(None).cast("string").alias("evidence"),
        ),
    )


def amount_format_mix(df: DataFrame, key: str = "doc_id", amount: str = "amount") -> DataFrame:
    """How many amount notations one document mixes; plain numbers fit any of them."""
    style = amount_style(F.col(amount))
    seen = [F.coalesce(F.max(style == s), F.lit(False)).cast("int") for s in ("comma", "dot", "other")]
    return df.groupBy(key).agg(sum(seen[1:], seen[0]).alias("n_styles")).withColumn(
        "mixed", F.col("n_styles") > 1
    )
