"""Result report and comparison block as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk import dims
from docrisk.functions.banks import bank_display
from docrisk.functions.scoring import severity
from docrisk.functions.values import first_text, non_empty
from docrisk.operators.claims import comparison_summary


def plain_number(value: Column) -> Column:
    """A number as people write it: no decimals when it is whole."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def comparison_text(state: Column, warnings: Column, mismatch_fields: Column) -> Column:
    """The comparison block appended to a summary; empty when nothing was claimed."""
    head = f"\n\n{dims.RULE_LINE}\n{dims.CLAIM_TITLE}\n\n"
    foot = f"\n\n{dims.CLAIM_NOTE}"
    verdict = F.when(state == "mismatch", dims.CLAIM_MISMATCH).otherwise(F.lit(dims.CLAIM_UNVERIFIED))
    notes = F.when(
        F.size(warnings) > 0,
        F.concat(F.lit("\n\n"), F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("• "), w)), "\n")),
    ).otherwise(F.lit(""))
    fields = F.array_join(
        F.transform(mismatch_fields, lambda f: F.concat(F.lit("\n• "), f, F.lit(f": {dims.FIELD_MISMATCH}"))), ""
    )
    return (
        F.when(state == "none", "")
        .when(state == "consistent", head + dims.CLAIM_CONSISTENT + foot)
        .otherwise(F.concat(F.lit(head), verdict, notes, F.coalesce(fields, F.lit("")), F.lit(foot)))
    )


def render_report(df: DataFrame) -> DataFrame:
    """Add ``text`` and ``severity`` to results.

    Reads type, score, risk_label, confidence, summary, bank and, when there, comparison.
    """
    if "comparison" in df.columns:
        df = comparison_summary(df)
        block = comparison_text(F.col("state"), F.col("comparison.warnings"), F.col("mismatch_fields"))
    else:
        block = F.lit("")
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    statement = F.col("type") == "statement"
    title = F.when(statement, dims.REPORT_TITLES["statement"]).otherwise(F.lit(dims.REPORT_TITLES["receipt"]))
    bank = non_empty(F.col("bank"))
    bank_line = F.when(~statement & bank.isNotNull(), F.concat(F.lit("Banka: "), bank_display(bank), F.lit("\n")))
    text = F.concat(
        title,
        F.lit("\n\n"),
        F.coalesce(bank_line, F.lit("")),
        F.lit("Risk Skoru: "),
        plain_number(score),
        F.lit("/100\n\nRisk Seviyesi:\n"),
        first_text(F.col("risk_label"), F.lit("UNKNOWN")),
        F.lit("\n\nGüven:\n"),
        plain_number(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))),
        F.lit(f"/100\n\n{dims.RULE_LINE}\n\n"),
        first_text(F.col("summary"), F.lit(dims.SUMMARY_DEFAULT)),
        F.coalesce(block, F.lit("")),
        F.lit(f"\n\n{dims.RULE_LINE}\n\n{dims.REPORT_NOTE}"),
    )
    return df.withColumns({"text": text, "severity": severity(score)})
