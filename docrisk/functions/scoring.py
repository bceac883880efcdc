"""Risk bands and rule scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrisk import dims
from docrisk.functions.values import is_true


def risk_label(score: Column) -> Column:
    """LOW up to 20, MODERATE up to 45, HIGH up to 70, VERY HIGH above."""
    low, moderate, high, very_high = dims.RISK_LABELS
    return (
        F.when(score <= 20, low).when(score <= 45, moderate).when(score <= 70, high).otherwise(very_high)
    )


def severity(score: Column) -> Column:
    """Display level 0..3 over the same bands."""
    return F.when(score >= 71, 3).when(score >= 46, 2).when(score >= 21, 1).otherwise(0)


def suspicious(score: Column) -> Column:
    return is_true(score >= dims.SUSPICIOUS_FROM)


@dataclass(frozen=True)
class Rule:
    """One scored rule: when ``condition`` holds it adds ``points`` and reports a warning."""

    code: str
    points: int
    condition: Column
    message: Column


def rule_score(rules: list[Rule], cap: int = 100) -> Column:
    total = sum((F.when(r.condition, r.points).otherwise(0) for r in rules), F.lit(0))
    return F.least(F.lit(cap), total).cast("int")


def rule_codes(rules: list[Rule]) -> Column:
    """Codes of the rules that hold, in rule order."""
    return F.array_compact(F.array(*[F.when(r.condition, F.lit(r.code)) for r in rules]))


def rule_messages(rules: list[Rule]) -> Column:
    """Warning texts of the rules that hold, in rule order."""
    return F.array_compact(F.array(*[F.when(r.condition, r.message) for r in rules]))
