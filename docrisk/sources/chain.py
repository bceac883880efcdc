"""Landing tables of chain records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk import schemas


def read_chain(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Read ``tokens``, ``security``, ``accounts`` or ``transfers`` from JSON lines.

    Security and account files hold {"address": .., "record": {..}}; the record stays a variant
    so that JSON null and a missing key remain different. A record that is no JSON is left out,
    as a failed fetch would be.
    """
    if kind == "tokens":
        return spark.read.schema(schemas.TOKENS).json(path)
    if kind == "transfers":
        return spark.read.schema(schemas.TRANSFERS).json(path)
    if kind in ("security", "accounts"):
        whole = F.try_parse_json(F.col("value"))
        return (
            spark.read.text(path)
            .select(whole.alias("j"))
            .select(
                F.try_variant_get("j", "$.address", "string").alias("address"),
                F.try_variant_get("j", "$.record", "variant").alias("v"),
            )
            .filter(F.col("address").isNotNull() & F.col("v").isNotNull())
        )
    raise ValueError(f"unknown chain table {kind!r}")
