"""Lines that cannot be read are kept, not lost: one ledger of rejects for all sources.

Readers parse line by line. A line that is no JSON, or whose values do not fit the schema, comes out with
its text in ``CORRUPT`` and whatever of it could be read; ``accepted`` and ``rejected`` part a source into
rows and ledger entries, so that what was read is what was accepted plus what was rejected. ``counted``
has Spark count both while the rows go by.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrisk import dims
from docrisk.functions.jsontext import whole_json

#: The text of a line that could not be read; NULL in rows that could.
CORRUPT = "_corrupt"


def read_lines(spark: SparkSession, schema: T.StructType, path: str, stream: bool = False, max_bytes: int | None = None) -> DataFrame:
    """JSON lines as ``schema`` and ``CORRUPT``. A stream takes ``max_bytes`` of files a batch at most
    (one file at least).

    A line that cannot be read has no values. That is one that is no JSON object, one with a value that does
    not fit the schema, and, as in the strict reading of JSON, one with text behind the object: each is
    read as the only element of an array, which such text breaks. Blank lines are none.
    """
    reader = spark.readStream if stream else spark.read
    if stream and max_bytes:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes))
    lines = reader.text(path).where(F.trim("value") != "")
    wrapped = T.StructType([T.StructField("r", T.ArrayType(schema)), T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(
        F.concat(F.lit('{"r":['), F.col("value"), F.lit("]}")), wrapped, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    read = lines.select("value", parsed.alias("j"))
    row = F.get("j.r", F.lit(0))
    ok = F.col(f"j.{CORRUPT}").isNull() & (F.size("j.r") == 1) & row.isNotNull()
    held = read.select("value", F.when(ok, row).alias("row"))
    return held.select("row.*", F.when(F.col("row").isNull(), F.col("value")).alias(CORRUPT))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Lines {"address": .., "record": {..}} as address, v (a variant) and ``CORRUPT``.

    As in the strict reading of JSON, text behind the value makes a line unreadable; so does a missing
    address or record.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", whole_json(F.col("value")).alias("j"))
    fields = lines.select(
        "value", F.try_variant_get("j", "$.address", "string").alias("address"), F.try_variant_get("j", "$.record", "variant").alias("v")
    )
    ok = F.col("address").isNotNull() & F.col("v").isNotNull()
    return fields.select(F.when(ok, F.col("address")).alias("address"), F.when(ok, F.col("v")).alias("v"), F.when(~ok, F.col("value")).alias(CORRUPT))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected(df: DataFrame, source: str, error: str | Column = dims.UNREADABLE) -> DataFrame:
    """The ledger entries of a source."""
    why = error if isinstance(error, Column) else F.lit(error)
    return df.where(F.col(CORRUPT).isNotNull()).select(F.lit(source).alias("source"), F.col(CORRUPT).alias("record"), why.alias("error"))


def counted(df: DataFrame, observation: Observation | str) -> DataFrame:
    """The same rows; ``n_read``, ``n_accepted`` and ``n_rejected`` are counted as they are read."""
    bad = F.col(CORRUPT).isNotNull()
    return df.observe(
        observation, F.count(F.lit(1)).alias("n_read"), F.count_if(~bad).alias("n_accepted"), F.count_if(bad).alias("n_rejected")
    )


@dataclass
class Intake:
    """A source that was read once: its rows, its ledger entries and how many lines there were."""

    rows: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def take_in(lines: DataFrame, source: str, folder: str) -> Intake:
    """Read a source once, into ``folder``, and count its lines on the way.

    Rows and entries are taken from what was written, so they are of the same reading as the counts.
    """
    seen = Observation(f"lines of {source}")
    counted(lines, seen).write.parquet(folder)
    written = lines.sparkSession.read.schema(lines.schema).parquet(folder)
    return Intake(accepted(written), rejected(written, source), seen.get)
