"""Chat updates as table or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk import schemas
from docrisk.sources.ledger import read_lines


def read_updates(spark: SparkSession, path: str, stream: bool = False, fmt: str = "json") -> DataFrame:
    """Updates in the envelope schema; ``stream`` reads files as they arrive."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.UPDATES).format(fmt).load(path)


def read_update_lines(spark: SparkSession, path: str, stream: bool = False, max_bytes: int | None = None) -> DataFrame:
    """JSON lines of updates; those that cannot be read have their text in ``CORRUPT`` and nothing else.

    A stream takes ``max_bytes`` of files a batch at most.
    """
    return read_lines(spark, schemas.UPDATES, path, stream, max_bytes)


def chat_of_line(line: Column) -> Column:
    """The chat that an unreadable update came from, where that much can be read."""
    j = F.try_parse_json(line)
    return F.coalesce(
        F.try_variant_get(j, "$.message.chat.id", "bigint"), F.try_variant_get(j, "$.callback_query.message.chat.id", "bigint")
    )
