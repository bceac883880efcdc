"""Result tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docrisk.sources.commits import commit, committed, latest_parts, new_attempt


def split_rejects(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(successful rows, error rows) of a result table."""
    ok = F.col("success")
    return results.filter(ok).drop("error"), results.filter(~ok).select(
        *[c for c in ("doc_id", "address", "update_id") if c in results.columns], "success", "error"
    )


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Screening results, partitioned by document type so that later reads prune."""
    good, bad = split_rejects(results)
    good.write.mode(mode).partitionBy("type").parquet(f"{path}/results")
    write_rejects(bad, path, mode)


def write_chain_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Token and wallet results, partitioned by address type."""
    good, bad = split_rejects(results)
    good.write.mode(mode).partitionBy("address_type").parquet(f"{path}/results")
    write_rejects(bad, path, mode)


def write_rejects(rejects: DataFrame, path: str, mode: str = "overwrite") -> None:
    rejects.write.mode(mode).parquet(f"{path}/rejects")


def publish(results: DataFrame, path: str, part: str = "type") -> int:
    """Replace the results and rejects of the types that ``results`` holds, by one switch.

    Rows of other types stay as they were, and readers see the old rows of all these types or the new ones,
    results and rejects alike; a run that dies in between changes nothing. ``part`` is a column of few values
    (document or address types); rows without one are a part of their own. Returns the edition's number.
    """
    spark = results.sparkSession
    here = results.withColumn(part, F.coalesce(part, F.lit("")))
    attempt = new_attempt()
    last = committed(spark, path).agg(F.max("batch")).first()[0]
    edition = 0 if last is None else last + 1
    good, bad = here.filter("success").drop("error"), here.filter(~F.col("success"))
    keys = [c for c in ("doc_id", "address", "update_id") if c in here.columns]
    for name, rows in (("results", good), ("rejects", bad.select(*keys, part, "success", "error"))):
        rows.write.partitionBy(part).parquet(f"{path}/{name}/run=all/batch={edition}/attempt={attempt}")
    parts = [r[0] for r in here.select(part).distinct().collect()]
    commit(spark, path, "all", edition, attempt, ["results", "rejects"], parts)
    return edition


def read_published(spark: SparkSession, path: str, table: str, schema: T.StructType, part: str = "type") -> DataFrame:
    """``results`` or ``rejects`` (``schema``) as they stand: of each type its last edition."""
    latest = latest_parts(committed(spark, path))
    whole = T.StructType([*schema.fields, *[T.StructField(k, T.StringType()) for k in ("run", "batch", "attempt")]])
    rows = spark.read.option("basePath", f"{path}/{table}").schema(whole).parquet(f"{path}/{table}")
    # a type of its own partition: only the folders that are read are opened
    kind = F.coalesce(F.col(part), F.lit(""))
    named = rows.withColumns({"batch": F.col("batch").cast("bigint"), "_part": kind})
    kept = named.join(latest.withColumnRenamed("part", "_part"), ["run", "batch", "attempt", "_part"], "left_semi")
    return kept.select(*[F.when(kind != "", F.col(part)).alias(part) if c == part else F.col(c) for c in schema.fieldNames()])


def write_batch(df: DataFrame, path: str, batch_id: int, run: str) -> None:
    """One micro-batch into its own folder: repeating a batch after a failure replaces it.

    ``run`` tells streams apart, whose batches all begin at 0.
    """
    df.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint for as long as that exists."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def write_outbox(messages: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Stream outgoing messages (update_id, chat_id, text, reply_to_message_id) into the outbox."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id, run_id(batch.sparkSession, checkpoint))

    return (
        messages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
