"""The chat stream end to end: updates in, screening requests and messages out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docrisk import dims, schemas
from docrisk.operators.report import render_report
from docrisk.operators.updates import error_messages, outgoing_messages, route_updates, screening_requests
from docrisk.sources.commits import commit, committed, is_committed, new_attempt, read_committed, write_part, write_tables
from docrisk.sources.folders import remove
from docrisk.sources.ledger import CORRUPT
from docrisk.sources.sinks import run_id
from docrisk.sources.updates import chat_of_line
from docrisk.streaming.dedup import dedup_updates
from docrisk.streaming.isolate import write_apart

Step = Callable[[DataFrame], DataFrame]
TABLES = {"requests": schemas.REQUESTS, "outbox": schemas.MESSAGES, "rejects": schemas.LEDGER, "duplicates": schemas.DUPLICATES}
_ANSWERS = schemas.struct(request=schemas.REQUESTS, message=schemas.MESSAGES)


def _routed(step: Step | None) -> Step:
    """Updates with their route and ``error``."""

    def route(updates: DataFrame) -> DataFrame:
        routed = route_updates(updates)
        routed = step(routed) if step else routed
        return routed if "error" in routed.columns else routed.withColumn("error", F.lit(None).cast("string"))

    return route


def _answers(routed: DataFrame) -> DataFrame:
    """What routed updates lead to, as one table of ``request`` or ``message``."""
    requests, messages = screening_requests(routed), outgoing_messages(routed)
    request, message = (F.struct(*df.columns).cast(_ANSWERS[n].dataType).alias(n) for n, df in (("request", requests), ("message", messages)))
    none = {n: F.lit(None).cast(_ANSWERS[n].dataType).alias(n) for n in _ANSWERS.fieldNames()}
    return requests.select(request, none["message"]).unionByName(messages.select(none["request"], message))


def run_chat(
    updates: DataFrame, path: str, checkpoint: str, horizon: str = dims.DEDUP_HORIZON, step: Step | None = None, exact: bool = False,
    clock: Column | None = None, **trigger,
) -> StreamingQuery:
    """Deduplicate, route and answer a stream of updates.

    Each micro-batch becomes the committed tables ``requests``, ``outbox``, ``rejects`` and ``duplicates``
    under ``path`` (see ``read_chat``), all at once; a batch that is repeated after a lost driver writes
    nothing a second time. ``duplicates`` is filled where ``exact`` (see ``dedup_updates``, also for ``clock``).

    An update that cannot be processed stops no other: its chat gets an error message and the ledger an
    entry. That holds for lines that cannot be read (``read_update_lines``), for rows to which ``step`` gives
    an ``error``, and for rows at which an expression raises (``write_apart``). ``step`` works on routed updates
    row by row, before requests and messages are made of them.
    """
    keyed = dedup_updates(updates, horizon, exact, clock)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = run_id(spark, checkpoint)
        if is_committed(spark, path, run, batch_id):
            # its rows are there, but Spark repeats the batch because it lacks the state behind it
            batch.write.format("noop").mode("overwrite").save()
            return
        attempt = new_attempt()
        work = f"{path}/_work/run={run}/batch={batch_id}"
        # one evaluation of the source and the state; everything else reads this
        batch.write.parquet(f"{work}/{attempt}/in")
        rows = spark.read.schema(batch.schema).parquet(f"{work}/{attempt}/in")
        repeat = F.col("duplicate") if exact else F.lit(False)
        line = F.col(CORRUPT) if CORRUPT in rows.columns else F.lit(None).cast("string")
        readable = rows.where(~repeat & line.isNull()).drop("duplicate", CORRUPT)
        route = _routed(step)
        first = write_apart(readable, route, f"{work}/{attempt}/routed")
        routed = first.rows(spark, route(readable.limit(0)).schema)
        second = write_apart(routed.where("error is null").drop("error"), _answers, f"{work}/{attempt}/answers")
        answers = second.rows(spark, _ANSWERS)
        unread = rows.where(line.isNotNull()).select(
            "update_id", chat_of_line(line).alias("chat_id"), F.lit(dims.UNREADABLE).alias("error"), line.alias("record")
        )
        record = F.to_json(F.struct(*readable.columns)).alias("record")
        failures = unread
        for failed in (routed.where("error is not null"), first.failed, second.failed):
            failures = failures.unionByName(failed.select("update_id", _chat().alias("chat_id"), "error", record))
        tables = {
            "requests": answers.where("request is not null").select("request.*"),
            "outbox": answers.where("message is not null").select("message.*").unionByName(error_messages(failures)),
            "rejects": failures.select(F.lit("updates").alias("source"), "record", "error"),
            "duplicates": rows.where(repeat).select("update_id"),
        }
        for name, table in tables.items():
            write_part(table, path, name, run, batch_id, attempt)
        commit(spark, path, run, batch_id, attempt, list(tables))
        remove(spark, work)

    return (
        keyed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _chat() -> Column:
    """The chat of an update that could not be processed: the message's, else the callback's."""
    given = lambda c: F.when(c != 0, c)
    return F.coalesce(given(F.col("message.chat.id")), given(F.col("callback_query.message.chat.id")))


def read_chat(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What ``run_chat`` and ``run_reports`` have committed: ``requests``, ``outbox``, ``rejects`` and
    ``duplicates``, all of the same batches."""
    commits = committed(spark, path)
    return {name: read_committed(spark, path, name, schema, commits) for name, schema in TABLES.items()}


def report_messages(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Result reports for the chats that asked: update_id, chat_id, text, reply_to_message_id."""
    answered = requests.select("doc_id", "update_id", "chat_id", "reply_to").join(results, "doc_id")
    report = render_report(answered)
    failed = F.concat(
        F.lit("Analiz sırasında hata oluştu.\n\nHata:\n"),
        F.coalesce(F.col("error"), F.lit(dims.UNKNOWN_ERROR)),
    )
    return report.select(
        "update_id", "chat_id", F.when(F.col("success"), F.col("text")).otherwise(failed).alias("text"),
        F.col("reply_to").alias("reply_to_message_id"),
    )


def run_reports(results: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Send a stream of screening results (doc_id and what ``render_report`` reads, success, error) to the
    chats whose committed requests they answer: into the same outbox, each batch once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_tables({"outbox": report_messages(read_chat(spark, path)["requests"], batch)}, path, run_id(spark, checkpoint), batch_id)

    return (
        results.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
