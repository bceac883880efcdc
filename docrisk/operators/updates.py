"""Chat updates: routing, the file of a message, screening requests and outgoing messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk import dims
from docrisk.functions.banks import bank_display
from docrisk.functions.files import document_type
from docrisk.functions.ordered import ordered_scan
from docrisk.functions.values import first_text, is_true
from docrisk.operators.claims import claim_payload, extract_claims, has_claim
from docrisk.session import shared_folder

FILE = "struct<file_id: string, file_name: string, mime_type: string, type: string>"


def message_file(message: Column) -> Column:
    """The file of a message: largest photo, else video, else a supported document, else NULL."""
    photo, video, document = message["photo"], message["video"], message["document"]
    name = first_text(document["file_name"], F.lit("telegram-document"))
    mime = first_text(document["mime_type"], F.lit("application/octet-stream"))
    kind = document_type(mime, name)

    def file(file_id: Column, file_name: Column, mime_type: Column, type_: Column) -> Column:
        return F.struct(
            file_id.alias("file_id"), file_name.alias("file_name"), mime_type.alias("mime_type"), type_.alias("type")
        ).cast(FILE)

    largest = F.get(photo, F.size(photo) - 1)["file_id"]
    return (
        F.when(
            F.size(photo) > 0,
            file(largest, F.lit("telegram-photo.jpg"), F.lit("image/jpeg"), F.lit("image")),
        )
        .when(
            video.isNotNull(),
            file(video["file_id"], F.lit("telegram-video.mp4"),
                 first_text(video["mime_type"], F.lit("video/mp4")), F.lit("video")),
        )
        .when(document.isNotNull() & kind.isNotNull(), file(document["file_id"], name, mime, kind))
    )


def _given(value: Column) -> Column:
    """An id that is there and not zero."""
    return is_true(value != 0)


def route_updates(df: DataFrame) -> DataFrame:
    """Add route, chat_id, reply_to, file, bank and text to each update.

    Routes of a callback: receipt, statement, no_original, no_file, invalid_choice,
    statement_video; of a message: welcome, help, ask_file, unsupported_file, menu; else drop.
    """
    callback, message = F.col("callback_query"), F.col("message")
    menu = callback["message"]
    original = menu["reply_to_message"]
    data = callback["data"]
    is_callback = callback.isNotNull()
    source = F.when(is_callback, original).otherwise(message)
    staged = df.withColumn("_source", source).withColumn("file", message_file(F.col("_source"))).drop("_source")
    file = F.col("file")
    picks_bank = is_true(data.startswith("bank:"))
    picks_statement = is_true(data == "mode:statement")
    callback_route = (
        F.when(~is_true(callback["id"] != "") | menu.isNull() | ~_given(menu["chat"]["id"]), "drop")
        .when(original.isNull(), "no_original")
        .when(file.isNull(), "no_file")
        .when(picks_bank, "receipt")
        .when(~picks_statement, "invalid_choice")
        .when(file["type"] == "video", "statement_video")
        .otherwise("statement")
    )
    text = message["text"]
    has_file = is_true(F.size(message["photo"]) > 0) | message["document"].isNotNull() | message["video"].isNotNull()
    message_route = (
        F.when(~_given(message["chat"]["id"]), "drop")
        .when(is_true(text.startswith("/start")), "welcome")
        .when(is_true(text.startswith("/")), "help")
        .when(~has_file, "ask_file")
        .when(file.isNull(), "unsupported_file")
        .otherwise("menu")
    )
    route = F.when(is_callback, callback_route).when(message.isNotNull(), message_route).otherwise("drop")
    return staged.withColumns(
        {
            "route": route,
            "chat_id": F.when(is_callback, menu["chat"]["id"]).otherwise(message["chat"]["id"]),
            "reply_to": F.when(is_callback, original["message_id"]).otherwise(message["message_id"]),
            "bank": F.when(is_callback & picks_bank, F.substring(data, len("bank:") + 1, 2**31 - 1)),
            "text": F.when(
                is_callback, F.coalesce(first_text(original["caption"], original["text"]), F.lit(""))
            ).otherwise(F.coalesce(first_text(message["text"], message["caption"]), F.lit(""))),
        }
    )


def screening_requests(routed: DataFrame) -> DataFrame:
    """The documents to screen: manifest fields plus the claim read from the caption."""
    wanted = extract_claims(routed.filter(F.col("route").isin("receipt", "statement")), "text")
    statement = F.col("route") == "statement"
    return wanted.select(
        F.col("update_id").cast("string").alias("doc_id"),
        "update_id", "chat_id", "reply_to",
        F.when(statement, "statement").otherwise(F.col("file.type")).alias("type"),
        F.col("file.file_id").alias("file_id"),
        F.col("file.file_name").alias("file_name"),
        F.col("file.mime_type").alias("mime"),
        F.when(~statement, F.col("bank")).alias("bank"),
        F.when(statement, "true").alias("statement_mode"),
        "claim",
        F.when(has_claim(F.col("claim")), claim_payload(F.col("claim"))).alias("provided_info"),
    )


def outgoing_messages(routed: DataFrame) -> DataFrame:
    """What is sent back at once: update_id, chat_id, text, reply_to_message_id."""
    text = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, message in dims.ROUTE_MESSAGES.items():
        text = text.when(F.col("route") == name, message)
    chosen = F.when(F.col("route") == "statement", "Hesap özeti").otherwise(bank_display(F.col("bank")))
    started = F.concat(chosen, F.lit(" seçildi.\n\n"), F.col("file.file_name"))
    text = text.when(F.col("route").isin("receipt", "statement"), started)
    # these answers stand alone; all others reply to the document's message
    alone = F.col("route").isin("no_original", "no_file", "invalid_choice", "welcome", "help", "ask_file", "unsupported_file")
    return routed.filter(F.col("route") != "drop").select(
        "update_id", "chat_id", text.alias("text"), F.when(~alone, F.col("reply_to")).alias("reply_to_message_id")
    )


def error_messages(failed: DataFrame) -> DataFrame:
    """Error rows (update_id, chat_id, error) as outgoing messages; without a chat nothing is sent."""
    note = F.concat(
        F.lit(dims.PROCESS_ERROR + "\n\n"), first_text(F.col("error"), F.lit(dims.UNKNOWN_ERROR))
    )
    return failed.filter(_given(F.col("chat_id"))).select(
        "update_id", "chat_id", note.alias("text"), F.lit(None).cast("bigint").alias("reply_to_message_id")
    )


def _cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def _kept(moments: DataFrame, horizon: str) -> DataFrame:
    """``_id``, ``event_time``, ``n_copies`` of the kept deliveries of ``moments`` (the same columns, the two
    first unique and never NULL).

    Times of an id are numbered from the latest, and each points to the first one beyond its horizon. A time
    whose predecessor points to it is kept whatever came before; so are an id's first time and, in between,
    the times reached from these. Pointers are doubled, so a chain of n kept times takes log2(n) rounds.
    """
    time = F.unix_micros("event_time")
    limit = F.unix_micros(F.col("event_time") + F.expr(f"interval {horizon}"))
    # from the latest to the earliest, a limit stands before the time it equals: that one is no later
    marks = moments.select("_id", "event_time", "n_copies", (1 - 2 * time).alias("_o"), F.lit(1).alias("_c")).unionByName(
        moments.select("_id", "event_time", F.lit(None).cast("bigint").alias("n_copies"), (-2 * limit).alias("_o"), F.lit(0).alias("_c"))
    )
    at, is_time = F.col("_r"), F.col("_c") == 1
    numbered = _cut(
        ordered_scan(marks, "_id", "_o", sums={"_r": F.col("_c")}).groupBy("_id", "event_time").agg(
            F.max("n_copies").alias("n_copies"), F.max(F.when(is_time, at)).alias("_at"),
            F.coalesce(F.max(F.when(~is_time, at)), F.lit(0)).alias("_to"),
        )
    )
    apart = (F.col("_to") > 0) & (F.col("_to") == F.col("_at") - 1)
    heads = numbered.where(apart).select("_id", F.col("_to").alias("_at")).unionByName(numbered.groupBy("_id").agg(F.max("_at").alias("_at")))
    reached = _cut(heads)
    onward = numbered.where((F.col("_to") > 0) & ~apart).select("_id", "_at", "_to")
    onward = _cut(onward.join(reached.withColumnRenamed("_at", "_to"), ["_id", "_to"], "left_anti"))
    while not onward.isEmpty():
        reached = _cut(reached.unionByName(reached.join(onward, ["_id", "_at"]).select("_id", F.col("_to").alias("_at"))))
        further = onward.select("_id", F.col("_at").alias("_to"), F.col("_to").alias("_next"))
        onward = _cut(onward.join(further, ["_id", "_to"]).select("_id", "_at", F.col("_next").alias("_to")))
    # copies count for the last kept time up to theirs
    flagged = numbered.join(reached.withColumn("_f", F.lit(1)), ["_id", "_at"], "left").select(
        "_id", "event_time", "n_copies", (-F.col("_at")).alias("_o"), F.coalesce("_f", F.lit(0)).alias("_f")
    )
    return ordered_scan(flagged, "_id", "_o", sums={"_g": F.col("_f")}).groupBy("_id", "_g").agg(
        F.min("event_time").alias("event_time"), F.sum("n_copies").alias("n_copies")
    ).drop("_g")


def first_updates(df: DataFrame, horizon: str = dims.DEDUP_HORIZON) -> DataFrame:
    """Batch deduplication: every delivery that no kept one of the same id precedes by ``horizon`` or
    less, with the number of copies it stands for. It goes by event time; the stream (``dedup_updates``)
    goes by arrival unless it is given another clock.

    Updates without an id are never duplicates. Deliveries of one id at one time are one by partial
    aggregation; the different times of an id, however many, are scanned by ordered blocks and
    followed by doubled pointers, and only the rows that are kept are fetched whole.
    """
    rest = [c for c in df.columns if c != "event_time"]
    alone = df.where("update_id is null").select("event_time", *rest, F.lit(1).cast("bigint").alias("n_copies"))
    keyed = df.where("update_id is not null").withColumn("_id", F.col("update_id").cast("string"))
    timed = keyed.where("event_time is not null")
    row = F.min(F.struct(*rest)).alias("u")
    kept = _kept(timed.groupBy("_id", "event_time").agg(F.count("*").alias("n_copies")), horizon)
    first = timed.groupBy("_id", "event_time").agg(row).join(kept, ["_id", "event_time"])
    # a delivery without a time has nothing to be compared by: it is kept
    untimed = keyed.where("event_time is null").groupBy("_id", "event_time").agg(row, F.count("*").alias("n_copies"))
    return first.unionByName(untimed).select("event_time", "u.*", "n_copies").unionByName(alone)
