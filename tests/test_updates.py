"""Routing and the chat streams."""

import json

import pytest
from pyspark.sql import functions as F

from docrisk import schemas
from docrisk.operators import updates
from docrisk.sources.sinks import write_outbox
from docrisk.sources.updates import read_updates
from docrisk.streaming.chat import report_messages, run_chat
from docrisk.streaming.dedup import dedup_updates

PDF = {"file_id": "d", "file_name": "dekont.pdf", "mime_type": "application/pdf"}
PHOTOS = [{"file_id": "s"}, {"file_id": "l"}]


def message(chat=7, **fields):
    return {"message_id": 5, "chat": {"id": chat}, **fields}


def callback(data, original, chat=7, cid="c"):
    menu = {"message_id": 6, "chat": {"id": chat}}
    if original is not None:
        menu["reply_to_message"] = original
    return {"id": cid, "data": data, "message": menu}


ROUTES = [
    ({}, "drop"),
    ({"message": message(chat=0, text="/start")}, "drop"),
    ({"message": message(text="/start now")}, "welcome"),
    ({"message": message(text="/x", document=PDF)}, "help"),
    ({"message": message(caption="/start", document=PDF)}, "menu"),
    ({"message": message(text="merhaba")}, "ask_file"),
    ({"message": message(photo=[])}, "ask_file"),
    ({"message": message(document={"file_id": "z", "file_name": "a.zip"})}, "unsupported_file"),
    ({"message": message(photo=PHOTOS)}, "menu"),
    ({"callback_query": callback("bank:akbank", message(document=PDF))}, "receipt"),
    ({"callback_query": callback("mode:statement", message(document=PDF))}, "statement"),
    ({"callback_query": callback("mode:statement", message(video={"file_id": "v"}))}, "statement_video"),
    ({"callback_query": callback("bank:x", message(video={"file_id": "v"}))}, "receipt"),
    ({"callback_query": callback("foo", message(document=PDF))}, "invalid_choice"),
    ({"callback_query": callback(None, message(document=PDF))}, "invalid_choice"),
    ({"callback_query": callback("bank:x", None)}, "no_original"),
    ({"callback_query": callback("bank:x", message(text="a"))}, "no_file"),
    ({"callback_query": callback("bank:x", message(document=PDF), cid="")}, "drop"),
    ({"callback_query": callback("bank:x", message(document=PDF), chat=0)}, "drop"),
    ({"callback_query": {"id": "c", "data": "bank:x"}, "message": message(text="/start")}, "drop"),
]


def update_rows(envelopes):
    return [json.dumps({"update_id": i, "event_time": "2024-01-01T00:00:00Z", **e}) for i, e in enumerate(envelopes)]


def write_updates(path, lines, name="0.json"):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(lines))
    return str(path)


def test_routes(spark, tmp_path):
    path = write_updates(tmp_path / "u", update_rows([e for e, _ in ROUTES]))
    routed = updates.route_updates(read_updates(spark, path)).orderBy("update_id").collect()
    assert [r.route for r in routed] == [route for _, route in ROUTES]
    assert routed[8].file.asDict() == {"file_id": "l", "file_name": "telegram-photo.jpg", "mime_type": "image/jpeg", "type": "image"}
    assert routed[12].file.asDict() == {"file_id": "v", "file_name": "telegram-video.mp4", "mime_type": "video/mp4", "type": "video"}
    assert (routed[9].bank, routed[9].reply_to, routed[9].chat_id) == ("akbank", 5, 7)


def test_requests_and_messages(spark, tmp_path):
    caption = "Gönderen: Ali\nTutar: 5 TL"
    path = write_updates(tmp_path / "u", update_rows([
        {"callback_query": callback("bank:isbankasi", message(document=PDF, caption=caption, text="x"))},
        {"callback_query": callback("mode:statement", message(photo=PHOTOS))},
        {"message": message(text="selam")},
    ]))
    routed = updates.route_updates(read_updates(spark, path))
    receipt, statement = updates.screening_requests(routed).orderBy("update_id").collect()
    assert (receipt.type, receipt.bank, receipt.claim.senderName, receipt.statement_mode) == ("pdf", "isbankasi", "Ali", None)
    assert json.loads(receipt.provided_info)["amount"] == "5"
    assert (statement.type, statement.bank, statement.statement_mode, statement.provided_info) == ("statement", None, "true", None)
    texts = {r.update_id: (r.text, r.reply_to_message_id) for r in updates.outgoing_messages(routed).collect()}
    assert texts[0] == ("İş Bankası seçildi.\n\ndekont.pdf", 5)
    assert texts[1][0].startswith("Hesap özeti seçildi.") and texts[2][1] is None


def test_error_messages(spark):
    df = spark.createDataFrame([(1, 7, "hata"), (2, 0, "x"), (3, None, "x"), (4, 8, None)], "update_id bigint, chat_id bigint, error string")
    assert {r.update_id: r.text.split("\n")[-1] for r in updates.error_messages(df).collect()} == {1: "hata", 4: "Bilinmeyen hata"}


def test_first_updates(spark):
    rows = [(1, "2024-01-01 00:05:00"), (1, "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "update_id bigint, t string").select("update_id", F.col("t").cast("timestamp").alias("event_time"))
    got = updates.first_updates(df).collect()
    assert len(got) == 3
    assert [(r.event_time.minute, r.n_copies) for r in got if r.update_id == 1] == [(0, 2)]


def test_first_updates_readmits_after_the_horizon(spark):
    minutes = {1: [0, 5, 10, 11, 12, 21, 22], 2: [30, 30, 41, 41]}
    df = spark.createDataFrame([(i, 60 * m) for i, ms in minutes.items() for m in ms], "update_id bigint, s bigint")
    df = df.select("update_id", F.timestamp_seconds("s").alias("event_time"))
    got = sorted((r.update_id, r.event_time.minute, r.n_copies) for r in updates.first_updates(df).collect())
    assert got == [(1, 0, 3), (1, 11, 3), (1, 22, 1), (2, 30, 2), (2, 41, 2)]
    assert updates.first_updates(df.limit(0)).collect() == []


def test_first_updates_follow_long_chains(spark):
    """Ids of many times without a gap, one of them with a third of all rows, against a plain loop."""
    import random

    rng = random.Random(3)
    rows = [(1, 7 * k) for k in range(20_000)] + [(2, rng.randrange(2_000_000)) for _ in range(20_000)]
    rows += [(i, 300 * rng.randrange(-40, 40)) for i in range(3, 1000) for _ in range(20)] + [(None, 5), (None, 5)]
    want, last = [], {}
    for i, s in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1])):
        if i in last and s <= last[i][1] + 600:
            last[i][2] += 1
        else:
            last[i] = [i, s, 1]
            want.append(last[i])
    df = spark.createDataFrame(rows, "update_id bigint, s bigint").withColumn("event_time", F.timestamp_seconds("s"))
    found = updates.first_updates(df)
    # no id's times are gathered in one array
    assert "collect_list" not in found._jdf.queryExecution().toString()
    got = [[r.update_id, r.s, r.n_copies] for r in found.collect()]
    assert sorted(r for r in got if r[0]) == sorted(want) and [r for r in got if not r[0]] == [[None, 5, 1]] * 2


def at(i, minute):
    return json.dumps({"update_id": i, "event_time": f"2024-01-01T00:{minute:02d}:00Z", "message": message(text="a")})


def drain(query):
    assert query.awaitTermination(120)
    assert query.exception() is None


def test_watermark_dedup(spark, tmp_path):
    source = write_updates(tmp_path / "u", [at(1, 0), at(1, 5), at(None, 5), at(None, 6), at(2, 7)])
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        kept = dedup_updates(read_updates(spark, source, stream=True)).select("update_id", "event_time")
        drain(kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
              .trigger(availableNow=True).start())
        return sorted(r.update_id or 0 for r in spark.read.parquet(out).collect())

    assert run() == [0, 0, 1, 2]
    # the state outlives the query: a repeat in a later run is still a duplicate
    write_updates(tmp_path / "u", [at(1, 8), at(3, 9)], "1.json")
    assert run() == [0, 0, 1, 2, 3]
    # a first delivery comes out, however old it is
    write_updates(tmp_path / "u", [at(5, 0), at(4, 59)], "2.json")
    write_updates(tmp_path / "u", [at(6, 1), at(5, 0)], "3.json")
    assert run() == [0, 0, 1, 2, 3, 4, 5, 6]


@pytest.fixture
def no_empty_batches(spark):
    """State on processing time asks for batch after batch; this lets a run over what is there end."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_exact_dedup_flags_and_readmits(spark, tmp_path, no_empty_batches):
    source = write_updates(tmp_path / "u", [at(1, 0), at(1, 0), at(None, 0), at(None, 0)])
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(horizon):
        flagged = dedup_updates(read_updates(spark, source, stream=True), horizon, exact=True).select("update_id", "duplicate")
        drain(flagged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
              .trigger(availableNow=True).start())
        return sorted((r.update_id or 0, r.duplicate) for r in spark.read.parquet(out).collect())

    first = [(0, False), (0, False), (1, False), (1, True)]
    assert run("2 seconds") == first
    import time

    time.sleep(4)
    write_updates(tmp_path / "u", [at(1, 1)], "1.json")
    assert run("2 seconds") == sorted([*first, (1, False)])


def test_chat_flow(spark, tmp_path):
    lines = update_rows([
        {"callback_query": callback("bank:akbank", message(document=PDF, caption="Tutar: 5 TL"))},
        {"message": message(text="/start")},
        {"message": message(chat=0, text="x")},
    ])
    source = write_updates(tmp_path / "u", [*lines, lines[0]])
    out = str(tmp_path / "out")
    drain(run_chat(read_updates(spark, source, stream=True), out, str(tmp_path / "checkpoint")))
    requests = spark.read.parquet(f"{out}/requests")
    assert [r.doc_id for r in requests.collect()] == ["0"]
    assert sorted(r.update_id for r in spark.read.parquet(f"{out}/outbox").collect()) == [0, 1]
    results = spark.createDataFrame(
        [("0", True, None, "pdf", 50.0, "HIGH RISK", 80.0, "ozet", "akbank")],
        "doc_id string, success boolean, error string, type string, score double, risk_label string, confidence double, summary string, bank string",
    )
    requested = requests.select("doc_id", "update_id", "chat_id", "reply_to")
    sent = report_messages(requested, results).collect()
    assert len(sent) == 1 and "Risk Skoru: 50/100" in sent[0].text and sent[0].reply_to_message_id == 5
    failed = report_messages(requested, results.withColumns({"success": F.lit(False), "error": F.lit("bozuk")})).first()
    assert failed.text.endswith("bozuk")


def test_outbox_batches_are_replaced_not_repeated(spark, tmp_path):
    from docrisk.sources.sinks import write_batch

    df = spark.createDataFrame([(1,)], "update_id bigint")
    for _ in range(2):
        write_batch(df, str(tmp_path / "o"), 0, "a")
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
    # another stream begins at batch 0 as well and replaces nothing
    write_batch(df, str(tmp_path / "o"), 0, "b")
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    source = write_updates(tmp_path / "u", update_rows([{"message": message(text="/start")}]))
    messages = updates.outgoing_messages(updates.route_updates(read_updates(spark, source, stream=True)))
    drain(write_outbox(messages, str(tmp_path / "box"), str(tmp_path / "c")))
    assert spark.read.parquet(str(tmp_path / "box")).count() == 1


def test_schema_of_cast_file(spark):
    assert "file_id" in schemas.DOCUMENT.fieldNames()
    with pytest.raises(Exception):
        spark.read.schema(schemas.UPDATES).json("/no/such/path").count()
