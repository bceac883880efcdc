"""Files in, results out."""

import base64
import json

from pyspark.sql import functions as F

from docrisk import dims
from docrisk.operators import intake
from docrisk.plans.screening import requests_from_files, screen_requests
from docrisk.session import configure, shared_folder
from docrisk.sources import documents, sinks


def test_documents_and_rejects(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"12345")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "big.pdf").write_bytes(b"x" * 11)
    good = documents.read_documents(spark, str(tmp_path), max_bytes=10)
    assert [bytes(r.content) for r in good.collect()] == [b"12345"]
    bad = {r.path.rsplit("/", 1)[1]: r.error for r in documents.rejected_documents(spark, str(tmp_path), max_bytes=10).collect()}
    assert bad == {"empty.pdf": dims.EMPTY_FILE, "big.pdf": dims.TOO_LARGE}


def test_templates_and_requests(spark, tmp_path):
    (tmp_path / "akbank.pdf").write_bytes(b"tpl")
    (tmp_path / "ziraat.pdf").write_bytes(b"")
    (tmp_path / "other.pdf").write_bytes(b"x")
    templates = documents.read_templates(spark, str(tmp_path))
    assert [(r.bank, r.reference) for r in templates.collect()] == [("akbank", "akbank.pdf")]
    rows = [("1", "pdf", "akbank", "application/pdf"), ("2", "image", "akbank", "image/png"), ("3", "video", "akbank", "video/mp4"),
            ("4", "statement", "akbank", "application/pdf"), ("5", "statement", None, "image/jpeg"), ("6", "pdf", "garanti", None),
            ("7", "pdf", None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, type string, bank string, mime string").withColumns(
        {"file_name": F.lit("f"), "content": F.lit(b"doc"), "frames": F.array(F.lit(b"f1"), F.lit(b"f2"))}
    )
    got = {r.doc_id: r for r in intake.model_requests(intake.attach_template(docs, templates)).collect()}
    data = lambda text: base64.b64encode(text).decode()
    assert [(p.kind, p.filename, p.data) for p in got["1"].parts] == [
        ("input_file", "f", "data:application/pdf;base64," + data(b"doc")),
        ("input_file", "akbank.pdf", "data:application/pdf;base64," + data(b"tpl"))]
    assert (got["2"].reference, [p.data for p in got["2"].parts]) == ("akbank.pdf", ["data:image/png;base64," + data(b"doc")])
    assert (got["3"].reference, got["3"].prompt, len(got["3"].parts)) == (None, "video", 2)
    assert (got["4"].reference, [p.kind for p in got["4"].parts]) == (None, ["input_file"])
    assert [p.kind for p in got["5"].parts] == ["input_image"]
    assert (got["6"].reference, len(got["6"].parts), got["7"].reference) == (None, 1, None)


def test_manifest_to_results(spark, tmp_path):
    manifest = [
        {"doc_id": "1", "type": ["pdf", "x"], "file_name": ["a.pdf"], "bank": ["Akbank"], "image": None, "file": {"path": "p", "mime": None}},
        {"doc_id": "2", "type": ["image"], "statement_mode": ["true"], "file": {"path": "p", "original_name": "e.pdf", "mime": "image/png"},
         "image": {"path": "q", "original_name": "i.pdf"}},
        {"doc_id": "3", "type": ["pdf"]},
        {"doc_id": "4", "video": {"path": "p"}},
    ]
    answers = [{"doc_id": "1", "type": "pdf", "output_text": '{"summary":"s"}'}, {"doc_id": "2", "type": "statement", "output_text": "{}"}]
    for name, rows in (("m", manifest), ("r", answers)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "0.json").write_text("\n".join(json.dumps(r) for r in rows))
    resolved = intake.resolve_manifest(documents.read_manifest(spark, str(tmp_path / "m")))
    got = {r.doc_id: r for r in resolved.collect()}
    assert (got["1"].type, got["1"].file_name, got["1"].bank, got["1"].path) == ("pdf", "a.pdf", "akbank", "p")
    assert (got["2"].type, got["2"].file_name, got["2"].mime, got["2"].path) == ("statement", "i.pdf", "application/pdf", "q")
    assert (got["3"].error, got["3"].file_name) == (dims.NO_UPLOAD, "document")
    assert (got["4"].type, got["4"].error) == ("document", dims.UNSUPPORTED_TYPE)
    results = screen_requests(resolved, documents.read_model_responses(spark, str(tmp_path / "r")), intake.template_names(spark))
    out = str(tmp_path / "out")
    sinks.write_results(results, out)
    saved = {r.doc_id: r for r in spark.read.parquet(f"{out}/results").collect()}
    assert set(saved) == {"1", "2"} and saved["1"].evidence == ["s"] and saved["1"].reference == "akbank.pdf"
    assert {r.doc_id for r in spark.read.parquet(f"{out}/rejects").collect()} == {"3", "4"}
    pruned = spark.read.parquet(f"{out}/results").filter("type = 'pdf'")
    assert "PartitionFilters: [isnotnull(type" in pruned._jdf.queryExecution().toString()


def test_chain_results(spark, tmp_path):
    df = spark.createDataFrame([("a", "WALLET", True, None), ("b", None, False, "x")], "address string, address_type string, success boolean, error string")
    sinks.write_chain_results(df, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o" / "rejects")).first().error == "x"
    assert spark.read.parquet(str(tmp_path / "o" / "results")).first().address == "a"


def test_session_settings(spark):
    configure(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    folder = shared_folder(spark)
    assert folder and shared_folder(spark) == folder


PUBLISHED = "doc_id string, type string, success boolean, error string, score double"


def _standing(spark, path):
    schema = spark.createDataFrame([], PUBLISHED).schema
    good = sinks.read_published(spark, path, "results", spark.createDataFrame([], "doc_id string, type string, success boolean, score double").schema)
    bad = sinks.read_published(spark, path, "rejects", spark.createDataFrame([], "doc_id string, type string, success boolean, error string").schema)
    assert set(good.columns) | set(bad.columns) == set(schema.fieldNames())
    return sorted((r.doc_id, r.type, r.score) for r in good.collect()), sorted((r.doc_id, r.type, r.error) for r in bad.collect())


def test_published_types_are_replaced_together(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "o")
    first = [("1", "pdf", True, None, 1.0), ("2", "pdf", False, "x", None), ("3", "image", True, None, 3.0), ("4", None, False, "no type", None)]
    assert sinks.publish(spark.createDataFrame(first, PUBLISHED), path) == 0
    assert _standing(spark, path) == ([("1", "pdf", 1.0), ("3", "image", 3.0)], [("2", "pdf", "x"), ("4", None, "no type")])
    # the run dies between the two tables: nothing has changed
    again = spark.createDataFrame([("2", "pdf", True, None, 9.0), ("1", "pdf", False, "gone", None)], PUBLISHED)
    monkeypatch.setattr(sinks, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    try:
        sinks.publish(again, path)
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert _standing(spark, path)[0] == [("1", "pdf", 1.0), ("3", "image", 3.0)]
    # a rerun of one type replaces its results and rejects and leaves the others
    assert sinks.publish(again, path) == 1
    assert _standing(spark, path) == ([("2", "pdf", 9.0), ("3", "image", 3.0)], [("1", "pdf", "gone"), ("4", None, "no type")])
    # a type whose documents all fail has no results any more
    sinks.publish(spark.createDataFrame([("3", "image", False, "late", None)], PUBLISHED), path)
    assert _standing(spark, path)[0] == [("2", "pdf", 9.0)]


def test_published_types_prune_folders(spark, tmp_path):
    path = str(tmp_path / "o")
    sinks.publish(spark.createDataFrame([("1", "pdf", True, None, 1.0), ("3", "image", True, None, 3.0)], PUBLISHED), path)
    schema = spark.createDataFrame([], "doc_id string, type string, success boolean, score double").schema
    rows = sinks.read_published(spark, path, "results", schema).where("type = 'pdf'")
    assert [r.doc_id for r in rows.collect()] == ["1"]


def test_requests_from_files(spark, tmp_path):
    files, templates = tmp_path / "files", tmp_path / "templates"
    (files / "deep").mkdir(parents=True)
    (templates / "old").mkdir(parents=True)
    (files / "a b.pdf").write_bytes(b"%PDF" * 40)
    (files / "deep" / "ğ+1.png").write_bytes(b"img")
    (files / "empty.pdf").write_bytes(b"")
    (files / "big.pdf").write_bytes(b"x" * 301)
    (templates / "akbank.pdf").write_bytes(b"tpl")
    (templates / "ziraat.pdf").write_bytes(b"")
    (templates / "old" / "enpara.pdf").write_bytes(b"not at its place")
    assert [tuple(r) for r in documents.present_templates(spark, str(templates)).collect()] == [("akbank", "akbank.pdf")]
    rows = [
        ("1", "pdf", f"file:{files}/a b.pdf", "akbank", None), ("2", "image", f"file://{files}/deep/ğ+1.png", "akbank", None),
        ("3", "pdf", f"file:{files}/empty.pdf", "akbank", None), ("4", "pdf", f"file:{files}/gone.pdf", "ziraat", None),
        ("5", "pdf", f"file:{files}/big.pdf", "enpara", None), ("6", "pdf", f"file:{files}/a b.pdf", "ziraat", None),
        ("7", "pdf", f"file:{files}/a b.pdf", "akbank", "earlier"), ("8", "pdf", None, "akbank", None),
    ]
    resolved = spark.createDataFrame(rows, "doc_id string, type string, path string, bank string, error string").withColumns(
        {"mime": F.lit("image/png"), "file_name": F.lit("f")})
    found = documents.with_contents(resolved, spark, str(files), max_bytes=300)
    assert {r.doc_id: (r.error, r.content and len(r.content)) for r in found.collect()} == {
        "1": (None, 160), "2": (None, 3), "3": (dims.EMPTY_FILE, None), "4": (dims.EMPTY_FILE, None), "5": (dims.TOO_LARGE, None),
        "6": (None, 160), "7": ("earlier", None), "8": (dims.EMPTY_FILE, None)}
    got = {r.doc_id: r for r in requests_from_files(resolved, spark, str(files), str(templates)).collect()}
    one_line = "data:application/pdf;base64," + base64.b64encode(b"%PDF" * 40).decode()
    assert [(p.filename, p.data) for p in got["1"].parts] == [
        ("f", one_line), ("akbank.pdf", "data:application/pdf;base64," + base64.b64encode(b"tpl").decode())]
    assert (got["2"].reference, [p.kind for p in got["2"].parts]) == ("akbank.pdf", ["input_image"])
    assert [p.data for p in got["6"].parts] == [one_line] and got["6"].reference is None
    assert all(got[i].parts is None and got[i].prompt is None and got[i].error for i in "3478")


def test_large_templates_are_dealt(spark):
    docs = spark.createDataFrame(
        [(str(i), t, r) for i in range(40) for t, r in (("pdf", "a.pdf"), ("pdf", None), ("image", "a.pdf"), ("pdf", "gone.pdf"))],
        "doc_id string, type string, reference string")
    templates = spark.createDataFrame([("a", "a.pdf", b"tpl"), ("b", "b.pdf", b"x")], "bank string, reference string, template_content binary")
    both = [sorted(map(str, intake.attach_template_content(docs, templates, most).collect())) for most in (100, 1)]
    assert both[0] == both[1] and len(both[0]) == 160
    assert sum("tpl" in r for r in both[0]) == 40
    plan = intake.attach_template_content(docs, templates, 1)._jdf.queryExecution().toString()
    assert "ResolvedHint (strategy=merge)" in plan or "SortMergeJoin" in plan
    assert intake.attach_template_content(docs, templates.limit(0)).where("template_content is not null").count() == 0
