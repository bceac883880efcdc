"""Value semantics, JSON reading, banks, files, identifiers, amounts."""

import math

import pytest
from pyspark.sql import functions as F

from docrisk.functions import values
from docrisk.functions.amounts import amount_style, currency_code, parse_amount
from docrisk.functions.banks import bank_display, canonical_bank
from docrisk.functions.files import document_type, extension, repair_mime
from docrisk.functions.identifiers import bic_valid, iban_valid, valid_address
from docrisk.functions.jsontext import parse_lenient
from docrisk.functions.scoring import risk_label, severity, suspicious


def column(spark, data, schema, fn):
    """Apply a Column function to rows and return the results in order."""
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], f"i int, {schema}")
    rows = df.select("i", fn().alias("out")).orderBy("i").collect()
    return [r["out"] for r in rows]


def test_number_keeps_null_missing_and_text_apart(spark):
    records = ['{"x":null}', "{}", '{"x":""}', '{"x":" 4 "}', '{"x":true}', '{"x":2.5}', '{"x":"abc"}', '{"x":"1d"}',
               '{"x":[1]}', '{"x":"0x1F"}', '{"x":"-1e2"}', '{"x":"NaN"}']
    got = column(spark, [(r,) for r in records], "t string",
                 lambda: values.number(values.member(F.parse_json("t"), "x")))
    assert got == [0.0, None, 0.0, 4.0, 1.0, 2.5, None, None, None, 31.0, -100.0, None]


def test_truthy(spark):
    records = ['{"x":null}', "{}", '{"x":""}', '{"x":0}', '{"x":false}', '{"x":"0"}', '{"x":0.1}', '{"x":true}', '{"x":{}}', '{"x":[]}']
    got = column(spark, [(r,) for r in records], "t string",
                 lambda: values.truthy(values.member(F.parse_json("t"), "x")))
    assert got == [False, False, False, False, False, True, True, True, True, True]


def test_strip_removes_every_blank(spark):
    texts = [" a b ", "  x﻿", "\t\n", " y　z "]
    assert column(spark, [(t,) for t in texts], "t string", lambda: values.strip(F.col("t"))) == ["a b", "x", "", "y　z"]
    assert column(spark, [("  a   b ",)], "t string", lambda: values.squeeze(F.col("t"))) == ["a b"]


@pytest.mark.parametrize(
    "value, expected",
    [(12.5, 13), (0.49999999999999994, 0), (1.4999999999999998, 1), (14.67, 15), (0.0, 0), (99.5, 100), (2.5, 3)],
)
def test_half_up(spark, value, expected):
    assert column(spark, [(value,)], "x double", lambda: values.half_up(F.col("x"))) == [expected]


def test_finite(spark):
    got = column(spark, [(1.0,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "x double",
                 lambda: values.finite(F.col("x")))
    assert got == [1.0, None, None, None, None]


def test_lenient_json(spark):
    cases = {
        '```json\n{"a":1}\n```': '{"a":1}',
        '```JSON {"a":1}```': '{"a":1}',
        '```\n{"a":1}': '{"a":1}',
        'Sonuç: {"a":1} bitti': '{"a":1}',
        '{"a":1} and {"b":2}': None,
        '{"a":1,"a":2}': '{"a":2}',
        '{"a":1}]': '{"a":1}',
        '{"a":1}}': None,
        "null": None,
        "7": None,
        '"{}"': None,
        "": None,
        "  ": None,
        "[1]": "[1]",
        "1,2": None,
        "} {": None,
        '{"a":': None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = parse_lenient(df, "t", "v", objects_only=True).select("t", F.to_json("v").alias("v")).collect()
    assert {r.t: r.v for r in got} == cases
    scalars = parse_lenient(spark.createDataFrame([("7",), ("null",)], "t string"), "t", "v")
    assert sorted(r[0] for r in scalars.select(F.schema_of_variant("v")).collect()) == ["BIGINT", "VOID"]


def test_lenient_json_is_idempotent_on_clean_text(spark):
    df = spark.createDataFrame([('{"a":[1,{"b":"x"}]}',)], "t string")
    once = parse_lenient(df, "t", "v").select(F.to_json("v").alias("t"))
    assert once.collect() == parse_lenient(once, "t", "v").select(F.to_json("v").alias("t")).collect()


BANKS = [
    ("AKBANK", "akbank"), ("Akbank T.A.S", None), ("Enpara Finans", "enpara"), ("VakıfBank", "vakifbank"),
    ("VAKIFBANK", "vakifbank"), ("iş bankası", "isbankasi"), ("ISBANK", "isbankasi"), ("İş Bankası", None),
    ("Ziraat Bankası", "ziraat"), ("Garanti BBVA", "garanti"), ("Yapı Kredi", "yapikredi"), (None, None), ("", None),
    ("Foo", None), ("Türkiye Halkbank", "halkbank"), ("deniz bank", "denizbank"),
]


def test_canonical_bank(spark):
    names = [(n,) for n, _ in BANKS]
    assert column(spark, names, "n string", lambda: canonical_bank(F.col("n"))) == [b for _, b in BANKS]
    assert column(spark, [("İş Bankası",)], "n string", lambda: canonical_bank(F.col("n"), "fixed")) == ["isbankasi"]
    keys = [(b,) for _, b in BANKS if b]
    assert column(spark, keys, "n string", lambda: canonical_bank(F.col("n"))) == [k for (k,) in keys]
    assert column(spark, [("isbankasi",), ("foo",)], "n string", lambda: bank_display(F.col("n"))) == ["İş Bankası", "foo"]


def test_document_type(spark):
    cases = [("application/pdf", "x.png", "pdf"), ("video/mp4", "a.jpg", "image"), (None, "CLIP.MKV", "video"),
             ("application/octet-stream", "x.heic", None), (None, None, None), ("IMAGE/GIF", "x", "image")]
    got = column(spark, [c[:2] for c in cases], "m string, n string", lambda: document_type(F.col("m"), F.col("n")))
    assert got == [c[2] for c in cases]


def test_repair_mime(spark):
    cases = [
        ("image", None, "a.WEBP", "image/webp"),
        ("image", "application/octet-stream", "x.pdf", "image/jpeg"),
        ("statement", "application/pdf", "e.pdf", "application/pdf"),
        ("statement", "application/pdf", "ekstre", "image/jpeg"),
        ("statement", "image/png", "s.pdf", "application/pdf"),
        ("pdf", None, "x", None),
        ("video", None, "v.mov", "video/mp4"),
        ("image", "image/gif", "x.png", "image/gif"),
    ]
    got = column(spark, [c[:3] for c in cases], "t string, m string, n string",
                 lambda: repair_mime(F.col("t"), F.col("m"), F.col("n")))
    assert got == [c[3] for c in cases]
    assert column(spark, [(".png",), ("a/.png",), ("a.b.PNG",), ("a",), ("a.",)], "n string",
                  lambda: extension(F.col("n"))) == ["", "", ".png", "", "."]


def test_addresses(spark):
    good = "T" + "9aB" * 11
    cases = {good: True, f"  {good} ": True, good[:-1]: False, good + "a": False, good[:-1] + "0": False,
             good[:-1] + "O": False, good[:-1] + "I": False, good[:-1] + "l": False, good + "\n": True, "": False}
    got = column(spark, [(c,) for c in cases] + [(None,)], "a string", lambda: valid_address(F.col("a")))
    assert got == [*cases.values(), False]


def test_iban_and_bic(spark):
    ibans = [("TR330006100519786457841326", True), ("tr33 0006 1005 1978 6457 8413 26", True),
             ("TR330006100519786457841327", False), ("TR33000610051978645784132", False),
             ("DE89370400440532013000", True), ("GB29NWBK60161331926819", True), ("XX", False), (None, None)]
    assert column(spark, [(i,) for i, _ in ibans], "i2 string", lambda: iban_valid(F.col("i2"))) == [ok for _, ok in ibans]
    bics = [("AKBKTRIS", True), ("AKBKTRISXXX", True), ("AKBKTRI", False), ("akbktris", False), (None, None)]
    assert column(spark, [(b,) for b, _ in bics], "b string", lambda: bic_valid(F.col("b"))) == [ok for _, ok in bics]


def test_amounts(spark):
    cases = [("1.250,50", "comma", "1250.50"), ("1,250.50", "dot", "1250.50"), ("1.000", "comma", "1000.00"),
             ("12.45", "dot", "12.45"), ("750", "plain", "750.00"), ("a", "other", None), (None, None, None)]
    texts = [(c[0],) for c in cases]
    assert column(spark, texts, "t string", lambda: amount_style(F.col("t"))) == [c[1] for c in cases]
    got = column(spark, texts, "t string", lambda: parse_amount(F.col("t")).cast("string"))
    assert got == [c[2] for c in cases]
    assert column(spark, [("tl",), ("₺",), ("EURO",), ("$",), ("chf",)], "t string",
                  lambda: currency_code(F.col("t"))) == ["TRY", "TRY", "EUR", "USD", "CHF"]


def test_bands(spark):
    scores = [0, 20, 21, 45, 46, 70, 71, 100]
    labels = column(spark, [(s,) for s in scores], "s int", lambda: risk_label(F.col("s")))
    assert labels == ["LOW RISK"] * 2 + ["MODERATE RISK"] * 2 + ["HIGH RISK"] * 2 + ["VERY HIGH RISK"] * 2
    assert column(spark, [(s,) for s in scores], "s int", lambda: severity(F.col("s"))) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert column(spark, [(s,) for s in scores], "s int", lambda: suspicious(F.col("s"))) == [s >= 46 for s in scores]
