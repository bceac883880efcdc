"""Claim extraction, comparison and repeated digits: worked examples."""

import json

import pytest
from pyspark.sql import functions as F

from docrisk import dims
from docrisk.operators import claims, report

# text -> sender, recipient, amount, currency, iban
CAPTIONS = {
    "Gönderen: Asya Tan\n1000 TL\nTR40 0001 5000 1112 2233 3444 45\nAlıcı: Murat Koçak":
        ("Asya Tan", "Murat Koçak", "1000", "TL", "TR4000015000111222333444"),
    "TR400001500011122233344445": (None, None, None, None, None),
    "12.45\n500 TL": (None, None, "500", "TL", None),
    "Ali Veli\nAkbank\n1.000 TL\nAyşe Can": ("Ali Veli", "Ayşe Can", "1.000", "TL", None),
    "Ali Veli\n1000 TL": ("Ali Veli", "1000 TL", "1000", "TL", None),
    "Tutar: 1.250,50 EURO": (None, None, "1.250,50", "EUR", None),
    "750": (None, None, "750", None, None),
    "12.45": (None, None, None, None, None),
    "TL bekliyorum": (None, None, None, "TRY", None),
    "": (None, None, None, None, None),
    "   \r\n ": (None, None, None, None, None),
    # the label alone is a clean line, so the last resort takes the next line as recipient too
    "Gönderen:\nAli Can": ("Ali Can", "Ali Can", None, None, None),
    "ALICI - Can\r\nmiktar 5": ("ALICI - Can", "Can", "5", None, None),
    "Ali\niş bankası\n1.000 ₺": ("Ali", "iş bankası", "1.000", "₺", None),
    "Ali\n12345\ngaranti bankası\n2,5 usd\nIBAN TR12\nVeli": ("Ali", "Veli", "2,5", "USD", None),
}
FIXED = {
    "TR400001500011122233344445": (None, None, None, None, "TR400001500011122233344445"),
    "TR40 0001 5000 1112 2233 3444 45": (None, None, None, None, "TR400001500011122233344445"),
    "Ali\niş bankası\n1000 TL\nVeli": ("Ali", "Veli", "1000", "TL", None),
    "Ali\nVAKIFBANK\n1000 TL\nVeli": ("Ali", "Veli", "1000", "TL", None),
}


@pytest.mark.parametrize("mode, cases", [("compat", CAPTIONS), ("fixed", FIXED)])
def test_extraction(spark, mode, cases):
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    rows = claims.extract_claims(df, "text", mode).select("text", "claim.*").collect()
    got = {r.text: (r.senderName, r.recipientName, r.amount, r.currency, r.iban) for r in rows}
    assert got == cases
    assert all(r.rawText == r.text for r in rows)


def test_null_caption(spark):
    row = claims.extract_claims(spark.createDataFrame([(None,)], "text string")).first()
    assert row.claim.rawText == "" and row.claim.amount is None
    assert row.text is None


def test_presence_and_payload(spark):
    schema = "i int, claim struct<senderName:string,recipientName:string,amount:string,currency:string,iban:string,rawText:string>"
    rows = [(0, (None, " ", None, None, None, "")), (1, (None, None, None, None, None, "merhaba")),
            (2, ("A", "", None, "TL", None, ""))]
    df = spark.createDataFrame(rows, schema).orderBy("i")
    assert [r[0] for r in df.select(claims.has_claim(F.col("claim"))).collect()] == [False, True, True]
    payload = json.loads(df.select(claims.claim_payload(F.col("claim"))).collect()[2][0])
    assert payload == {"senderName": "A", "recipientName": None, "amount": None, "currency": "TL", "iban": None}


COMPARISON = "struct<provided:string,enabled:boolean,hasExpectedDetails:boolean,matches:map<string,string>,warnings:array<string>>"


@pytest.mark.parametrize(
    "comparison, state, mismatches, unknowns",
    [
        (None, "none", 0, 0),
        ((None, None, None, None, None), "none", 0, 0),
        ((None, False, False, {"amount": "mismatch"}, ["x"]), "none", 0, 0),
        ((None, True, None, {}, []), "consistent", 0, 0),
        (("{}", None, None, None, None), "consistent", 0, 0),
        ((None, True, None, {"amount": "mismatch", "iban": None}, []), "mismatch", 1, 1),
        ((None, None, True, {"amount": "match"}, ["uyarı"]), "unverified", 0, 0),
        ((None, True, None, {"iban": "unknown"}, []), "unverified", 0, 1),
    ],
)
def test_summary(spark, comparison, state, mismatches, unknowns):
    df = spark.createDataFrame([(comparison,)], f"comparison {COMPARISON}")
    r = claims.comparison_summary(df).first()
    assert (r.state, r.n_mismatch, r.n_unknown) == (state, mismatches, unknowns)


def test_reconciliation(spark):
    said = spark.createDataFrame(
        [("d", ("Işık Çelik", None, "1.250,50", "TL", "TR40 0001 5000 1112 2233 3444 45", ""))],
        "doc_id string, claim struct<senderName:string,recipientName:string,amount:string,currency:string,iban:string,rawText:string>",
    )
    read = spark.createDataFrame(
        [("d", "IŞIK  ÇELİK", "x", "1250.50", "₺", None)],
        "doc_id string, senderName string, recipientName string, amount string, currency string, iban string",
    )
    c = claims.reconcile_claims(said, read).first().comparison
    assert c.matches == {"senderName": "match", "amount": "match", "currency": "match", "iban": "unknown"}
    assert c.enabled and json.loads(c.provided)["senderName"] == "Işık Çelik"


def test_repeated_digits(spark):
    df = spark.createDataFrame([(1, "a1b1 2"), (2, "7"), (3, "12"), (4, None), (5, ""), (6, "00900 ٣٣")], "doc_id int, text string")
    got = sorted(tuple(r) for r in claims.repeated_digits(df).collect())
    assert got == [(1, "1", 2), (6, "0", 4)]
    states = {r.doc_id: r.s for r in df.select("doc_id", claims.digit_state(F.col("text")).alias("s")).collect()}
    assert states == {1: "ready", 2: "too_few", 3: "no_repeats", 4: "no_text", 5: "no_text", 6: "ready"}
    assert set(states.values()) == set(dims.DIGIT_STATES)


def test_report(spark):
    df = spark.createDataFrame(
        [("pdf", 72.0, None, 80.0, "", "isbankasi", (None, True, None, {"amount": "mismatch"}, ["bir"]))],
        f"type string, score double, risk_label string, confidence double, summary string, bank string, comparison {COMPARISON}",
    )
    r = report.render_report(df).first()
    assert r.severity == 3
    assert r.text.startswith("ANALİZ SONUCU\n\nBanka: İş Bankası\nRisk Skoru: 72/100\n\nRisk Seviyesi:\nUNKNOWN\n\nGüven:\n80/100\n")
    block = "\n".join(["", "", dims.RULE_LINE, dims.CLAIM_TITLE, "", dims.CLAIM_MISMATCH, "", "• bir", "• Tutar: Uyuşmuyor.", "", dims.CLAIM_NOTE])
    assert dims.SUMMARY_DEFAULT + block in r.text
    plain = report.render_report(df.drop("comparison").withColumn("type", F.lit("statement"))).first().text
    assert plain.startswith("HESAP ÖZETİ ANALİZİ\n\nRisk Skoru: 72/100") and dims.CLAIM_TITLE not in plain
