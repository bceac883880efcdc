"""Risk engine and screening: worked examples and properties."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docrisk import dims, schemas
from docrisk.operators import intake, invoice, responses, risk
from docrisk.plans.screening import screen_documents, screen_requests


def checks(**given):
    """name -> (status, score) as the engine's struct."""
    return {n: {"status": given[n][0], "score": given[n][1], "evidence": None} if n in given else None
            for n in dims.CHECK_NAMES}


def categories(spark, cases):
    schema = schemas.struct(i=schemas.I, checks=schemas.CHECKS)
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], schema)
    rows = risk.category_risks(df).orderBy("i").collect()
    return [r["categories"].asDict() for r in rows]


def test_weights():
    assert len(dims.CHECK_NAMES) == len(set(dims.CHECK_NAMES)) == 25
    assert sum(len(w) for w in dims.CHECK_WEIGHTS.values()) == 39
    assert {n for w in dims.CHECK_WEIGHTS.values() for n in w} == set(dims.CHECK_NAMES)
    assert sum(dims.CATEGORY_WEIGHTS.values()) == pytest.approx(1)


@pytest.mark.parametrize(
    "category, given, expected",
    [
        ("visualRisk", dict(stampConsistency=("pass", 10.0), imageQuality=("pass", 20.0)), 15),
        ("textRisk", dict(dateConsistency=("pass", 12.0), currencyFormatting=("pass", 13.0)), 13),
        ("textRisk", dict(lineSpacing=("pass", 0.0), textAlignment=("pass", 3.0)), 1),
        ("visualRisk", dict(compressionArtifacts=("pass", 150.0), logoConsistency=("pass", -5.0)), 50),
        ("visualRisk", dict(compressionArtifacts=("unknown", 100.0), logoConsistency=("pass", 30.0)), 30),
        ("visualRisk", dict(compressionArtifacts=(None, 10.0), logoConsistency=("pass", 30.0)), 20),
        ("visualRisk", dict(compressionArtifacts=("pass", None), logoConsistency=("pass", 40.0)), 40),
        ("visualRisk", dict(compressionArtifacts=("pass", float("nan")), logoConsistency=("pass", 40.0)), 40),
        ("visualRisk", dict(compressionArtifacts=("pass", float("inf")), logoConsistency=("pass", 40.0)), 40),
        ("visualRisk", {}, 0),
    ],
)
def test_category_risk(spark, category, given, expected):
    assert categories(spark, [checks(**given)])[0][category] == expected


def test_no_checks_at_all(spark):
    assert set(categories(spark, [None])[0].values()) == {0}


OVERALL = [
    ((10, 10, 10, 10, 20), False, 13, "LOW RISK", False),
    ((10, 10, 10, 10, 20), True, 23, "MODERATE RISK", False),
    ((20,) * 5, False, 20, "LOW RISK", False),
    ((45,) * 5, False, 45, "MODERATE RISK", False),
    ((46,) * 5, False, 46, "HIGH RISK", True),
    ((70,) * 5, False, 70, "HIGH RISK", True),
    ((71,) * 5, False, 71, "VERY HIGH RISK", True),
    ((96,) * 5, True, 100, "VERY HIGH RISK", True),
    ((0, 0, 0, 2, 0), False, 1, "LOW RISK", False),
]


def test_overall_risk(spark):
    amount = "struct<inconsistent:boolean,calculated_given:boolean,total_given:boolean,difference:double>"
    cats = ",".join(f"{c}:int" for c in dims.CATEGORY_WEIGHTS)
    rows = [(i, list(c), (bonus, True, True, 0.02)) for i, (c, bonus, *_) in enumerate(OVERALL)]
    df = spark.createDataFrame([(i, tuple(c), a) for i, c, a in rows], f"i int, categories struct<{cats}>, amount {amount}")
    got = risk.overall_risk(df).orderBy("i").collect()
    assert [(r.overall_risk, r.risk_label, r.suspicious) for r in got] == [o[2:] for o in OVERALL]


@pytest.mark.parametrize(
    "amount, bonus",
    [
        ('{"calculationConsistent":false,"calculatedTotal":1,"totalAmount":1,"difference":0.02}', 10),
        ('{"calculationConsistent":false,"calculatedTotal":1,"totalAmount":1,"difference":0.01}', 0),
        ('{"calculationConsistent":false,"calculatedTotal":1,"totalAmount":1,"difference":-5}', 10),
        ('{"calculationConsistent":false,"calculatedTotal":1,"totalAmount":1,"difference":"7"}', 10),
        ('{"calculationConsistent":false,"calculatedTotal":1,"totalAmount":1,"difference":null}', 0),
        ('{"calculationConsistent":false,"calculatedTotal":null,"totalAmount":1,"difference":5}', 0),
        ('{"calculationConsistent":false,"totalAmount":1,"difference":5}', 10),
        ('{"calculationConsistent":true,"calculatedTotal":1,"totalAmount":1,"difference":5}', 0),
        ('{"calculationConsistent":"false","calculatedTotal":1,"totalAmount":1,"difference":5}', 0),
        ("null", 0),
    ],
)
def test_arithmetic_bonus(spark, amount, bonus):
    df = spark.createDataFrame([(f'{{"amountAnalysis":{amount}}}',)], "output_text string")
    fields = responses.receipt_fields(responses.parse_responses(df))
    assert fields.select(risk.arithmetic_bonus(F.col("amount"))).first()[0] == bonus


def test_json_null_score_counts_as_zero_and_missing_is_skipped(spark):
    def text(first):
        return json.dumps({"checks": {"compressionArtifacts": first, "logoConsistency": {"status": "pass", "score": 40}}})

    rows = [(0, text({"status": "pass", "score": None})), (1, text({"status": "pass"})), (2, text(5)),
            (3, text({"status": "pass", "score": "20"})), (4, text({"status": "pass", "score": True}))]
    df = spark.createDataFrame(rows, "i int, output_text string")
    scored = risk.category_risks(responses.receipt_fields(responses.parse_responses(df))).orderBy("i").collect()
    assert [r["categories"]["visualRisk"] for r in scored] == [20, 40, 40, 30, 21]


def test_properties(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(60):
        given = {n: (rng.choice(dims.CHECK_STATUSES), float(rng.randint(0, 100))) for n in dims.CHECK_NAMES if rng.random() < 0.8}
        cases.append(given)
    schema = schemas.struct(i=schemas.I, checks=schemas.CHECKS)

    def overall(sets):
        df = spark.createDataFrame([(i, checks(**c)) for i, c in enumerate(sets)], schema)
        rows = risk.score_documents(df, amount=None).orderBy("i").collect()
        return [(r.overall_risk, r.risk_label, r.suspicious) for r in rows]

    base = overall(cases)
    assert all(0 <= s <= 100 and sus == (s >= 46) for s, _, sus in base)
    raised = [{n: (st, min(100.0, sc + 10)) if n == "editingTraces" else (st, sc) for n, (st, sc) in c.items()} for c in cases]
    assert all(b[0] >= a[0] for a, b in zip(base, overall(raised)))
    extra = [c | {"imageQuality": ("unknown", 99.0)} for c in cases]
    without = [{n: v for n, v in c.items() if n != "imageQuality"} for c in cases]
    assert overall(extra) == overall(without)


def test_long_form_agrees_on_whole_scores(spark):
    rng = random.Random(3)
    rows = [(d, n, "pass", rng.randint(0, 100)) for d in range(20) for n in dims.CHECK_NAMES]
    long = spark.createDataFrame(rows, "doc_id int, check string, status string, score int")
    got = risk.category_risks_long(long, risk.weights_table(spark)).collect()
    for r in got:
        weights = dims.CHECK_WEIGHTS[r.category]
        scores = {n: s for d, n, _, s in rows if d == r.doc_id}
        n = sum(round(w * 10) * scores[c] for c, w in weights.items())
        d = sum(round(w * 10) for w in weights.values())
        assert r.risk == (2 * n + d) // (2 * d)


def test_explode_checks(spark):
    df = spark.createDataFrame([("a", checks(logoConsistency=("pass", 3.0)))], schemas.struct(doc_id=schemas.S, checks=schemas.CHECKS))
    assert [tuple(r) for r in responses.explode_checks(df, ["doc_id"]).collect()] == [("a", "logoConsistency", "pass", 3.0)]


def test_independent_signals(spark):
    one = checks(logoConsistency=("suspicious", 3.0), editingTraces=("suspicious", 90.0))
    two = checks(logoConsistency=("suspicious", 3.0), layoutIntegrity=("suspicious", 90.0))
    df = spark.createDataFrame([(1, one), (2, two)], schemas.struct(i=schemas.I, checks=schemas.CHECKS))
    assert [(r.n_suspicious, r.counts_as_signal) for r in risk.independent_signals(df).orderBy("i").collect()] == [(1, False), (2, True)]


def test_statement_contract(spark):
    good = {
        "overallRisk": 1, "riskLabel": "LOW RISK", "confidence": 2, "summary": "s",
        "categories": {c: 0 for c in dims.CATEGORY_WEIGHTS},
        "balanceAnalysis": {k: None for k in ("openingBalance", "totalIncoming", "totalOutgoing", "calculatedClosingBalance",
                                              "documentClosingBalance", "difference")}
        | {"calculationConsistent": False, "evidence": ""},
        "transactionAnalysis": {"transactionCount": 3, "dateConsistency": "", "duplicateTransactions": [], "suspiciousTransactions": ["a"]},
        "limitations": [], "evidence": ["x"],
    }
    bad = json.loads(json.dumps(good))
    bad["transactionAnalysis"]["transactionCount"] = -1
    bad["balanceAnalysis"]["extra"] = 1
    bad["evidence"] = "x"
    del bad["limitations"]
    bad["categories"] = []
    rows = [("good", json.dumps(good)), ("bad", json.dumps(bad)), ("none", "7")]
    parsed = responses.parse_responses(spark.createDataFrame(rows, "k string, output_text string"))
    got = {(r.k, r.rule) for r in responses.violations(parsed, "statement", ["k"]).collect()}
    assert got == {
        ("bad", "value:transactionAnalysis.transactionCount"), ("bad", "unexpected:balanceAnalysis.*"),
        ("bad", "value:evidence"), ("bad", "missing:limitations"), ("bad", "type:categories"), ("none", "type:response"),
    }


def test_checks_that_look_right(spark):
    """Shapes in one text and typed values are a short way only: what they do not settle is looked at in full."""
    fine = {"status": "pass", "score": 0, "evidence": ""}
    answer = {
        "overallRisk": 1, "riskLabel": "LOW RISK", "confidence": 2, "summary": "s", "categories": {c: 0 for c in dims.CATEGORY_WEIGHTS},
        "checks": {n: fine for n in dims.CHECK_NAMES}, "limitations": [],
        "amountAnalysis": {"amount": None, "subtotal": 1, "taxAmount": 1.5, "totalAmount": 1e30, "calculatedTotal": None, "difference": 0,
                           "calculationConsistent": True, "evidence": ""},
    }
    first, second = dims.CHECK_NAMES[:2]
    forged = f"x, {first}: OBJECT<evidence: STRING, score: BIGINT, status: STRING>, y"
    changed = {
        "fine": {}, "whole": {first: fine | {"score": 7.0}}, "part": {first: fine | {"score": 7.5}}, "text": {first: fine | {"score": "7"}},
        "high": {first: fine | {"score": 101}}, "word": {first: fine | {"status": "ok"}}, "flag": {first: fine | {"status": True}},
        "more": {first: fine | {"z": 1}}, "less": {first: {"status": "pass", "score": 0}}, "none": {first: None}, "list": {second: []},
        "forged": {forged: 1, first: fine | {"evidence": 1}},
    }
    rows = [(k, json.dumps(answer | {"checks": answer["checks"] | c})) for k, c in changed.items()]
    parsed = responses.parse_responses(spark.createDataFrame(rows, "k string, output_text string"))
    got = {(r.k, r.rule) for r in responses.violations(parsed, "receipt", ["k"]).collect()}
    assert got == {
        ("part", "value:checks.*.score"), ("text", "value:checks.*.score"), ("high", "value:checks.*.score"),
        ("word", "value:checks.*.status"), ("flag", "value:checks.*.status"), ("more", "unexpected:checks.*.*"),
        ("less", "missing:checks.*.evidence"), ("none", "type:checks.*"), ("list", "type:checks.*"),
        ("forged", "value:checks.*.evidence"), ("forged", "unexpected:checks.*"),
    }


def _receipt(**changed):
    fine = {"status": "pass", "score": 0, "evidence": ""}
    return {
        "overallRisk": 1, "riskLabel": "LOW RISK", "confidence": 2, "summary": "s", "categories": {c: 0 for c in dims.CATEGORY_WEIGHTS},
        "checks": {n: fine for n in dims.CHECK_NAMES} | changed, "limitations": [],
        "amountAnalysis": {"amount": None, "subtotal": 1, "taxAmount": -1.5e3, "totalAmount": 1e30, "calculatedTotal": None, "difference": 0,
                           "calculationConsistent": True, "evidence": ""},
    }


def _rules(spark, texts, contract="receipt"):
    """What is found with the text the response was read from; without it the same must be found."""
    df = spark.createDataFrame(list(texts.items()), "k string, output_text string")
    with_text = responses.violations(responses.parse_responses(df, source="read"), contract, ["k"], source="read")
    found = sorted((r.k, r.rule) for r in with_text.collect())
    assert found == sorted((r.k, r.rule) for r in responses.violations(responses.parse_responses(df), contract, ["k"]).collect())
    return found


def test_wrong_checks_are_found_beside_others_of_their_name(spark):
    first, second = dims.CHECK_NAMES[:2]
    fine = {"status": "pass", "score": 0, "evidence": ""}
    texts = {
        "within": json.dumps(_receipt(**{first: fine | {"score": "7"}, second: fine | {first: fine}})),
        "beside": json.dumps(_receipt(**{first: fine | {"status": "ok"}}) | {"summary": fine, first: fine}),
    }
    assert _rules(spark, texts) == [
        ("beside", "unexpected:response.*"), ("beside", "value:checks.*.status"), ("beside", "value:summary"),
        ("within", "unexpected:checks.*.*"), ("within", "value:checks.*.score"),
    ]


def test_what_the_text_shows_is_not_taken_from_texts_repeats_or_escapes(spark):
    first = dims.CHECK_NAMES[0]
    fine, wrong = '{"status":"pass","score":0,"evidence":""}', '{"status":"pass","score":101,"evidence":""}'
    good = json.dumps(_receipt(), separators=(",", ":"))
    pair = f'"{first}":{fine}'
    assert good.count(pair) == 1
    texts = {
        "good": good, "spaced": json.dumps(_receipt(), indent=2), "turned": json.dumps(_receipt(), sort_keys=True), "fenced": f"```json\n{good}\n```",
        "prose": f'"{first}": 1 {good} "{first}": 1',
        "quoted": good.replace('"summary":"s"', '"summary":"a \\"' + first + '\\":{ \\\\"'),
        "last wrong": good.replace(pair, f'{pair},"{first}":{wrong}'), "last right": good.replace(pair, f'"{first}":{wrong},{pair}'),
        "spelt": good.replace(pair, f'{pair},"\\u{ord(first[0]):04x}{first[1:]}":{wrong}'),
        "word spelt": good.replace('"LOW RISK"', '"\\u004cOW RISK"'),
        "key ends so": good.replace(pair, f'"{first}":{wrong},"x\\"{first}":{fine}'),
        "whole": good.replace('"overallRisk":1', '"overallRisk":1.0'), "part": good.replace('"overallRisk":1', '"overallRisk":1.5'),
        "long": good.replace('"summary":"s"', '"summary":"' + "\\n" * 100_000 + '"').replace('"limitations":[]', '"limitations":[' + ",".join(['"\\t"'] * 50_000) + "]"),
        "no array": f"[{good}]", "none": "7", "missing": None,
    }
    score = "value:checks.*.score"
    assert _rules(spark, texts) == [
        ("key ends so", "unexpected:checks.*"), ("key ends so", score), ("last wrong", score), ("missing", "type:response"),
        ("no array", "type:response"), ("none", "type:response"), ("part", "value:overallRisk"), ("spelt", score),
    ]


def test_text_and_typed_evidence_of_statements(spark):
    good = {
        "overallRisk": 100, "riskLabel": "LOW RISK", "confidence": 0, "summary": "s", "categories": {c: 7 for c in dims.CATEGORY_WEIGHTS},
        "balanceAnalysis": {k: -1.5 for k in ("openingBalance", "totalIncoming", "totalOutgoing", "calculatedClosingBalance",
                                              "documentClosingBalance", "difference")}
        | {"calculationConsistent": True, "evidence": "e"},
        "transactionAnalysis": {"transactionCount": 3, "dateConsistency": "", "duplicateTransactions": ["a", "b"], "suspiciousTransactions": []},
        "limitations": [], "evidence": ["x"],
    }
    texts = {
        "good": json.dumps(good), "outer": json.dumps(good | {"evidence": "x"}),
        "inner": json.dumps(good | {"balanceAnalysis": good["balanceAnalysis"] | {"evidence": ["x"], "totalIncoming": "1"}}),
        "moved": json.dumps(good | {"categories": good["transactionAnalysis"], "transactionAnalysis": None}),
    }
    found = _rules(spark, texts, "statement")
    assert [f for f in found if f[0] != "moved"] == [
        ("inner", "value:balanceAnalysis.evidence"), ("inner", "value:balanceAnalysis.totalIncoming"), ("outer", "value:evidence"),
    ]
    assert [r for k, r in found if k == "moved"] == sorted(
        [f"missing:categories.{c}" for c in dims.CATEGORY_WEIGHTS] + ["type:transactionAnalysis"] + ["unexpected:categories.*"] * 4
    )


def test_nothing_is_in_doubt_where_all_is_right(spark):
    changed = {"right": _receipt(), "one": _receipt(**{dims.CHECK_NAMES[3]: {"status": "pass", "score": 7.5, "evidence": ""}})}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in changed.items()], "k string, text string")
    doubts = df.select("k", responses._doubts(F.col("text"), responses.CONTRACTS["receipt"]).alias("d"))
    assert {r.k: [n for n in r.d if n not in ("checks", "categories", "amountAnalysis")] for r in doubts.collect()} == {
        "right": [], "one": [dims.CHECK_NAMES[3], "score"],
    }


def test_screening_flow(spark):
    answer = {"overallRisk": 50, "riskLabel": "HIGH RISK", "confidence": 80, "summary": "ozet",
              "checks": {"logoConsistency": {"status": "pass", "score": 100, "evidence": ""}},
              "amountAnalysis": {"evidence": "tutar"}}
    manifest = spark.createDataFrame(
        [("1", "pdf", "a.pdf", "akbank", None), ("2", "video", "v", None, None), ("3", "statement", "s", "ziraat", None),
         ("4", "image", "i", "garanti", None), ("5", "pdf", "x", None, None), ("6", "document", "d", None, dims.UNSUPPORTED_TYPE)],
        "doc_id string, type string, file_name string, bank string, error string",
    )
    texts = {"1": json.dumps(answer), "2": "```json\n" + json.dumps(answer) + "\n```",
             "3": '{"overallRisk":"46","riskLabel":"HIGH RISK","evidence":["a","b"],"balanceAnalysis":{"openingBalance":1}}',
             "4": "[]"}
    answers = spark.createDataFrame(list(texts.items()), "doc_id string, output_text string")
    got = {r.doc_id: r for r in screen_requests(manifest, answers, intake.template_names(spark)).collect()}
    assert (got["1"].score, got["1"].risk_label, got["1"].reference, got["1"].evidence) == (30.0, "MODERATE RISK", "akbank.pdf", ["tutar"])
    assert (got["2"].score, got["2"].risk_label, got["2"].reference) == (50.0, "HIGH RISK", None)
    assert (got["3"].score, got["3"].suspicious, got["3"].evidence, got["3"].reference) == (46.0, True, ["a", "b"], None)
    assert got["3"].balance_analysis.openingBalance == 1.0 and got["3"].checks is None
    assert (got["4"].score, got["4"].evidence) == (0.0, [dims.EVIDENCE_DEFAULT["receipt"]])
    assert (got["5"].success, got["5"].error) == (False, dims.EMPTY_ANSWER)
    assert (got["6"].success, got["6"].error) == (False, dims.UNSUPPORTED_TYPE)


@pytest.mark.parametrize(
    "lines, calculated, difference, consistent",
    [
        ([("subtotal", 100), ("vat", 20), ("fee", 5), ("discount", 10), ("shown_total", 115)], 115, 0, True),
        ([("subtotal", 100), ("vat", 20), ("fee", 5), ("discount", 10), ("shown_total", 120)], 115, -5, False),
        ([("subtotal", 100), ("vat", 10), ("vat", 10), ("commission", 1), ("shown_total", 121.01)], 121, -0.01, True),
        ([("subtotal", 100), ("vat", 20)], None, None, False),
        ([("vat", 20), ("shown_total", 120)], None, None, False),
        ([("subtotal", 100), ("vat", None), ("shown_total", 120)], None, None, False),
    ],
)
def test_invoice(spark, lines, calculated, difference, consistent):
    df = spark.createDataFrame([("d", k, None if a is None else str(a)) for k, a in lines], "doc_id string, kind string, a string")
    df = df.select("doc_id", "kind", F.col("a").cast("decimal(18,2)").alias("amount"))
    r = invoice.reconcile_invoice(df).first()
    number = lambda x: None if x is None else float(x)
    assert (number(r.calculated), number(r.difference), r.consistent) == (calculated, difference, consistent)
