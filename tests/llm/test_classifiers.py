"""Quality, toxicity and language: accuracy on rows that learning never saw, and odd texts."""

import zlib

import numpy as np
import pytest

from docrisk.llm import language, quality, toxicity
from docrisk.llm.queries import op3_quality, op6_language, op7_toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def held(doc_id, of, rest):
    return zlib.crc32(str(doc_id).encode()) % of == rest


def test_quality_on_held_out_rows(spark, labels):
    rows = op3_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    known = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id].quality for r in known]) >= 0.97


def test_toxicity_on_held_out_rows(spark, labels):
    rows = op7_toxicity(spark, SF).collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    known = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id].toxic for r in known]) >= 0.93


def test_language_on_held_out_rows(spark):
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op6_language(spark, SF).collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == want[r.doc_id] for r in rows if r.held_out]) >= 0.98


def test_learning_is_repeatable_and_reads_no_held_out_row(spark):
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    one = toxicity.learn(docs, marks)
    upset = marks.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    two = toxicity.learn(docs.repartition(7), upset)
    assert (one.buckets == two.buckets).all() and np.allclose(one.weights, two.weights) and one.bias == two.bias


def test_non_negative_risk_learns_from_positives_and_the_rest():
    rng = np.random.default_rng(0)

    def text(bad):
        count = np.bincount(rng.integers(0, 500, 80), minlength=500)
        at = np.flatnonzero(count)
        return (80 + bad, np.append(at, 999) if bad else at, np.append(count[at], bad) if bad else count[at])

    positive = [text(int(rng.integers(1, 6))) for _ in range(200)]
    unlabelled = [text(int(rng.integers(1, 6)) if rng.random() < 0.1 else 0) for _ in range(1000)]
    model = toxicity.fit(positive, unlabelled, 0.1)
    assert model.buckets.tolist() == [999] and model.weights[0] > 0 and model.bias < 0
    empty = toxicity.fit([], unlabelled, 0.1)
    assert not len(empty.buckets) and empty.bias < 0


def test_labels_of_confirmed_cases_alone(spark, labels):
    """Without clean labels the prior is estimated, and toxic documents are still found."""
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    confirmed = marks.where("toxic = 1")
    scored = toxicity.digest(toxicity.score(docs, toxicity.learn(docs, confirmed))).collect()
    known = [(r.predicted, labels[r.doc_id].toxic) for r in scored if r.held_out and r.doc_id in labels]
    assert np.mean([p == t for p, t in known]) >= 0.9 and np.mean([p for p, t in known if t]) >= 0.5
    given = toxicity.learn(docs, confirmed, prior=marks.agg({"toxic": "avg"}).first()[0])
    assert len(given.buckets)


def test_share_of_positives():
    rng = np.random.default_rng(1)

    def text(bad):
        at = np.unique(np.append(rng.integers(0, 500, 80), rng.integers(600, 620, 3)) if bad else rng.integers(0, 500, 80))
        return (80, at, np.ones(len(at), np.int64))

    for prior in (0.02, 0.1, 0.4):
        unlabelled = [text(rng.random() < prior) for _ in range(3000)]
        found = toxicity.share_of_positives([text(True) for _ in range(600)], unlabelled)
        assert 0.6 * prior <= found <= 1.5 * prior, (prior, found)
    assert toxicity.share_of_positives([text(True)], unlabelled) == 0.0


def test_cross_parsing_counts_longest_phrases():
    model = language.fit({"xx": ["abcabd"], "yy": ["aaaa"]})
    fold = language.letter_folding()
    classes = language.letter_classes(model)
    # in xx: abca, abd, d; in yy: a, b, c, aa, b, d, d ("bcabd" ends as two phrases in xx: bcabd, d)
    bits, lettered = language.costs(["abcabdd", "123", "aaaaaaaaa"], model, fold, classes)
    n = [len("abcabdd") + 1, 0, 10]
    phrases = bits * np.array([[x] for x in (n[0], 1, n[2])]) / model.bits
    assert lettered.tolist() == [True, False, True]
    # the line feed behind each text, folded to a space, is a phrase of its own where the sample lacks it
    assert phrases[0, 0] < phrases[0, 1] and phrases[2, 1] < phrases[2, 0]


def greedy(text, sample):
    """Longest phrases of a text that occur in a sample, from left to right."""
    phrases, at = 0, 0
    while at < len(text):
        to = at + 1
        while to < len(text) and text[at : to + 1] in sample:
            to += 1
        phrases, at = phrases + 1, to
    return phrases


def test_phrases_of_whole_texts_by_brute_force():
    """Long and periodic texts, letters of all planes, several texts at once: phrases cross blocks."""
    rng = np.random.default_rng(5)
    adlam = [chr(c) for c in range(0x1E922, 0x1E930)]
    samples = {"xx": "".join(rng.choice(list("abc "), 900)), "yy": "a" * 700 + " b", "zz": "".join(rng.choice([*adlam, " "], 900))}
    samples = {k: " ".join(v.split()) for k, v in samples.items()}
    model = language.fit({k: [v] for k, v in samples.items()})
    texts = ["".join(rng.choice(list("abcd "), 3000)), "a" * 5000, "ab" * 1500, "".join(rng.choice([*adlam, "q", " "], 2000)), "", samples["xx"][100:800], "a" * 255, "a" * 256]
    texts = [" ".join(x.split()) for x in texts]
    bits, _ = language.costs(texts, model, language.letter_folding(), language.letter_classes(model))
    for k, (name, sample) in enumerate(samples.items()):
        for t, text in enumerate(texts):
            # a line feed behind each text is read as a space, in samples as well
            want = greedy(text + " ", sample + " ") * model.bits[k] / (len(text) + 1)
            assert np.isclose(bits[t, k], want), (name, t)


def test_letters_of_every_plane(spark):
    """A text goes to the language of its letters where these lie above U+FFFF, in either case."""
    lower = " ".join("".join(chr(0x1E922 + (i * j) % 34) for j in range(1, 7)) for i in range(1, 200))
    upper = lower.translate({c: c - 34 for c in range(0x1E922, 0x1E944)})
    docs = spark.createDataFrame([(1, lower, "ff"), (2, "the of and to in " * 50, "en"), (3, lower, None), (4, upper, None)], "doc_id long, text string, lang string")
    model = language.fit({"ff": [lower], "en": ["the of and to in " * 50]})
    assert {r.document.doc_id: r.lang_pred for r in language.predict(docs, model).collect()} == {1: "ff", 2: "en", 3: "ff", 4: "ff"}


def test_odd_texts_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n ", "c"), (4, "12 34", "d"), (None, "the of and", "e"), (5, "the " * 50_000, "f"), (5, "the " * 50_000, "f"), (6, "日本語 😀", "g")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score string")
    q, t, g = quality.learn(docs, marks), toxicity.learn(docs, marks), language.learn(docs)
    for scored in (quality.score(odd, q), toxicity.score(odd, t), language.predict(odd, g)):
        got = scored.collect()
        assert sorted(r.document.score for r in got) == sorted(r[2] for r in rows) and all(0 <= r.score <= 1 for r in got)
    named = {r.document.score: r.lang_pred for r in language.predict(odd, g).collect()}
    assert [named[x] for x in "abcd"] == ["und"] * 4 and named["g"] != "und"
    assert {r.held_out for r in quality.digest(quality.score(odd, q)).where("doc_id is null").collect()} == {False}
    empty = odd.limit(0)
    for scored in (quality.score(empty, q), toxicity.score(empty, t), language.predict(empty, g)):
        assert scored.collect() == []


def test_learning_from_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").selectExpr("*", "cast(null as string) as lang")
    marks = spark.createDataFrame([(None, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.digest(toxicity.score(docs, toxicity.learn(docs, marks))).collect()} == {0}
    assert all(0 <= r.score <= 1 for r in quality.digest(quality.score(docs, quality.learn(docs, marks.limit(0)))).collect())
    assert {(r.lang_pred, r.score) for r in language.digest(language.predict(docs, language.learn(docs))).collect()} == {("und", 0.0)}
