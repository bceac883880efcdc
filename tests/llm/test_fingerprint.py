import hashlib
import random

from pyspark.sql import functions as F

from docrisk.llm import fingerprint as P

SCHEMA = "doc_id long, text string"


def brute_vector(text):
    """The lanes as the module describes them, by plain loops."""
    lanes = [0] * (P.IDENTITY + 1 + P.LIKENESS)
    for line in (text or "").split("\n"):
        line = line.strip(" \t\x0b\x0c\r")
        if not line:
            continue
        digest = hashlib.sha256(line.encode()).hexdigest()
        for i in range(P.IDENTITY):
            lanes[i] += int(digest[8 * i : 8 * i + 8], 16)
        words = line.replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        for a, b in zip(words, [*words[1:], None], strict=True):
            h = int(hashlib.md5((a if b is None else f"{a} {b}").encode()).hexdigest()[: 2 * P.BYTES], 16)
            lanes[P.IDENTITY] += 1
            for s in range(8):
                for f in range(P.BYTES):
                    lanes[P.IDENTITY + 1 + s * P.BYTES + f] += h >> (8 * f + s) & 1
    return [x % 2**32 for x in lanes]


def vectors(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return [r.v for r in df.select("doc_id", P.vector(F.col("text")).alias("v")).orderBy("doc_id").collect()]


def some_text(rng, words, lines=3):
    return "\n".join(" ".join(f"w{rng.randrange(4000)}é" for _ in range(words // lines)) for _ in range(lines))


TEXTS = ["", None, " \n\t\n", "a", "a b", "a\tb\r\n\n c  d ", "x " * 1000 + "\ny", "𐐀 ü\n𐐀 ü", "a b\nc d", "c d\na b", "one"]


def test_vectors_against_loops(spark):
    rng = random.Random(1)
    texts = TEXTS + [some_text(rng, n) for n in (9, 255, 256, 300, 2000)]
    assert vectors(spark, texts) == [brute_vector(t) for t in texts]


def test_order_of_paragraphs_does_not_matter_but_their_number_does(spark):
    a, b, c, d, e = vectors(spark, ["p q\nr s\nt", "t\np q\nr s", "p q\nr s", "p q\nr s\nt\nt", "p r\nq s\nt"])
    assert a == b and len({tuple(x) for x in (a, c, d, e)}) == 4


def test_insertion_and_deletion(spark):
    whole, head, tail = "a b\nc d\ne", "a b", "e\nc d"
    df = spark.createDataFrame([(whole, head, tail)], "w string, h string, t string")
    w, h, t = (P.vector(F.col(c)) for c in "wht")
    row = df.select(w.alias("w"), P.plus(h, t).alias("sum"), P.minus(w, t).alias("rest"), h.alias("h"), P.minus(h, w).alias("under"), P.plus(P.minus(h, w), w).alias("back")).first()
    assert row["sum"] == row["w"] and row["rest"] == row["h"] == row["back"]
    assert all(0 <= x < 2**32 for x in row["under"])


def run(spark, rows, schema=SCHEMA):
    return P.edited(spark.createDataFrame(rows, schema))


def brute_edits(rows):
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    found = {}
    for k, (none, i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        m = len(t) // 4
        found[None if none else i, t] = t[: len(t) - m] + following[:m]
    return found


def test_edits_against_loops(spark):
    rng = random.Random(2)
    rows = [(i * 7 - 300, some_text(rng, rng.choice([1, 3, 30, 300]), rng.choice([1, 2, 5]))) for i in range(200)]
    rows += [(5000 + i, t) for i, t in enumerate(TEXTS)]
    got = run(spark, rows).collect()
    want = brute_edits(rows)
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        assert r.edited_text == want[r.doc_id, text] and r.n_chars == len(text)
        assert r.vector == brute_vector(text) and r.edited_vector == brute_vector(r.edited_text)
    following = {a: b for a, b in zip(sorted(dict(rows)), [*sorted(dict(rows))[1:], min(dict(rows))], strict=True)}
    assert all(r.next_vector == brute_vector(dict(rows)[following[r.doc_id]]) for r in got)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "n o p q r s t u", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 3), (3, None, 4), (None, None, 5), (1, "x", 6)]
    got = run(spark, rows, "doc_id long, text string, id int").collect()
    assert len(got) == 6
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert len(by) == 5 and by[3, 11].vector == brute_vector("a b c d e f")
    # ids in order, those without one last, the first behind the last
    assert by[1, 1].edited_text == "x"
    assert all(r.edited_vector == brute_vector(r.edited_text) for r in got)
    alone = run(spark, [(9, "abcdefgh")]).first()
    assert alone.edited_text == "abcdefab" and alone.next_vector == alone.vector
    assert run(spark, []).collect() == [] and P.digest(run(spark, [])).columns[:3] == ["doc_id", "n_chars", "edited_sha256"]


def test_digest_and_likeness(spark):
    rng = random.Random(3)
    rows = [(i, some_text(rng, 400, 8)) for i in range(60)]
    got = P.digest(run(spark, rows)).collect()
    edited = {r.doc_id: r for r in run(spark, rows).collect()}
    for r in got:
        assert r.edited_sha256 == hashlib.sha256(edited[r.doc_id].edited_text.encode()).hexdigest()
        assert len(r.fingerprint) == 8 * len(edited[r.doc_id].vector) and int(r.fingerprint[:8], 16) == edited[r.doc_id].vector[0]
    # three quarters of the pairs are shared with the edited text, none with the next
    assert 0.65 < sum(r.near_edited for r in got) / 60 < 0.85 and min(r.near_edited for r in got) > 0.5
    assert sum(r.near_next for r in got) / 60 < 0.12 and max(r.near_next for r in got) < 0.5
    same = P.digest(run(spark, [(1, "a b\nc"), (2, "a b\nc"), (3, "")])).collect()
    by = {r.doc_id: r for r in same}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0
    assert by[2].near_next == 0.0 and by[3].near_edited == 1.0


def test_no_python_and_one_exchange_of_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P.digest(P.edited(docs))._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Python" not in plan and "Arrow" not in plan
