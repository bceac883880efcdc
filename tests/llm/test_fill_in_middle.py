import hashlib
import random
import re

from pyspark.sql import functions as F

from docrisk.llm import fill_in_middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def brute(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(spark, rows, schema=SCHEMA):
    return M.restore(M.transform(spark.createDataFrame(rows, schema))).collect()


def test_against_loops(spark):
    rng = random.Random(5)
    pieces = ["a", " ", "  ", "\n", "\t\r\n", "bé", "𐐀", "\x00", "$1", "\\", "<", "<P", ">", "S>", "{2}", " ", " ", "\x1c", "日本"]
    texts = ["", None, " ", "\n\n", "a", " a", "a ", " a b  ", "x<P>y", "<S>", "a <M> b", "P><S", "<", "<S"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)] + [(None, "a b c d"), (None, None)]
    got = rows_of(spark, rows)
    assert len(got) == len(rows)
    forms = set()
    for r in got:
        text = r.document.text
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.document.doc_id, text), (r, text)
        assert r.restored == (text or "")
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}


def test_very_long_texts(spark):
    """Hundreds of thousands of units, and one unit of megabytes, in one match without a deep stack."""
    texts = ["word " * 400_000, "x" * 3_000_000, " " * 2_000_000 + "y", "\n" * 1_000_000, ("é\t" * 200_000) + "end"]
    rows = [(k * len(texts) + i, t) for k in range(4) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.digest(M.transform(df)).collect()
    for r in got:
        want = brute(r.doc_id, rows[r.doc_id][1])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == want[:4]
        assert r.output_sha256 == hashlib.sha256(want[4].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(rows[r.doc_id][1].encode()).hexdigest()
    assert {r.form for r in got} > {"plain"}


def test_empty_tables_repeats_and_clashing_columns(spark):
    assert rows_of(spark, []) == []
    schema = "doc_id long, text string, t int, n string, form string, output string, document int"
    same = rows_of(spark, [(4, "a b c d e", 1, "n", "f", "o", 2)] * 3, schema)
    assert len(same) == 3 and len(set(same)) == 1
    assert same[0].document.n == "n" and same[0].document.document == 2 and same[0].restored == "a b c d e"


def test_parameters(spark):
    df = spark.createDataFrame([(i, f"w{i} x y z") for i in range(400)], SCHEMA)
    count = lambda **p: {r.form: r.n_ for r in M.transform(df, **p).groupBy("form").agg(F.count("*").alias("n_")).collect()}
    assert count(rate=0) == {"plain": 400}
    assert count(rate=100, suffix_first=100) == {"spm": 400} and count(rate=100, suffix_first=0) == {"psm": 400}
    other = {r.document.doc_id: r.output for r in M.transform(df, seed=7, rate=100).collect()}
    assert sum(r.output != other[r.document.doc_id] for r in M.transform(df, rate=100).collect()) > 300


def test_no_shuffle_and_no_python(spark):
    plan = M.digest(M.transform(spark.createDataFrame([(1, "a")], SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
