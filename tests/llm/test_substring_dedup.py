import hashlib
import random
import re

from docrisk.llm import substring_dedup as S
from docrisk.llm.queries import op9_substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Result per (doc_id, text): number of words, of removed words, and the kept words' hash."""
    first, out = {}, {}
    for doc_id, text in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        w = WORD.findall(text)
        gone = [False] * len(w)
        for i in range(len(w) - S.SPAN + 1):
            key = tuple(w[i : i + S.SPAN])
            if first.setdefault(key, (doc_id, i)) < (doc_id, i):
                gone[i : i + S.SPAN] = [True] * S.SPAN
        kept = " ".join(a for a, b in zip(w, gone) if not b)
        out[doc_id, text] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_query_agrees_with_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {k[0]: v for k, v in brute(docs).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op9_substring_dedup(spark, sf_dir).collect()}
    assert got == want


def test_overlaps_edits_and_periodic_texts(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(400)]
    rows = []
    for i in range(60):
        a = rng.randrange(300)
        w = base[a : a + rng.randrange(15, 90)]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        if i % 3 == 0:
            b = rng.randrange(300)
            w += base[b : b + rng.randrange(10, 60)]
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(w)))
    rows += [(70, "la " * 100), (71, "la " * 30 + "lo " * 25), (72, "a b " * 40), (73, "b a " * 40), (74, " ".join(base) + " " + " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, next(t for i, t in rows if i == r.doc_id)): (r.n_words, r.n_removed, r.kept_sha256) for r in S.digest(S.remove_repeats(docs)).collect()}
    assert got == brute(rows)


def test_edge_cases(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [
        (1, passage, "x"), (2, "start " + passage + "\nend", "y"), (3, None, None), (4, "", "z"), (5, " \n\t", "z"),
        (2, "start " + passage + "\nend", "y"), (None, passage, "n"), (6, long, "l"), (7, "own " + long, "l"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = S.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    by = {(r.document.doc_id, r.document.kept): r for r in got}
    assert by[1, "x"].n_removed == 0 and by[1, "x"].kept == passage
    assert by[2, "y"].kept == "start end" and [tuple(s) for s in by[2, "y"].removed] == [(1, 26)]
    assert by[3, None].kept is None and by[3, None].n_words == 0
    assert by[4, "z"].n_words == 0 and by[5, "z"].kept == " \n\t"
    assert by[None, "n"].n_removed == 0
    assert by[6, "l"].n_removed == 0 and by[7, "l"].kept.strip() == "own"
    assert S.remove_repeats(docs.limit(0)).collect() == []
