import random
import re

import numpy as np

from docrisk.llm import decontaminate as D
from docrisk.llm import words as W
from docrisk.llm.queries import op2_decontaminate


def normal(text):
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def best(piece, text):
    """Fewest edits of a piece anywhere in a text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(piece):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def search(texts, items):
    ix, fold, sieve = D.index(items), W.folding(), np.zeros(1 << D.SIEVE, bool)
    sieve[(ix.hashes >> np.uint64(64 - D.SIEVE)).astype(np.int64)] = True
    return D.leaks(texts, ix, fold, sieve), ix


def test_edited_items_are_found_and_others_not():
    rng = random.Random(1)
    letters = "abcdefghij klmno"
    items = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(30, 140)))) for k in range(12)]
    texts = []
    for _ in range(60):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 80)))]
        piece = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 18)):
            at = rng.randrange(len(piece))
            piece[at : at + rng.randrange(0, 2)] = [rng.choice(letters) for _ in range(rng.randrange(0, 2))]
        texts.append(parts[0] + " " + "".join(piece) + " " + "".join(rng.choice(letters) for _ in range(rng.randrange(0, 80))))
    found, ix = search(texts, items)
    got = {(d, k): n for d, k, _, _, n in found}
    for d, text in enumerate(texts):
        for k, item in items:
            counts = [(best(piece, normal(text)), min(int(D.RATE * len(piece)), (len(piece) - D.Q) // D.Q)) for piece in cut(normal(item))]
            close = [n for n, allowed in counts if n <= allowed]
            assert ((d, k) in got) == bool(close), (text, item, counts)
            if close:
                assert got[d, k] == min(close)


def cut(item):
    """Pieces of an item by the rule of the module."""
    last = len(item) - D.PIECE
    return [item[c : c + D.PIECE] for c in range(0, last, D.STRIDE)] + [item[last:]] if last > 0 else [item]


def test_quotations_of_110_characters_of_any_item():
    """Wherever a verbatim quotation begins, and however long its item is, it is found."""
    rng = random.Random(4)
    items = [(k, "".join(rng.choice("abcdefghijklmnop") for _ in range(n))) for k, n in enumerate((110, 125, 140, 151, 300, 1000))]
    texts, want = [], []
    for k, item in items:
        for at in {*range(0, len(item) - 109, 7), len(item) - 110}:
            texts.append("before " + item[at : at + 110] + " behind")
            want.append((len(texts) - 1, k))
    found, _ = search(texts, items)
    assert [(d, k) for d, k, *_ in found] == want


def test_spans_parts_and_neighbouring_texts():
    item = " ".join(f"word{i} of" for i in range(80))
    quoted = " ".join(f"word{i} of" for i in range(30, 60))
    texts = ["Intro. " + quoted.upper().replace(" ", "  ") + "! Outro", quoted[:80], quoted[80:160], "word3 of"]
    found, _ = search(texts, [(9, item)])
    assert [(d, k) for d, k, *_ in found] == [(0, 0)]
    _, _, begin, end, n = found[0]
    # pieces with edits in the margin count, too
    assert n == 0 and normal(quoted)[D.STRIDE : -D.STRIDE] in normal(texts[0][begin:end])


def test_query_finds_all_verbatim_items(spark, sf_dir):
    items = {r.item_id: normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    texts = {r.doc_id: normal(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in op2_decontaminate(spark, sf_dir).collect()}
    assert {(d, k) for d, t in texts.items() for k, i in items.items() if i in t} <= got
    for d, k in got:
        w = items[k].split()
        assert any(" ".join(w[i : i + 5]) in texts[d] for i in range(len(w) - 4))


def test_edge_cases(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog again and again until it sleeps"
    rows = [(1, "x " + item.upper() + ". y", "a"), (2, None, "b"), (3, "", "c"), (None, item, "d"), (1, "x " + item.upper() + ". y", "a"), (4, "clean " * 30_000 + item, "e"), (5, "clean " * 30_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, None, 0), (3, "", 0), (4, "tiny", 0), (None, "some other item of the benchmark here", 0)], "item_id long, text string, edits int")
    got = sorted((r.doc_id or 0, r.item_id, r.edits) for r in D.find(docs, bench).distinct().collect())
    assert got == [(0, 1, 0), (1, 1, 0), (4, 1, 0)]
    clean = D.remove(docs, bench)
    assert clean.columns == docs.columns and sorted(r.item_id for r in clean.collect()) == ["b", "c", "f"]
    assert D.find(docs.limit(0), bench).collect() == [] and D.find(docs, bench.limit(0)).collect() == []
    assert D.remove(docs, bench.limit(0)).count() == len(rows)
    monkeypatch.setattr(D, "BLOCK", 40)
    assert sorted((r.doc_id or 0, r.item_id, r.edits) for r in D.find(docs, bench).distinct().collect()) == got
