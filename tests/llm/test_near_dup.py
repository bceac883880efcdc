import random

import numpy as np
import pytest

from docrisk.llm import near_dup as N
from docrisk.llm import words as W
from docrisk.llm.components import components
from docrisk.llm.queries import op1_near_dup
from docrisk.llm.scratch import Shelf


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_distances_are_edit_distances():
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(150):
        a = rng.integers(0, 25, rng.integers(0, 50)).tolist()
        b = list(a)
        for _ in range(rng.integers(0, 12)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = [int(x) for x in rng.integers(0, 25, rng.integers(0, 2))]
        pairs.append((np.array(a, np.int32), np.array(b, np.int32)))
    most = rng.integers(0, 25, len(pairs))
    want = [edits(a.tolist(), b.tolist()) for a, b in pairs]
    assert N.distances(pairs, most).tolist() == [d if d <= m else -1 for d, m in zip(want, most)]


def test_sketch_keeps_text_order_and_occurrence():
    h = W.words([" ".join(f"w{i}" for i in range(60))]).hashes()
    assert (N.sketch(h) == N.sketch(h.copy())).all()
    swapped = np.concatenate([h[30:], h[:30]])
    plain = {int(x) for x in N.sketch(h)}
    assert sum(int(x) in plain for x in N.sketch(swapped)) < 0.5 * len(plain)
    repeats = N.labelled(np.array([5, 7, 5, 5], np.uint64))
    assert len(set(repeats.tolist())) == 4


#: Least share of pairs that meet, by edit similarity.
RECALL = {0.8: 0.3, 0.85: 0.65, 0.9: 0.9, 0.95: 0.98}


@pytest.mark.parametrize("n", [10, 20, 50, 100, 300])
@pytest.mark.parametrize("similarity", RECALL)
def test_recall_by_length_and_similarity(n, similarity):
    """Pairs of any length at an edit similarity, by edits of all kinds at any places, that share a value."""
    rng = np.random.default_rng(n)
    tried = met = 0
    for _ in range(150):
        a = rng.integers(0, 2**62, n).astype(np.uint64)
        b = a.tolist()
        for _ in range(int((1 - similarity) * n + 1e-9)):
            at = int(rng.integers(0, len(b)))
            kind = rng.integers(0, 4)
            b[at : at + (kind != 1)] = [] if kind == 0 else [int(rng.integers(0, 2**62))]
        b = np.array(b, np.uint64)
        if edits(a.tolist(), b.tolist()) > (1 - N.LEAST) * max(n, len(b)) + 1e-9:
            continue
        tried += 1
        met += bool(set(N.sketch(a).tolist()) & set(N.sketch(b).tolist()))
    assert tried > 50 and met >= RECALL[similarity] * tried


def test_pairs_that_share_four_fifths_of_their_windows_always_meet():
    rng = np.random.default_rng(3)
    for n in range(6, 400, 7):
        a = rng.integers(0, 2**62, n).astype(np.uint64)
        b = np.concatenate([a, rng.integers(0, 2**62, n // 5).astype(np.uint64)])
        assert set(N.sketch(a).tolist()) & set(N.sketch(b).tolist())


def _share(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_groups(spark):
    rng = random.Random(2)
    one, two, hot = _share(rng, 200), _share(rng, 12), _share(rng, 40)
    rows = [(10, " ".join(one))]
    for i in range(11, 60):
        w = list(one)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(70, " ".join(two)), (71, "\n".join(two) + " more"), (72, " ".join(two[:3])), (73, "  ".join(two[:3])), (74, " ".join(two[:2]))]
    # unrelated texts that share a passage
    rows += [(100 + i, " ".join(_share(rng, 80) + hot + _share(rng, 60))) for i in range(40)]
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: 10 for i in range(10, 60)} | {70: 70, 71: 70, 72: 72, 73: 72, 74: 74} | {100 + i: 100 + i for i in range(40)}
    assert got == want


def test_residual_leaders_lose_no_link(spark):
    """Texts that share every value but are duplicates only of some others."""
    rng = random.Random(3)
    base = _share(rng, 100)
    texts = {1: base}
    for i, n in ((2, 30), (3, 32), (4, 60), (5, 61)):
        texts[i] = base[: 100 - n] + _share(random.Random(n), n)
    texts[3] = texts[2][:98] + ["y", "z"]
    texts[5] = texts[4][:98] + ["y", "z"]
    words = {i: (W.words([" ".join(t)]).hashes() >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist() for i, t in texts.items()}
    members = spark.createDataFrame([(7, i) for i in texts], "value long, id long")
    table = spark.createDataFrame(list(words.items()), "id long, words array<int>")
    near = {(i, j) for i in texts for j in texts if i < j and edits(texts[i], texts[j]) <= 20}
    assert near == {(2, 3), (4, 5)}
    assert {r.id: r.class_id for r in N.groups(members, table, Shelf(spark)).collect()} == {2: 2, 3: 2, 4: 4, 5: 4}


def test_groups_are_the_components_of_all_links_of_a_value(spark):
    """One value shared by texts at all distances, so that many fail a leader closely."""
    rng = random.Random(8)
    base = [_share(rng, 40) for _ in range(3)]
    texts = {}
    for i in range(1, 60):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 16)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        texts[i] = w
    words = {i: (W.words([" ".join(t)]).hashes() >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist() for i, t in texts.items()}
    label = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and edits(texts[i], texts[j]) <= 8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    members = spark.createDataFrame([(v, i) for i in texts for v in (7, 8 + i % 2)], "value long, id long")
    got = {r.id: r.class_id for r in N.groups(members, spark.createDataFrame(list(words.items()), "id long, words array<int>"), Shelf(spark)).collect()}
    assert {i: got.get(i, i) for i in texts} == label


class Counting(Shelf):
    """Counts the pairs that were compared."""

    compared = 0

    def put(self, name, df):
        table = super().put(name, df)
        if table.columns == ["a", "b", "near", "within"]:
            self.compared += table.count()
        return table


@pytest.mark.parametrize("large, back", [(32, 16), (2, 1)])
def test_texts_that_quote_one_passage_are_not_all_compared(spark, monkeypatch, large, back):
    """Texts 60 % alike by one passage, which fail each other closely, with some groups among them: all links
    are found, by few comparisons."""
    monkeypatch.setattr(N, "LARGE", large, raising=False)
    monkeypatch.setattr(N, "BACK", back, raising=False)
    rng = random.Random(5)
    passage, texts, label = [f"p{i}" for i in range(60)], {}, {}
    for i in range(1, 241):
        texts[i] = passage + [f"w{rng.randrange(10**6)}" for _ in range(40)]
        label[i] = i
    # one group of 50 and ten of 3; members lack other words than their first text
    for first, size in [(20, 50), *((k, 3) for k in range(80, 180, 10))]:
        for i in range(first + 1, first + size):
            texts[i] = list(texts[first])
            for k in rng.sample(range(100), 6):
                texts[i][k] = f"x{rng.randrange(10**6)}"
            label[i] = first
    words = {i: (W.words([" ".join(t)]).hashes() >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist() for i, t in texts.items()}
    members = spark.createDataFrame([(v, i) for i in texts for v in (7, 8 + i % 2)], "value long, id long")
    shelf = Counting(spark)
    got = {r.id: r.class_id for r in N.groups(members, spark.createDataFrame(list(words.items()), "id long, words array<int>"), shelf).collect()}
    assert {i: got.get(i, i) for i in texts} == label
    assert shelf.compared <= 10 * len(texts)


def test_all_texts_of_an_id_are_compared(spark):
    rng = random.Random(6)
    base = _share(rng, 100)
    texts = [(i, base[:55] + [f"y{rng.randrange(10**6)}" for _ in range(45)]) for i in (1, 2, 2, 3)]
    texts.append((4, texts[2][1][:95]))
    rows = [(i, (W.words([" ".join(t)]).hashes() >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()) for i, t in texts]
    members = spark.createDataFrame([(7, i) for i in (1, 2, 3, 4)], "value long, id long")
    got = {r.id: r.class_id for r in N.groups(members, spark.createDataFrame(rows, "id long, words array<int>"), Shelf(spark)).collect()}
    assert got == {2: 2, 4: 2}


def test_components_of_chain_star_and_ring(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(30)] + [(300, 301), (301, 302), (302, 300)]
    got = {r.id: r.class_id for r in components(spark.createDataFrame(edges, "a long, b long"), Shelf(spark), "c").collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in [100, *range(200, 230)]} | {300: 300, 301: 300, 302: 300}


def test_edge_cases(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [
        (5, "a b c", "p"), (3, "a  b\nc", "q"), (3, "a  b\nc", "q"), (None, "a b c", "r"), (8, None, "s"), (9, None, "t"),
        (10, "", "u"), (11, " \n", "v"), (12, long, "w"), (13, long + " end", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.class_id) for r in N.classes(docs).collect())
    assert got == [
        (False, 3, 3), (False, 3, 3), (False, 5, 3), (False, 8, 8), (False, 9, 9), (False, 10, 10), (False, 11, 10),
        (False, 12, 12), (False, 13, 12), (True, 0, None),
    ]
    kept = N.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.kept) for r in kept.collect()) == [(0, "r"), (3, "q"), (8, "s"), (9, "t"), (10, "u"), (12, "w")]
    assert N.classes(docs.limit(0)).collect() == []


@pytest.mark.parametrize("least", [0.8])
def test_query_against_brute_force(spark, sf_dir, least):
    """Every pair with so many shared five-word windows is in one class, every class is connected by
    pairs of so high an edit similarity."""
    texts = {r.doc_id: r.text.split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    label = {r.doc_id: r.class_id for r in op1_near_dup(spark, sf_dir).collect()}
    assert set(label) == set(texts)
    windows = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items()}
    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(windows[i] & windows[j])
            if both >= least * (len(windows[i]) + len(windows[j]) - both):
                assert label[i] == label[j]
    for i in ids:
        if label[i] != i:
            group = [j for j in ids if label[j] == label[i] and j != i]
            assert any(N.distances([(np.array([hash(x) for x in texts[i]]), np.array([hash(x) for x in texts[j]]))], np.array([int(0.2 * max(len(texts[i]), len(texts[j])))]))[0] >= 0 for j in group)
