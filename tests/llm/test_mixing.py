import re

import numpy as np

from docrisk.llm import mixing as M
from docrisk.llm.queries import op5_mixing


def water(sizes):
    """Targets by sharing again and again what a source cannot take."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_, budget = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if budget * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not full:
            target |= {s: budget * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        budget -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return target


def test_counts_fill_budgets_exactly_where_that_is_possible():
    rng = np.random.default_rng(3)
    for _ in range(300):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 12)))
        counts = rng.integers(1, 5, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        taken = M.chosen_counts(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        reach = {0}
        for length, n in zip(lengths.tolist(), counts.tolist()):
            reach = {s + k * length for s in reach for k in range(n + 1) if s + k * length <= budget}
        assert int((lengths * taken).sum()) == max(reach)
    # small windows stay below the budget and near it
    lengths, counts = np.arange(1, 400), np.full(399, 3)
    for budget in (0, 17, 5000, 100_000, int((lengths * counts).sum())):
        assert 0 <= budget - int((lengths * M.chosen_counts(lengths, counts, budget, window=64)).sum()) <= 1


def test_query(spark, sf_dir):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in rows.items()}
    total = {}
    for i, r in rows.items():
        total[r.source] = total.get(r.source, 0) + size[i]
    want = water(total)
    got = op5_mixing(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    taken = dict.fromkeys(total, 0)
    for r in got:
        source = rows[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == total[source] and abs(r.target - want[source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    # ten documents a source: not every number of words can be made of them
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in taken)
    again = op5_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_edge_cases(spark):
    rows = [(1, "a b c", "s", "x"), (2, None, "s", "y"), (3, "", None, "z"), (None, "d e", None, "n"), (4, "one two\x0bthree", "é", "q"), (4, "one two\x0bthree", "é", "q"), (5, "w " * 100_000, "Z", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    by = {(r.document.doc_id, r.document.taken): r for r in got}
    assert by[2, "y"].size == 0 and by[2, "y"].copies == 0 and by[3, "z"].taken == 0 and by[4, "q"].size == 3
    want = water({"s": 3, None: 2, "é": 6, "Z": 100_000})
    assert all(abs(r.target - want[r.document.source]) < 1e-6 for r in got)
    assert M.mix(docs.limit(0)).collect() == []
    nothing = M.mix(docs.where("doc_id in (2, 3)")).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_large_equal_lengths_are_told_apart(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'a b c d' as text", "case when id % 3 = 0 then 'x' when id % 3 = 1 then 'y' else 'z' end as source")
    got = M.mix(docs).collect()
    want = water({"x": 4000, "y": 4000, "z": 4000})
    for s in "xyz":
        assert abs(sum(r.taken for r in got if r.document.source == s) - want[s]) < 4
