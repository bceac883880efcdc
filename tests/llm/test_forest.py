import numpy as np

from docrisk.llm import forest as A
from docrisk.llm.queries import op10_forest


def brute(ids, x, query, k):
    d = np.sqrt(((x - x[ids == query][0]) ** 2).sum(axis=1))
    order = np.lexsort((ids, d))
    order = order[ids[order] != query][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_query_has_the_recall_asked_for(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in op10_forest(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        want = brute(ids, x, q, 10)
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        place = {int(i): k for k, i in enumerate(ids)}
        for _, v, score in found:
            assert abs(score - np.sqrt(((x[place[v]] - x[place[q]]) ** 2).sum())) < 1e-12
        assert found == sorted(found, key=lambda f: (f[2], f[1]))
        hits += len({f[1] for f in found} & {v for v, _ in want})
    assert hits / (10 * len(got)) >= 0.9


def test_few_vectors_copies_and_ties_are_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (240, 3)).astype(float)
    x[100:180] = [1, 1, 1]
    ids = np.arange(240)
    docs = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    zero = (x == 0).all(axis=1)
    got = {}
    for r in A.nearest(docs, "vec_id % 20 = 0", k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 240, 20):
        if zero[q]:
            assert q not in got
        else:
            assert got[q] == brute(ids[~zero], x[~zero], q, 10)


def test_near_copies_keep_their_exact_order(spark):
    """Distances far below what |x|^2 + |q|^2 - 2xq can tell: near copies, and a large common offset."""
    rng = np.random.default_rng(4)
    x = np.concatenate([1e4 + 1e-6 * rng.normal(size=(200, 8)), 1e4 + rng.normal(size=(200, 8))])
    ids = rng.permutation(400)
    docs = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in A.nearest(docs, "vec_id % 10 = 0", k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: brute(ids, x, q, 10) for q in range(0, 400, 10)}


def test_blocks_of_queries_give_the_same(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    one = A.nearest(docs, "vec_id % 10 = 0").collect()
    many = A.nearest(docs, "vec_id % 10 = 0", block=7).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 400


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 9.0), (100, [0.0, 1.0], 9.0), (7, None, 9.0), (8, [], 9.0), (9, [0.0, 0.0], 9.0), (10, [nan, 1.0], 9.0), (11, [inf, 1.0], 9.0), (12, [None, 1.0], 9.0), (13, [1.0, 1.0, 1.0], 9.0), (None, [1.0, 1.0], 9.0), (14, [2.0, 0.0], 9.0), (14, [2.0, 0.0], 9.0), (200, [0.0, -0.0], 9.0)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = [tuple(r) for r in A.nearest(docs, "vec_id % 100 = 0").orderBy("query_id", "rank").collect()]
    root = 2**0.5
    assert [(q, r, v, round(s, 12)) for q, r, v, s in got] == [(0, 1, 14, 1.0), (0, 2, 100, round(root, 12)), (100, 1, 0, round(root, 12)), (100, 2, 14, round(5**0.5, 12))]
    assert A.nearest(docs.limit(0), "vec_id % 100 = 0").collect() == []
    assert A.nearest(docs.where("vec_id = 7"), "vec_id % 100 = 0").collect() == []
    assert A.nearest(docs.where("vec_id = 0"), "vec_id % 100 = 0").collect() == []
