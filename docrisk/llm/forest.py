"""Approximate nearest neighbours with a forest of random-projection trees.

Every tree halves a bounded sample of the vectors again and again, each time at the median of a
projection on the line between two random vectors of the node. The forest is small and goes to all
tasks; every row is indexed, its leaf in each tree worked out where it lies, so rows are neither
copied for each tree nor dealt out by leaf, and no leaf can be hot. A query walks all trees through
one shared priority queue, nearest margin first, until the leaves seen hold a given share of the
sample; all rows of these leaves are its candidates and are ranked by their exact distance.

Queries are handled in blocks of bounded size; for each block every task keeps the best rows of each
query, and only those are shuffled. Equal vectors are searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrisk.llm.scratch import cut


@dataclass
class Tree:
    """Inner nodes as rows: direction, threshold, children; a child below 0 is leaf ``-1 - child``."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    sizes: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``."""
        node = np.zeros(len(x), np.int64) if len(self.thresholds) else np.full(len(x), -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            far = np.einsum("ij,ij->i", x[inner], self.directions[at]) > self.thresholds[at]
            node[inner] = self.children[at, far.astype(int)]
        return -1 - node


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree over the sample ``x`` whose leaves have at most ``leaf`` rows, or rows no projection tells apart."""
    directions, thresholds, children, sizes = [], [], [], []

    def split(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            for _ in range(5):
                a, b = x[rng.choice(rows, 2, replace=False)]
                length = np.linalg.norm(a - b)
                if length == 0:
                    continue
                direction = (a - b) / length
                along = x[rows] @ direction
                middle = float(np.median(along))
                far = along > middle
                if far.any() and not far.all():
                    me = len(thresholds)
                    directions.append(direction)
                    thresholds.append(middle)
                    children.append([0, 0])
                    children[me] = [split(rows[~far]), split(rows[far])]
                    return me
        sizes.append(len(rows))
        return -len(sizes)

    split(np.arange(len(x)))
    return Tree(np.array(directions).reshape(-1, x.shape[1]), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2), np.array(sizes))


def seen(forest: list[Tree], q: np.ndarray, sample_leaves: list[list[np.ndarray]], wanted: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order a query meets them, until ``wanted`` different sample rows are seen."""
    margins = [tree.directions @ q - tree.thresholds for tree in forest]
    queue = [(0.0, t, 0 if len(tree.thresholds) else -1) for t, tree in enumerate(forest)]
    met, found = [], set()
    while queue and len(found) < wanted:
        away, t, node = heapq.heappop(queue)
        if node < 0:
            met.append((t, -1 - node))
            found.update(sample_leaves[t][-1 - node])
            continue
        margin = margins[t][node]
        near, far = forest[t].children[node][::-1] if margin > 0 else forest[t].children[node]
        heapq.heappush(queue, (away, t, int(near)))
        heapq.heappush(queue, (max(away, abs(float(margin))), t, int(far)))
    return met


@dataclass
class Forest:
    """Trees, the sample's rows in each leaf, and the dimension of all vectors."""

    trees: list[Tree]
    sample_leaves: list[list[list[int]]]
    sample_size: int
    dimension: int


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the vectors that take part: neither null nor zero, without null
    or non-finite components, and of the dimension that most such vectors have (of two, the smaller)."""
    wide = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = (
        rows.select(F.col(key).cast("long").alias("id"), wide.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda c: c != 0))
    )
    first = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (first.n if first else 0))


def fit(vectors: DataFrame, *, n_sample: int = 8192, n_trees: int = 40, leaf: int = 24, seed: int = 13) -> Forest:
    """Trees over at most ``n_sample`` different vectors, chosen by a seeded hash of their ids."""
    rows = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n_sample).select("v").collect()
    x = np.array([r.v for r in rows], float).reshape(len(rows), len(rows[0].v) if rows else 0)
    rng = np.random.default_rng(seed)
    trees = [grow(x, leaf, rng) for _ in range(n_trees)] if len(x) else []
    members = []
    for tree in trees:
        at = tree.leaves(x)
        members.append([np.flatnonzero(at == k).tolist() for k in range(len(tree.sizes))])
    return Forest(trees, members, len(x), x.shape[1])


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _best(query: np.ndarray, ids: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` nearest of each query, ties to the smaller id."""
    order = np.lexsort((ids, distance, query))
    of = query[order]
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    begin = np.flatnonzero(new)
    place = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
    return order[place < n]


def _candidates(vectors: DataFrame, block: list, forest: Forest, n: int) -> DataFrame:
    """Each task's ``n`` nearest candidates of every query of a block."""
    q_ids = np.array([r.id for r in block], np.int64)
    q = np.array([r.v for r in block], float)
    # which queries see which leaf of which tree, one bit each
    sees = [np.zeros((len(tree.sizes), -(-len(block) // 8)), np.uint8) for tree in forest.trees]
    for i, r in enumerate(block):
        for t, leaf in zip(r.trees, r.leaves, strict=True):
            sees[t][leaf, i >> 3] |= 1 << (i & 7)
    trees, dimension, squares = forest.trees, forest.dimension, (q**2).sum(axis=1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, ids, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            all_ids, all_x = batch.column("id").to_numpy(zero_copy_only=False), _matrix(batch.column("v"), dimension)
            for s in range(0, len(all_ids), 1000):
                x, x_ids = all_x[s : s + 1000], all_ids[s : s + 1000]
                bits = np.zeros((len(x), sees[0].shape[1]), np.uint8)
                for tree, by_leaf in zip(trees, sees, strict=True):
                    bits |= by_leaf[tree.leaves(x)]
                norms = (x**2).sum(axis=1)[:, None] + squares
                near = norms - 2 * (x @ q.T)
                near[np.unpackbits(bits, axis=1, count=len(q), bitorder="little") == 0] = np.inf
                if len(x) > 2 * n:
                    # all rows that can be as near as the last of the nearest, within what rounding leaves open, so that ties stay in
                    wrong = np.finfo(float).eps * (dimension + 8) * norms
                    edge = np.partition(near + wrong, n, axis=0)[n]
                    near[near - wrong > edge * (1 + 1e-9)] = np.inf
                row, of = np.nonzero(np.isfinite(near))
                exact = np.zeros(len(row))
                for e in range(0, len(row), 50_000):
                    part = slice(e, e + 50_000)
                    exact[part] = np.sqrt(((x[row[part]] - q[of[part]]) ** 2).sum(axis=1))
                query, ids, distance = np.concatenate([query, of]), np.concatenate([ids, x_ids[row]]), np.concatenate([distance, exact])
                best = _best(query, ids, distance, n)
                query, ids, distance = query[best], ids[best], distance[best]
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[query]), pa.array(ids), pa.array(distance)], names=["query", "id", "distance"])

    return vectors.mapInArrow(scan, "query long, id long, distance double")


def search(vectors: DataFrame, queries: DataFrame, forest: Forest, *, k: int, share: float = 0.4, least: int = 1000, block: int = 1500) -> DataFrame:
    """``query``, ``id`` and ``distance`` of the ``k`` nearest vectors found for each query, the query
    itself included. ``vectors`` and ``queries`` have different vectors ``v`` with an ``id`` each.

    Leaves are seen until they hold ``share`` of the sample, or ``least`` rows of it if that is more;
    ``block`` queries are handled at a time.
    """
    wanted = max(least, round(share * forest.sample_size))
    trees, members, dimension = forest.trees, forest.sample_leaves, forest.dimension

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [seen(trees, q, members, wanted) for q in _matrix(batch.column("v"), dimension)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v")] + [pa.array([[m[i] for m in one] for one in met], pa.list_(pa.int32())) for i in (0, 1)],
                names=["id", "v", "trees", "leaves"],
            )

    n = queries.count() if trees else 0
    blocks = -(-n // block)
    if not blocks:
        return queries.sparkSession.createDataFrame([], "query long, id long, distance double")
    walked = queries.select("id", "v").mapInArrow(walk, "id long, v array<double>, trees array<int>, leaves array<int>")
    walked = cut(walked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))) if blocks > 1 else walked.withColumn("block", F.lit(0))
    parts = []
    for b in range(blocks):
        rows = walked.where(F.col("block") == b).collect()
        if rows:
            found = _candidates(vectors, sorted(rows, key=lambda r: r.id), forest, k)
            place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
            best = found.withColumn("place", place).where(F.col("place") <= k).drop("place")
            parts.append(cut(best) if blocks > 1 else best)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def nearest(rows: DataFrame, is_query: str, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, **options) -> DataFrame:
    """The ``k`` nearest other rows found for every row that ``is_query`` (SQL over ``key``) names.

    Result: ``query_id``, ``rank`` (from 1, nearest first, ties to the smaller id), ``vec_id`` and
    ``score`` (Euclidean distance in double precision); all others, if fewer than ``k``. Vectors that
    are null or zero, hold null or non-finite components, or have another dimension than most, take
    no part; nor do rows without an id. Rows that repeat an id with another vector are rows of their
    own; repeated rows with the same vector count once. An empty table gives an empty result.
    """
    good = usable(rows, key, vector).distinct()
    alike = Window.partitionBy("v").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # of equal vectors no more than the k + 1 smallest ids can be among any k nearest
    kept = cut(
        good.withColumn("place", F.row_number().over(alike)).withColumn("first", F.first("id").over(alike)).where(F.col("place") <= k + 1)
    )
    vectors = kept.where("place = 1").select("id", "v")
    asking = good.where(F.expr(is_query.replace(key, "id"))).select(F.col("id").alias("query_id"), "v")
    queries = asking.join(vectors, "v").select("query_id", F.col("id").alias("query"), "v")
    distinct = queries.groupBy("query").agg(F.first("v").alias("v")).withColumnRenamed("query", "id")
    fit_options = {o: options.pop(o) for o in ("n_sample", "n_trees", "leaf", "seed") if o in options}
    found = search(vectors, distinct, fit(vectors, **fit_options), k=k + 1, **options)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (
        found.join(kept.select(F.col("first").alias("id"), F.col("id").alias("vec_id")), "id")
        .join(queries.select("query_id", "query"), "query")
        .where("vec_id != query_id")
        .select("query_id", "vec_id", F.col("distance").alias("score"))
        .withColumn("rank", place)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
