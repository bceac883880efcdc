"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents carry a label; everything else is a draw from the whole corpus, toxic
and clean mixed. With the class prior ``pi``, the risk of calling a text clean is estimated as
``R_u(-) - pi R_p(-)`` and kept from falling below zero: a step that finds it negative takes the
opposite direction, which is what stops a flexible model from fitting the unlabelled sample
(Kiryo and others, 2017). The model is linear in how often hashed words and beginnings of
words occur, per words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrisk.llm import words as W
from docrisk.llm.labelled import remainder, sampled_ids, texts_of
from docrisk.llm.scratch import small_batches

#: Bits of a word's bucket.
BITS = 20
#: Code points of a word's beginnings that are features beside the word itself.
BEGINNINGS = (3, 4, 5, 6, 7, 8)


#: Words added to every text's number, so that one word of a short text doesn't decide.
MORE = 30
#: Number of words, buckets and their counts of one text.
Example = tuple[int, np.ndarray, np.ndarray]


@dataclass
class Model:
    """Buckets that count, their weights (for one in a hundred words), and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def features(texts: list[str | None], fold: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Text number, bucket and count of the lower-cased words, and beginnings of longer words, of each
    text, in order (only the ``wanted`` buckets if given), and each text's number of words."""
    w = W.words(texts, fold)
    total = W.running(w.codes)
    found = []
    for n in (0, *BEGINNINGS):
        at = np.flatnonzero(w.ends - w.starts > n) if n else np.arange(len(w.starts))
        starts = w.starts[at]
        hashed = W.span_of(total, starts, starts + n if n else w.ends) + np.uint64(n)
        bucket = (W.mix(hashed) >> np.uint64(64 - BITS)).astype(np.int64)
        doc = w.doc[at].astype(np.int64)
        if wanted is not None:
            hit = wanted[bucket]
            bucket, doc = bucket[hit], doc[hit]
        found.append((doc << BITS) | bucket)
    both, count = np.unique(np.concatenate(found), return_counts=True)
    return both >> BITS, both & ((1 << BITS) - 1), count, np.diff(w.first)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold = W.folding()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in W.chunks(texts):
            doc, bucket, count, n_words = features(texts[i:j], fold)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("positive").slice(i, j - i), pa.array(n_words.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(count.astype(np.int32))),
                ],
                names=["positive", "n_words", "buckets", "counts"],
            )


def fit(positive: list[Example], unlabelled: list[Example], prior: float, *, least: float = 0.02, purity: float = 0.6, epochs: int = 300, rate: float = 0.5, decay: float = 1e-5, seed: int = 7) -> Model:
    """Minimise the non-negative risk with logistic loss by AdaGrad steps over mini-batches.

    A bucket counts if at least the share ``least`` of the positives (and three of them) has it, and
    by the two samples at least the share ``purity`` of the documents that have it is toxic.
    """
    empty = Model(np.zeros(0, np.int64), np.zeros(0), -20.0)
    if not positive or not unlabelled or not 0 < prior < 1:
        return empty
    seen = np.bincount(np.concatenate([x[1] for x in positive]).astype(np.int64), minlength=1 << BITS)
    usual = np.bincount(np.concatenate([x[1] for x in unlabelled]).astype(np.int64), minlength=1 << BITS)
    kept = np.flatnonzero((seen >= max(3, least * len(positive))) & (prior * seen * len(unlabelled) >= purity * usual * len(positive)))
    if not len(kept):
        return empty
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))

    def dense(rows: list[Example]) -> np.ndarray:
        x = np.zeros((len(rows), len(kept)), np.float32)
        for i, (n_words, bucket, count) in enumerate(rows):
            at = place[bucket]
            x[i, at[at >= 0]] = 100 * count[at >= 0] / (n_words + MORE)
        return x

    xp, xu = dense(positive), dense(unlabelled)
    rng = np.random.default_rng(seed)
    w, b = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    gw, gb = np.full(len(kept), 1e-3), 1e-3
    size = 256
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(epochs):
        order = rng.permutation(len(xu))
        for i in range(0, len(order), size):
            u = xu[order[i : i + size]]
            p = xp[rng.integers(0, len(xp), size)]
            fp, fu = p @ w + b, u @ w + b
            # of log(1 + e^f), the loss of calling a text clean, and of log(1 + e^-f)
            clean_p, clean_u = np.logaddexp(0, fp).mean(), np.logaddexp(0, fu).mean()
            dp, du = sigmoid(fp) / len(p), sigmoid(fu) / len(u)
            negative = clean_u - prior * clean_p
            if negative >= 0:
                rp, ru = -prior * sigmoid(-fp) / len(p) - prior * dp, du
            else:
                rp, ru = prior * dp, -du
            grad = p.T @ rp + u.T @ ru + decay * w
            gb_ = float(rp.sum() + ru.sum())
            gw += grad**2
            gb += gb_**2
            w -= rate * grad / np.sqrt(gw)
            b -= rate * gb_ / np.sqrt(gb)
    # the same risk with the 0-1 loss puts the decision: the lowest of the least risky places
    fp, fu = np.sort(xp @ w + b), np.sort(xu @ w + b)
    places = np.unique(np.concatenate([fp, fu]))
    places = (places[1:] + places[:-1]) / 2
    missed = np.searchsorted(fp, places) / len(fp)
    risk = prior * missed + np.maximum(0, 1 - np.searchsorted(fu, places) / len(fu) - prior * (1 - missed))
    return Model(kept, w, b - float(places[risk.argmin()]) if len(places) else b)


def share_of_positives(positive: list[Example], unlabelled: list[Example], *, least: float = 0.5, seed: int = 7) -> float:
    """The class prior, from confirmed positives and the unlabelled alone.

    Whatever rule is looked at, the positives that it takes are a part of the unlabelled that it
    takes, so its share of the unlabelled over its share of the positives is no less than the prior,
    and comes close to it where the rule takes few others. The rules are thresholds on the sum, per words of
    the text, of the cubes of the logarithms of how much more often its buckets occur among positives (cubes, as
    few strong words tell more than many weak ones), learned on one half of each sample and counted on the
    other; each takes at least the share ``least`` of the positives.
    """
    rng = np.random.default_rng(seed)
    halves = []
    for rows in (positive, unlabelled):
        order = rng.permutation(len(rows))
        halves.append(([rows[i] for i in order[::2]], [rows[i] for i in order[1::2]]))
    (learned_p, counted_p), (learned_u, counted_u) = halves
    if not counted_p or not counted_u:
        return 0.0
    seen, usual = (np.bincount(np.concatenate([x[1] for x in rows]).astype(np.int64), minlength=1 << BITS) for rows in (learned_p, learned_u))
    weight = np.log((seen + 0.5) / (len(learned_p) + 1)) - np.log((usual + 0.5) / (len(learned_u) + 1))
    weight[seen < 3] = 0
    at_p, at_u = (np.sort([(weight[x[1]].clip(0) ** 3 * x[2]).sum() / (x[0] + MORE) for x in rows]) for rows in (counted_p, counted_u))
    places = np.unique(at_p)
    taken_p = 1 - np.searchsorted(at_p, places) / len(at_p)
    # one text more, so that a rule that takes none of the unlabelled does not make the prior 0
    taken_u = (len(at_u) - np.searchsorted(at_u, places) + 1) / (len(at_u) + 1)
    return float(min(1.0, (taken_u / taken_p)[taken_p >= least].min()))


def learn(docs: DataFrame, labels: DataFrame, *, prior: float | None = None, n_positive: int = 2000, n_unlabelled: int = 4000, seed: int = 7) -> Model:
    """Fit on a bounded sample: at most ``n_positive`` documents labelled toxic and ``n_unlabelled``
    documents of any kind, all from learning rows (crc32 of the id modulo 5 not 0).

    The class prior, unless it is given, is the toxic share of the labelled learning rows; where all of
    these are toxic, as where only confirmed cases are labelled, it is estimated by
    ``share_of_positives``. Where documents share an id, each row counts; null ids and null labels are left
    out of learning.
    """
    small_batches(docs.sparkSession)
    learning = remainder(F.col("doc_id"), 5) != 0
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(learning & F.col("toxic").isNotNull())
    share = rows.agg(F.avg("toxic")).first()[0]
    if share is None:
        return fit([], [], 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = (
        (sampled_ids(rows.where("toxic = 1").select("doc_id"), n_positive, seed), True),
        (sampled_ids(texts.where(learning).select("doc_id"), n_unlabelled, seed + 1), False),
    )
    found: dict[bool, list[Example]] = {True: [], False: []}
    for ids, positive in kinds:
        part = texts_of(texts, ids).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(positive).alias("positive"))
        for row in part.mapInArrow(_features, "positive boolean, n_words int, buckets array<int>, counts array<int>").toLocalIterator():
            found[positive].append((row.n_words, np.asarray(row.buckets, np.int64), np.asarray(row.counts, np.int64)))
    order = lambda x: (x[0], len(x[1]), x[1].tobytes())  # noqa: E731  the order in which Spark delivers rows must not matter
    positive, unlabelled = sorted(found[True], key=order), sorted(found[False], key=order)
    if prior is None:
        prior = float(share) if share < 1 else share_of_positives(positive, unlabelled, seed=seed)
    return fit(positive, unlabelled, prior, seed=seed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every document with its probability of being toxic.

    One row per given row: ``document`` (a struct of all given columns) and ``score`` (0 to 1). The
    whole text counts. Null, empty and wordless texts get what the bias gives. Without any toxic
    example every score is near 0. An empty table gives an empty result.
    """
    kept, values, bias = model.buckets, model.weights, model.bias

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, weights, wanted = W.folding(), np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
        weights[kept], wanted[kept] = values, True
        for batch in batches:
            texts = batch.column("document").field("text").to_pylist()
            for i, j in W.chunks(texts):
                doc, bucket, count, n_words = features(texts[i:j], fold, wanted)
                logit = bias + np.bincount(doc, weights[bucket] * count, j - i) * 100 / (n_words + MORE)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("document").slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))],
                    names=["document", "score"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    return rows.mapInArrow(scored, T.StructType([rows.schema["document"], T.StructField("score", T.DoubleType())]))


def digest(scored: DataFrame) -> DataFrame:
    """The contract's columns of ``score``."""
    doc_id = F.col("document.doc_id")
    return scored.select(
        doc_id.alias("doc_id"),
        F.coalesce(remainder(doc_id, 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
