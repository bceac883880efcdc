"""Document quality by supervised subword embeddings.

Every word (as it stands, with its case and punctuation) and every character n-gram of it has a
learned vector in a hashed table; a word that repeats the one before it counts as an empty word. A text is the average of the vectors of all its words and n-grams;
a softmax over two outputs gives the labels' probabilities. Both are trained by numpy stochastic
gradient descent on a bounded sample. Averaging and the difference of the two outputs are linear,
so scoring needs one number for each table row: a text's score is the logistic of an average.
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

#: Bits of a row in the table of vectors.
BITS = 17
#: Lengths of character n-grams, word boundaries (as < and >) included.
GRAMS = (2, 3, 4)


@dataclass
class Model:
    """Vectors of words and n-grams, output weights (dimension x 2), and output biases."""

    vectors: np.ndarray
    outputs: np.ndarray
    biases: np.ndarray


def word_features(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, table row) of the words themselves and of their n-grams."""
    size = ends - starts + 2
    begin = np.concatenate([[0], np.cumsum(size)])
    inner = np.ones(begin[-1], bool)
    inner[begin[:-1]] = inner[begin[1:] - 1] = False
    marked = np.empty(begin[-1], np.uint64)
    marked[begin[:-1]], marked[begin[1:] - 1] = ord("<"), ord(">")
    marked[inner] = codes[np.repeat(starts - begin[:-1] - 1, size)[inner] + np.flatnonzero(inner)]
    word = np.repeat(np.arange(len(starts)), size)
    left = np.repeat(begin[1:], size) - np.arange(begin[-1])
    shift = np.uint64(64 - BITS)
    of, rows = [np.arange(len(starts))], [(W.mix(hashes) >> shift).astype(np.int64)]
    value = np.zeros(len(marked), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        value = value[: len(marked) - n + 1] * W.CHAIN + marked[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            at = np.flatnonzero(left[: len(value)] >= n)
            of.append(word[at])
            rows.append((W.mix(value[at] + np.uint64(n)) >> shift).astype(np.int64))
    return np.concatenate(of), np.concatenate(rows)


def distinct_words(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different words of some texts: number of each word, and features of the different ones."""
    hashes, ends = w.hashes(), w.ends.copy()
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (w.doc[1:] == w.doc[:-1])) + 1
    hashes[again], ends[again] = 0, w.starts[again]
    different, at, number = np.unique(hashes, return_index=True, return_inverse=True)
    of, rows = word_features(w.codes, w.starts[at], ends[at], different)
    return number, of, rows, np.bincount(of, minlength=len(different)), different


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Table rows and their shares of each sampled text."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i in range(len(texts)):
            w = W.words(texts[i : i + 1])
            number, of, rows, _, different = distinct_words(w)
            times = np.bincount(number, minlength=len(different)).astype(float)
            row, place = np.unique(rows, return_inverse=True)
            share = np.bincount(place, times[of], len(row))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label").slice(i, 1),
                    pa.array([row.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([(share / max(share.sum(), 1)).astype(np.float32)], pa.list_(pa.float32())),
                ],
                names=["label", "rows", "shares"],
            )


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], *, size: int = 16, epochs: int = 6, rate: float = 40.0, seed: int = 3) -> Model:
    """Softmax regression on averaged vectors, vectors learned with it, by mini-batch SGD with a
    rate that falls linearly to 0. Without both labels among the examples, the biases say what is
    known and the vectors stay 0."""
    rng = np.random.default_rng(seed)
    labels = np.array([x[0] for x in examples], int)
    ones = (labels == 1).mean() if len(labels) else 0.5
    model = Model(np.zeros((1 << BITS, size), np.float32), np.zeros((size, 2), np.float32), np.log(np.clip([1 - ones, ones], 1e-3, 1)).astype(np.float32))
    if len(set(labels.tolist())) < 2:
        return model
    vectors = model.vectors = rng.uniform(-1 / size, 1 / size, (1 << BITS, size)).astype(np.float32)
    outputs, biases, batch = model.outputs, model.biases, 16
    done, steps = 0, epochs * -(-len(examples) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for i in range(0, len(order), batch):
            part = [examples[k] for k in order[i : i + batch]]
            used, place = np.unique(np.concatenate([x[1] for x in part]), return_inverse=True)
            share = np.zeros((len(part), len(used)), np.float32)
            share[np.repeat(np.arange(len(part)), [len(x[1]) for x in part]), place] = np.concatenate([x[2] for x in part])
            hidden = share @ vectors[used]
            logit = hidden @ outputs + biases
            wrong = np.exp(logit - logit.max(axis=1, keepdims=True))
            wrong /= wrong.sum(axis=1, keepdims=True)
            wrong[np.arange(len(part)), [x[0] for x in part]] -= 1
            wrong /= len(part)
            now = rate * (1 - done / steps)
            back = share.T @ (wrong @ outputs.T)
            outputs -= 0.1 * now * (hidden.T @ wrong)
            biases -= 0.01 * now * wrong.sum(axis=0)
            vectors[used] -= now * back
            done += 1
    return model


def learn(docs: DataFrame, labels: DataFrame, *, n: int = 3000, seed: int = 3) -> Model:
    """Fit on at most ``n`` labelled documents, all from learning rows (crc32 of the id modulo 5 not
    0), chosen by a seeded hash of the id. Null ids and null labels are left out of learning."""
    small_batches(docs.sparkSession)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .where((remainder(F.col("doc_id"), 5) != 0) & F.col("label").isin(0, 1))
    )
    ids = sampled_ids(known.select("doc_id"), n, seed)
    chosen = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = texts_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), chosen)
    rows = texts.select("label", "text").mapInArrow(_examples, "label int, rows array<int>, shares array<float>")
    examples = [(r.label, np.asarray(r.rows, np.int64), np.asarray(r.shares, np.float32)) for r in rows.toLocalIterator()]
    # the order in which Spark delivers rows must not matter
    examples.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes(), x[2].tobytes()))
    return fit(examples, seed=seed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every document with the probability of label 1.

    One row per given row: ``document`` (a struct of all given columns) and ``score`` (0 to 1). The
    whole text counts. Null, empty and white-space texts get what the biases give. An empty table
    gives an empty result.
    """
    weights = (model.vectors @ (model.outputs[:, 1] - model.outputs[:, 0])).astype(np.float32)
    bias = float(model.biases[1] - model.biases[0])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("document").field("text").to_pylist()
            for i, j in W.chunks(texts):
                w = W.words(texts[i:j])
                number, of, rows, size, different = distinct_words(w)
                value = np.bincount(of, weights[rows], len(different))
                total = np.bincount(w.doc, value[number], j - i)
                logit = bias + total / np.maximum(np.bincount(w.doc, size[number], j - i), 1)
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
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
