"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are reduced to lower-case letters and digits with one space between words.
Items are cut into overlapping pieces, so that a quotation of part of an item is found too. A
piece of m characters that occurs in a text with at most e edits shares at least m - q + 1 - q e of
its q-grams with it, all within 2 e + 1 neighbouring diagonals (text place minus piece place). So
q-gram hits are counted in diagonal bands that overlap by half, bands with enough hits are regions,
and banded alignment of piece and region decides.

The benchmark is handled in blocks of bounded size, each sent to all tasks; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrisk.llm import words as W
from docrisk.llm.scratch import small_batches

#: Characters of a q-gram (a power of 2); edits allowed per character of a piece.
Q, RATE = 8, 0.08
#: Every item becomes pieces of this many characters, each beginning a stride after the one before and
#: the last one ending with the item; an item that is no longer is one piece. So a quotation of
#: ``PIECE + STRIDE - 1`` characters holds a whole piece.
PIECE, STRIDE = 100, 11
#: Half the width of a band; at least 2 e + 1 for the longest piece.
HALF = 32
#: Characters of benchmark items that go to the tasks at once.
BLOCK = 1_000_000
#: Bits of the first look-up of a q-gram.
SIEVE = 22


def normal(texts: list[str | None], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised code points of texts, the text of each, and its place in that text."""
    codes, begins = W.code_points(texts)
    codes = np.where(codes < len(fold), fold[np.minimum(codes, len(fold) - 1)], codes)
    doc = np.repeat(np.arange(len(texts)), np.diff(begins))
    keep = np.ones(len(codes), bool)
    space = codes == 32
    keep[1:] = ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))
    at = np.flatnonzero(keep)
    return codes[at], doc[at], at - begins[doc[at]]


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q code points from each place on."""
    value, size = codes.astype(np.uint64) + W.STEP, 1
    while size < Q:
        value = value[:-size] * W.CHAIN + value[size:] if len(value) > size else value[:0]
        value ^= value >> np.uint64(29)
        size *= 2
    return value * W.STEP


@dataclass
class Index:
    """Pieces of one block of items and where their q-grams are."""

    items: list[int]
    item: np.ndarray
    pieces: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray
    piece: np.ndarray
    place: np.ndarray


def index(items: list[tuple[int, str]]) -> Index | None:
    """The index of some items (id, text); items of fewer than Q characters have no q-gram."""
    fold = W.folding()
    owner, pieces = [], []
    for k, (_, text) in enumerate(items):
        codes, _, _ = normal([text], fold)
        codes = codes[(codes[:1] == 32).sum() : len(codes) - (codes[-1:] == 32).sum()]
        if len(codes) < Q:
            continue
        for c in sorted({*range(0, max(1, len(codes) - PIECE), STRIDE), max(0, len(codes) - PIECE)}):
            owner.append(k)
            pieces.append(codes[c : c + PIECE])
    if not pieces:
        return None
    size = np.array([len(p) for p in pieces])
    edits = np.minimum((RATE * size).astype(int), (size - Q) // Q)
    hashed = [grams(p) for p in pieces]
    of = np.repeat(np.arange(len(pieces)), [len(h) for h in hashed])
    place = np.concatenate([np.arange(len(h)) for h in hashed])
    hashed = np.concatenate(hashed)
    order = np.argsort(hashed, kind="stable")
    unique, begin = np.unique(hashed[order], return_index=True)
    return Index(
        [i for i, _ in items], np.array(owner), pieces, edits, size - Q + 1 - Q * edits, unique, np.append(begin, len(order)), of[order], place[order]
    )


def regions(codes: np.ndarray, ix: Index, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, first diagonal) of bands with enough q-gram hits, each two halves wide."""
    hashed = grams(codes)
    at = np.flatnonzero(sieve[(hashed >> np.uint64(64 - SIEVE)).astype(np.int64)])
    known = np.minimum(np.searchsorted(ix.hashes, hashed[at]), len(ix.hashes) - 1)
    same = ix.hashes[known] == hashed[at]
    at, known = at[same], known[same]
    times = ix.begin[known + 1] - ix.begin[known]
    first = np.repeat(ix.begin[known] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) if len(times) else times
    entry = np.arange(times.sum()) + first
    piece = ix.piece[entry]
    half = (piece.astype(np.int64) << 32) | ((np.repeat(at, times) - ix.place[entry]) // HALF + 256)
    key, total = _bands(np.sort(half))
    key = key[total >= ix.least[key >> 32]]
    # a place of the piece counts once in each half, however often a periodic text has its q-gram
    halves = np.unique(np.concatenate([key, key + 1]))
    if not len(halves):
        return halves, halves
    some = halves[np.minimum(np.searchsorted(halves, half), len(halves) - 1)] == half
    key, total = _bands(_different(np.sort((half[some] << 8) | ix.place[entry[some]])) >> 8)
    key = key[total >= ix.least[key >> 32]]
    # the band before, too: a match may begin there without a whole q-gram
    key = np.unique(np.concatenate([key, key - 1]))
    return key >> 32, ((key & ((1 << 32) - 1)) - 256) * HALF


def _different(sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return sorted_keys[new]


def _bands(sorted_halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hits of the band that begins with each half: those of the half and of the next."""
    half = _different(sorted_halves)
    begin = np.append(np.searchsorted(sorted_halves, half), len(sorted_halves))
    total = count = np.diff(begin)
    if len(half) > 1:
        total = count.copy()
        total[:-1] += np.where(half[1:] == half[:-1] + 1, count[1:], 0)
    return half, total


def align(codes: np.ndarray, doc: np.ndarray, of: np.ndarray, pieces: list[np.ndarray], first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each piece anywhere on ``width`` diagonals of one text, with begin and end.

    One table row for each character of the piece, one column for each diagonal; all regions at once.
    A cell holds the edits and, below, the diagonal where its match began.
    """
    one = np.int64(1) << 20
    size = np.array([len(p) for p in pieces])
    never = one << 20
    pattern = np.zeros((len(pieces), size.max()), np.int64)
    for i, p in enumerate(pieces):
        pattern[i, : len(p)] = p
    diagonal = np.arange(width)
    step = diagonal * one
    cost = np.tile(diagonal, (len(pieces), 1)).astype(np.int64)
    at = first[:, None] + diagonal
    outside = (at < 0) | (at > len(codes)) | (doc[np.clip(at, 0, len(codes) - 1)] != of[:, None])
    cost[outside] = never
    best, end = np.full(len(pieces), never), np.zeros(len(pieces), np.int64)
    for j in range(pattern.shape[1]):
        at = first[:, None] + j + diagonal
        here = np.clip(at, 0, len(codes) - 1)
        inside = (at >= 0) & (at < len(codes)) & (doc[here] == of[:, None])
        met = cost + np.where(inside & (codes[here] == pattern[:, j : j + 1]), 0, one)
        met[~inside] = never
        met[:, :-1] = np.minimum(met[:, :-1], cost[:, 1:] + one)
        # characters of the text that the piece lacks: along the row
        cost = np.minimum.accumulate(met - step, axis=1) + step
        cost[~inside & (met >= never)] = never
        cost = np.minimum(cost, never)
        done = np.flatnonzero(size == j + 1)
        if len(done):
            k = cost[done].argmin(axis=1)
            best[done], end[done] = cost[done, k], first[done] + j + 1 + k
    return best >> 20, first + (best & (one - 1)), end


def leaks(texts: list[str | None], ix: Index, fold: np.ndarray, sieve: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, begin, end, edits) of every item found in some texts; places are code points of
    the text as given. Of an item's pieces found in a text, the span from first to last and the
    fewest edits."""
    codes, doc, place = normal(texts, fold)
    piece, first = regions(codes, ix, sieve)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for s in range(0, len(piece), 256):
        p, at = piece[s : s + 256], first[s : s + 256]
        size = np.array([len(ix.pieces[k]) for k in p])
        low = np.clip(at, 0, len(codes) - 1)
        high = np.clip(at + 2 * HALF + size, 0, len(codes) - 1)
        # a region may touch several texts; each is searched by itself
        docs = doc[high] - doc[low] + 1
        row = np.repeat(np.arange(len(p)), docs)
        of = doc[low][row] + np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(docs)[:-1]]), docs)
        edits, begin, end = align(codes, doc, of, [ix.pieces[k] for k in p[row]], at[row], 2 * HALF)
        for i in np.flatnonzero(edits <= ix.edits[p[row]]):
            key = (int(of[i]), int(ix.item[p[row[i]]]))
            b, e, n = int(place[begin[i]]), int(place[end[i] - 1]) + 1, int(edits[i])
            old = found.get(key)
            found[key] = (min(b, old[0]), max(e, old[1]), min(n, old[2])) if old else (b, e, n)
    return [(d, k, *span) for (d, k), span in sorted(found.items())]


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of all items, ``BLOCK`` characters of items at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        ix = index(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r)))
        if ix is not None:
            yield ix


def _search(ix: Index) -> Callable[[list[str | None]], Iterator[tuple[int, int, list[tuple[int, int, int, int, int]]]]]:
    def run(texts: list[str | None]) -> Iterator[tuple[int, int, list[tuple[int, int, int, int, int]]]]:
        fold, sieve = W.folding(), np.zeros(1 << SIEVE, bool)
        sieve[(ix.hashes >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
        for i, j in W.chunks(texts):
            yield i, j, leaks(texts[i:j], ix, fold, sieve)

    return run


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every benchmark item that occurs in a document, with at most ``RATE`` edits per character.

    One row for each given row and item: ``doc_id``, ``item_id``, ``begin`` and ``end`` (code points
    of the text) and ``edits``. Null and empty texts hold nothing. Items without a text, or of fewer
    than ``Q`` letters, digits and single spaces, are found nowhere. Repeated items are found each
    once by id. An empty table on either side gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, begin int, end int, edits int"
    result = None
    for ix in _blocks(benchmark):
        search = _search(ix)

        def found(batches: Iterator[pa.RecordBatch], ix: Index = ix, search: Callable = search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for i, _, some in search(batch.column("text").to_pylist()):
                    columns = list(zip(*[(ids[i + d], ix.items[k], b, e, n) for d, k, b, e, n in some], strict=True)) or [[]] * 5
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "begin", "end", "edits"])

        part = rows.mapInArrow(found, schema)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return docs.sparkSession.createDataFrame([], schema)
    return result


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The given rows, all columns as they are, without those in which ``find`` finds an item."""
    small_batches(docs.sparkSession)
    document = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    for ix in _blocks(benchmark):
        search = _search(ix)

        def clean(batches: Iterator[pa.RecordBatch], search: Callable = search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                document = batch.column("document")
                for i, j, some in search(document.field("text").to_pylist()):
                    keep = np.ones(j - i, bool)
                    keep[[d for d, *_ in some]] = False
                    yield pa.RecordBatch.from_arrays([document.slice(i, j - i).filter(pa.array(keep))], names=["document"])

        rows = docs.select(document.alias("document"))
        docs = rows.mapInArrow(clean, T.StructType([rows.schema["document"]])).select("document.*")
    return docs
