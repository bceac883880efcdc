"""Repeated passages by relative Lempel-Ziv parsing of every document against the whole corpus.

The reference is the corpus itself. Its index holds anchors: in every window of ``SPAN`` words the
k-gram with the smallest hash. Equal windows choose the same anchor, so no repeat escapes the index.
Each anchor's earliest occurrence is its place in the reference. A document is parsed from left to
right: as long as successive anchors lie on one stretch of one reference document, the factor goes
on; anchors overlap, so equal anchors prove equal words in between. Factors of at least ``SPAN``
words are duplicate spans. Windows at factor boundaries (they hold a shared anchor but lie in no
factor) are checked by hashes of their whole word sequence, on the same rule: the earliest
occurrence stays.

Nothing is kept per key: anchors and windows are reduced by partial aggregation before each shuffle,
so a passage shared by a third of all documents costs one row per document. Texts are shuffled once;
both passes over them read that shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrisk.llm import words as W
from docrisk.llm.scratch import small_batches

#: Words of a window that counts as repeated (the contract's unit).
SPAN = 20
#: Words of an anchor; a window has SPAN - K + 1 of them to choose from, fewer than K, so that
#: neighbouring anchors always touch.
K = 11


class Parsed:
    """Words of some texts with every window's anchor."""

    def __init__(self, texts: list[str | None]):
        self.w = w = W.words(texts)
        self.h = w.hashes()
        self.gram, _ = W.grams(self.h, w.doc, K)
        n = len(self.h) - SPAN + 1
        if n <= 0:
            self.windows = self.chosen = self.anchors = np.zeros(0, np.int64)
            return
        at = np.flatnonzero(w.doc[:n] == w.doc[SPAN - 1 :])
        view = np.lib.stride_tricks.sliding_window_view(self.gram, SPAN - K + 1)
        self.windows, self.chosen = at, at + view[at].argmin(axis=1)
        new = np.ones(len(at), bool)
        new[1:] = self.chosen[1:] != self.chosen[:-1]
        self.anchors = self.chosen[new]

    def of_document(self, at: np.ndarray) -> np.ndarray:
        """A key of (document, anchor text) for each anchor."""
        return W.mix(self.gram[at] ^ W.mix(self.w.doc[at].astype(np.uint64)))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("ord").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
        for i, j in W.chunks(texts):
            p = Parsed(texts[i:j])
            _, once = np.unique(p.of_document(p.anchors), return_index=True)
            at = p.anchors[once]
            doc = p.w.doc[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.gram[at].view(np.int64)), pa.array(ids[i:j][doc]), pa.array((at - p.w.first[doc]).astype(np.int32))],
                names=["anchor", "ord", "pos"],
            )


def _flat(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """A list of structs as row number of each item and its fields."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    counts = np.diff(column.offsets.to_numpy())
    if column.null_count:
        counts = np.where(np.asarray(column.is_null()), 0, counts)
    items = column.flatten()
    fields = items.flatten() if pa.types.is_struct(items.type) else [items]
    return np.repeat(np.arange(len(column)), counts), [f.to_numpy(zero_copy_only=False) for f in fields]


def _lists(row: np.ndarray, n: int, names: list[str], fields: list[pa.Array]) -> pa.ListArray:
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=n), out=offsets[1:])
    values = pa.StructArray.from_arrays(fields, names=names) if names else fields[0]
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _factor(texts: list[str | None], ids: np.ndarray, row: np.ndarray, refs: list[np.ndarray]):
    """Ranges of words in factors, and of the windows left to check: place, hash, and whether an
    earlier document has their anchor (only then can they be repeats)."""
    p = Parsed(texts)
    a, w = p.anchors, p.w
    doc = w.doc[a]
    groups, first, group = np.unique(p.of_document(a), return_index=True, return_inverse=True)
    # where the index has each anchor of each document
    anchor, ref, ref_pos = refs
    known = W.mix(anchor.view(np.uint64) ^ W.mix(row.astype(np.uint64)))
    there = np.searchsorted(groups, known)
    fits = (there < len(groups)) & (groups[np.minimum(there, max(len(groups) - 1, 0))] == known) if len(groups) else np.zeros(len(known), bool)
    group_ref = np.full(len(groups), -1, np.int64)
    group_ref[there[fits]] = np.flatnonzero(fits)
    at_ref = group_ref[group] if len(groups) else np.zeros(0, np.int64)
    pos = a - w.first[doc]
    earlier = (at_ref >= 0) & (ref[at_ref] < ids[doc]) if len(ref) else np.zeros(len(a), bool)
    repeat = first[group] != np.arange(len(a)) if len(groups) else np.zeros(0, bool)
    source = np.where(earlier, ref[at_ref] if len(ref) else 0, ids[doc])
    target = np.where(earlier, ref_pos[at_ref] if len(ref) else 0, pos[first[group]] if len(groups) else 0)
    has = earlier | repeat
    shared = (at_ref >= 0) | (np.bincount(group, minlength=len(groups))[group] > 1)
    # a factor goes on while neighbouring anchors stay on one diagonal of one reference document
    goes_on = np.zeros(len(a), bool)
    if len(a):
        goes_on[1:] = (
            has[1:] & has[:-1] & (doc[1:] == doc[:-1]) & (source[1:] == source[:-1])
            & (target[1:] - target[:-1] == pos[1:] - pos[:-1]) & (a[1:] - a[:-1] <= K)
        )
    begin = np.flatnonzero(has & ~goes_on)
    last = np.flatnonzero(has & ~np.append(goes_on[1:], False)) if len(a) else begin
    left, right = a[begin], a[last] + K
    long = right - left >= SPAN
    left, right = left[long], right[long]
    # windows that no factor holds
    inside = np.zeros(len(p.h) + 1, np.int32)
    np.add.at(inside, left, 1)
    np.add.at(inside, right - SPAN + 1, -1)
    inside = np.cumsum(inside)
    is_shared, is_later = np.zeros((2, len(p.h) + 1), bool)
    is_shared[a[shared]], is_later[a[earlier]] = True, True
    open_ = (inside[p.windows] == 0) & is_shared[p.chosen]
    at = p.windows[open_]
    whole, _ = W.grams(p.h, w.doc, SPAN)
    whole = whole[at] if len(at) else np.zeros(0, np.uint64)
    # a window that repeats within its document is settled here
    _, once = np.unique(W.mix(whole ^ W.mix(w.doc[at].astype(np.uint64))), return_index=True)
    again = np.ones(len(at), bool)
    again[once] = False
    left, right = np.concatenate([left, at[again]]), np.concatenate([right, at[again] + SPAN])
    once = np.sort(once)
    return p, left, right, at[once], whole[once], is_later[p.chosen[open_]][once]


def _parsed(batch: pa.RecordBatch):
    """Pieces of a batch of documents, parsed."""
    document, refs = batch.column("document"), batch.column("refs")
    texts = document.field("text").to_pylist()
    ids = document.field("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    for i, j in W.chunks(texts):
        yield i, j, texts[i:j], ids[i:j], _factor(texts[i:j], ids[i:j], *_flat(refs.slice(i, j - i)))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        placed = np.asarray(batch.column("document").field("doc_id").is_valid())
        for i, j, _, ids, (p, _, _, at, whole, later) in _parsed(batch):
            has = placed[i:j][p.w.doc[at]]
            at, whole, later = at[has], whole[has], later[has]
            yield pa.RecordBatch.from_arrays(
                [pa.array(whole.view(np.int64)), pa.array(ids[p.w.doc[at]]), pa.array(later)], names=["window", "ord", "later"]
            )


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, texts, _, (p, left, right, at, whole, _) in _parsed(batch):
            w = p.w
            first, total = w.first, len(w.starts)
            row, (late,) = _flat(batch.column("late").slice(i, j - i))
            wanted = np.unique(W.mix(late.view(np.uint64) ^ W.mix(row.astype(np.uint64))))
            if len(wanted):
                mine = W.mix(whole ^ W.mix(w.doc[at].astype(np.uint64)))
                there = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                at = at[wanted[there] == mine]
                left, right = np.concatenate([left, at]), np.concatenate([right, at + SPAN])
            mark = np.zeros(total + 1, np.int32)
            np.add.at(mark, left, 1)
            np.add.at(mark, right, -1)
            gone = np.cumsum(mark[:total]) > 0
            gone_before = np.concatenate([[0], np.cumsum(gone)])
            n_words, n_removed = np.diff(first), gone_before[first[1:]] - gone_before[first[:-1]]
            # where removed ranges begin and end
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
            new_doc = np.ones(total, bool)
            new_doc[1:] = w.doc[1:] != w.doc[:-1]
            left = np.flatnonzero(gone & ((edge == 1) | new_doc))
            end_doc = np.append(new_doc[1:], True)
            right = np.flatnonzero(gone & (np.append(~gone[1:], True) | end_doc)) + 1
            span_doc = w.doc[left]
            kept = list(texts)
            bounds = np.searchsorted(span_doc, np.arange(j - i + 1))
            for d in np.unique(span_doc):
                text, zero, parts, done = texts[d], w.begins[d], [], 0
                for s in range(bounds[d], bounds[d + 1]):
                    parts.append(text[done : w.starts[left[s]] - zero])
                    done = w.starts[right[s]] - zero if right[s] < first[d + 1] else len(text)
                kept[d] = "".join(parts) + text[done:]
            zero = first[span_doc]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("document").slice(i, j - i), pa.array(n_words), pa.array(n_removed),
                    _lists(span_doc, j - i, ["begin", "end"], [pa.array((left - zero).astype(np.int32)), pa.array((right - zero).astype(np.int32))]),
                    pa.array(kept, pa.string()),
                ],
                names=["document", "n_words", "n_removed", "removed", "kept"],
            )


_SPANS = "array<struct<begin:int,end:int>>"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every document without the words of windows that also start earlier in the corpus.

    A window is ``SPAN`` consecutive words of one document; earlier is a smaller ``doc_id``, or an
    earlier start in the same document. Windows are judged on the given texts. Result, one row per
    given row: ``document`` (a struct of all given columns, so extra columns of any name pass
    through), ``n_words``, ``n_removed``, ``removed`` (ranges of word numbers) and ``kept`` (the
    text without the removed words; the white space after them goes too).

    Null text: no words, ``kept`` null. Empty and white-space texts: no words, kept as they are.
    Documents without ``doc_id`` have no place in the order: they lose only what repeats within them,
    and remove nothing from others. Repeated rows of one ``doc_id`` are one document: each keeps what the other
    keeps. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("ord"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
    )
    anchors = (
        docs.where("doc_id is not null and text is not null")
        .select(F.col("doc_id").cast("long").alias("ord"), "text")
        .mapInArrow(_anchor_rows, "anchor long, ord long, pos int")
    )
    index = (
        anchors.groupBy("anchor")
        .agg(F.min("ord").alias("ref"), F.min_by("pos", "ord").alias("ref_pos"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    refs = (
        anchors.select("anchor", "ord").join(index, "anchor")
        .groupBy("ord")
        .agg(F.collect_list(F.struct("anchor", "ref", "ref_pos")).alias("refs"))
    )
    parsed = rows.join(refs, "ord", "left")
    windows = parsed.mapInArrow(_window_rows, "window long, ord long, later boolean")
    firsts = (
        windows.groupBy("window").agg(F.min("ord").alias("first"), F.max("later").alias("checked"))
        .where("checked")
        .select("window", "first")
    )
    late = (
        windows.where("later").join(firsts, "window").where("ord > first")
        .groupBy("ord")
        .agg(F.collect_set("window").alias("late"))
    )
    span = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([
        rows.schema["document"],
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.StringType()),
    ])
    here = F.col("document.doc_id").isNotNull()
    return (
        parsed.join(late, "ord", "left")
        .select("document", F.when(here, F.col("refs")).alias("refs"), F.when(here, F.col("late")).alias("late"))
        .mapInArrow(_kept_rows, schema)
    )


def digest(removed: DataFrame) -> DataFrame:
    """The contract's columns of ``remove_repeats``."""
    joined = F.trim(F.regexp_replace(F.coalesce("kept", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return removed.select(
        F.col("document.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(joined, 256).alias("kept_sha256")
    )
