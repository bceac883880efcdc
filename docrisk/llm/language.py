"""Language by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled texts. A text is parsed
against each automaton into longest phrases that occur in that sample; many short phrases mean a
foreign text. The phrases of a parse times the bits to point into the sample, per character, estimate
the cross entropy; the language with the least wins. Parses run for many blocks of texts at once,
each step one lookup in a table in which a failed match has already begun the next phrase. A block
begins in the state in which the one before it ended, so the phrases are those of the whole text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrisk.llm import words as W
from docrisk.llm.labelled import remainder, texts_of
from docrisk.llm.scratch import small_batches

#: Characters of a text that are parsed as one block beside others; no phrase ends because a block does.
BLOCK = 256
#: Times that all blocks with a wrong begin are parsed again at once, before what is left is parsed in order.
ROUNDS = 6
#: Marks, in a table of transitions, those that begin a new phrase.
NEW = 1 << 30
UNKNOWN = "und"


@dataclass
class Model:
    """Languages; the class of each letter; all automata's transitions (state x class) one behind
    another; the state in which each begins; and the bits of a pointer into each sample."""

    languages: list[str]
    letters: dict[int, int]
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray


def _letter(c: str) -> int:
    """The lower case of a letter, a space for anything else."""
    return (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 32


def letter_folding() -> np.ndarray:
    """``_letter`` of each code point below 2^16; those above are rare and looked at one by one."""
    return np.array([_letter(c) for c in map(chr, range(1 << 16))], np.uint32)


def letter_classes(model: Model) -> np.ndarray:
    """Class of every code point; letters that no sample holds share one."""
    classes = np.full(sys.maxunicode + 1, len(model.letters), np.int32)
    classes[list(model.letters)] = list(model.letters.values())
    return classes


def folded(texts: list[str | None], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, one space (32) for whatever is between; text of each."""
    codes, begins = W.code_points(texts)
    far = codes >= len(fold)
    letters = fold[np.where(far, 0, codes)]
    if far.any():
        other, place = np.unique(codes[far], return_inverse=True)
        letters[far] = np.array([_letter(chr(c)) for c in other.tolist()], np.uint32)[place]
    doc = np.repeat(np.arange(len(texts)), np.diff(begins))
    space = letters == 32
    keep = np.ones(len(letters), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))
    return letters[keep], doc[keep]


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the empty match."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
        last = new
    return move


def fit(samples: dict[str, list[str]]) -> Model:
    """Automata of each language's sample texts; languages without a letter are left out."""
    fold = letter_folding()
    streams = {}
    for language in sorted(samples):
        stream, _ = folded(samples[language], fold)
        if (stream != 32).any():
            streams[language] = stream
    letters = {32: 0}
    for c in np.unique(np.concatenate([*streams.values(), np.array([32], np.uint32)])).tolist():
        letters.setdefault(c, len(letters))
    pad = len(letters) + 1
    tables, roots, bits, at = [], [], [], 0
    for stream in streams.values():
        move = automaton([letters[c] for c in stream.tolist()])
        # one state more: behind a letter that the sample lacks, and at a text's begin, the next letter begins a phrase
        fresh = len(move)
        table = np.full((fresh + 1, pad + 1), -1, np.int64)
        for state, to in enumerate(move):
            table[state, list(to)] = list(to.values())
        begin = np.where(table[0] >= 0, table[0], fresh) + at
        table = np.where(table >= 0, table + at, begin | NEW)
        table[:, pad] = np.arange(fresh + 1) + at
        tables.append(table.astype(np.int32))
        roots.append(at + fresh)
        bits.append(np.log2(len(stream) + 1))
        at += fresh + 1
    return Model(
        list(streams), letters, np.concatenate(tables) if tables else np.zeros((0, pad + 1), np.int32), np.array(roots, np.int64), np.array(bits)
    )


def learn(docs: DataFrame, *, n_chars: int = 15_000, n_docs: int = 60, seed: int = 11) -> Model:
    """Automata from at most ``n_docs`` documents of each language, and of these as many as
    ``n_chars`` characters hold (one at least), from learning rows only (crc32 of the id modulo 4
    not 2, lang not null). Documents are chosen by a seeded hash of the id, shorter ones than the
    bound first. ``lang`` is read here alone.
    """
    small_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        (remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    ids = (
        known.select("doc_id", "lang", (F.length("text") > n_chars).alias("long"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n_docs)
        .select("doc_id", "lang", "rank").distinct()
    )
    rows = texts_of(known.select("doc_id", "text"), ids).select("lang", "rank", "doc_id", "text").collect()
    samples: dict[str, list[str]] = {}
    total: dict[str, int] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.rank, r.doc_id, r.text)):
        if not total.get(row.lang) or total[row.lang] + len(row.text) <= n_chars:
            samples.setdefault(row.lang, []).append(row.text)
            total[row.lang] = total.get(row.lang, 0) + len(row.text)
    return fit(samples)


def _parse(table: np.ndarray, width: int, symbols: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States after the symbols (one row each) of some lanes, and phrases begun on the way."""
    begun = np.zeros(state.shape, np.int64)
    for row in symbols:
        to = table[state * width + row]
        begun += to >= NEW
        state = to & (NEW - 1)
    return state.astype(np.int64), begun


def costs(texts: list[str | None], model: Model, fold: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits a character of each text in each language, and whether a text has a letter.

    All blocks are parsed at once, as if each began a phrase. Greedy parses soon fall into step, so
    most blocks then end in the right state; those whose begin was wrong are parsed again from where
    the one before ended. What ``ROUNDS`` of that leave open (in texts that repeat themselves) is
    parsed block by block.
    """
    letters, doc = folded(texts, fold)
    width, pad = model.table.shape[1], model.table.shape[1] - 1
    n = np.bincount(doc, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(n)])
    within = np.arange(len(doc)) - begin[doc]
    blocks = -(-n // BLOCK)
    lane = (np.concatenate([[0], np.cumsum(blocks)])[doc] + within // BLOCK).astype(np.int64)
    grid = np.full((BLOCK, int(blocks.sum())), pad, np.int64)
    grid[within % BLOCK, lane] = classes[letters]
    of = np.repeat(np.arange(len(texts)), blocks)
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    table, roots = model.table.ravel(), model.roots[:, None]
    start = np.repeat(roots, len(of), axis=1)
    end, begun = _parse(table, width, grid, start)

    def again(language: np.ndarray, at: np.ndarray) -> None:
        start[language, at] = end[language, at - 1]
        end[language, at], begun[language, at] = _parse(table, width, grid[:, at], start[language, at])

    for _ in range(ROUNDS):
        language, at = np.nonzero(~first & (start != np.roll(end, 1, axis=1)))
        if not len(at):
            break
        again(language, at)
    while True:
        # the first open block of each text and language is final once it is parsed again
        wrong = ~first & (start != np.roll(end, 1, axis=1))
        language, at = np.nonzero(wrong)
        if not len(at):
            break
        _, one = np.unique(language * len(texts) + of[at], return_index=True)
        again(language[one], at[one])
    phrases = np.stack([np.bincount(of, row, len(texts)) for row in begun], axis=1)
    return phrases * model.bits / np.maximum(n, 1)[:, None], np.bincount(doc, letters != 32, len(texts)) > 0


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Every document with its language.

    One row per given row: ``document`` (a struct of all given columns), ``lang_pred`` and ``score``
    (0 to 1: the winner's share of 2 to the power of minus each language's cost). The whole text
    counts. Null texts and texts without a letter, and all texts if no language could be learned,
    get ``und`` and 0. Ties go to the language that sorts first. An empty table gives an empty
    result.
    """

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, classes = letter_folding(), letter_classes(model)
        for batch in batches:
            texts = batch.column("document").field("text").to_pylist()
            for i, j in W.chunks(texts):
                names, score = [UNKNOWN] * (j - i), np.zeros(j - i)
                if model.languages:
                    bits, lettered = costs(texts[i:j], model, fold, classes)
                    best = bits.argmin(axis=1)
                    share = 2.0 ** (bits.min(axis=1, keepdims=True) - bits)
                    score = np.where(lettered, 1 / share.sum(axis=1), 0.0)
                    names = [model.languages[b] if has else UNKNOWN for b, has in zip(best.tolist(), lettered.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("document").slice(i, j - i), pa.array(names, pa.string()), pa.array(score)],
                    names=["document", "lang_pred", "score"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    schema = T.StructType([rows.schema["document"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(predicted, schema)


def digest(predicted: DataFrame) -> DataFrame:
    """The contract's columns of ``predict``."""
    doc_id = F.col("document.doc_id")
    return predicted.select(
        doc_id.alias("doc_id"),
        F.coalesce(remainder(doc_id, 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
