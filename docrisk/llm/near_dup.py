"""Near duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of words. Its k-mers of ``K`` words are labelled with their occurrence, so
that repeats differ. For each of ``SKETCHES`` hash functions the ``PICKED`` labelled k-mers with the
smallest hashes are taken and put back into text order; the hash of that sequence is one value of
the sketch. Two texts agree in a value if both chose the same k-mers in the same order, which edits
and rearrangements make unlikely alike. Texts that share a value are candidates; a banded alignment
of their words finds the edit distance, and texts are near duplicates if it is at most ``1 - LEAST``
of the longer text's words. Groups are the connected components of these links.

Texts that share a value are not paired with one another but with the value's leader, the smallest
id. Duplicates of a leader are compared with others only where the edit distances, by the triangle
inequality, leave it possible that they are linked. What is left meets by rare words: duplicates have
so many words in common that one is among the rarest fifth of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrisk.llm import words as W
from docrisk.llm.components import components
from docrisk.llm.scratch import Shelf, small_batches

#: Words of a k-mer, and least similarity of duplicates (1 - edits by words of the longer text).
K, LEAST = 5, 0.8
#: Values of a sketch, and k-mers of each.
SKETCHES, PICKED = 64, 3
#: Texts whose words, in any order, differ by more than this many times the greatest distance of duplicates
#: are far apart; beyond 2.5 times, no duplicate of one text can be one of the other.
FAR = 3.0
#: Texts of a group above which they are kept from meeting one another by their words.
LARGE = 32
#: Rarer words that are looked at for whether two texts have met by one of them.
BACK = 16
#: Hashes handled at once.
CELLS = 1 << 20


def multipliers(n: int) -> np.ndarray:
    """Odd 64-bit numbers, one for each hash function."""
    return W.mix(np.arange(1, n + 1, dtype=np.uint64) * W.STEP) | np.uint64(1)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """Each k-mer's hash with its occurrence (0 for the first) mixed in."""
    order = np.argsort(kmers, kind="stable")
    of = kmers[order]
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    begin = np.flatnonzero(new)
    occurrence = np.empty(len(of), np.uint64)
    occurrence[order] = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
    return W.mix(kmers + occurrence * W.CHAIN)


def values(kmers: np.ndarray, n: int, picked: int) -> np.ndarray:
    """``n`` sketch values of ``picked`` labelled k-mers each."""
    found = []
    by = multipliers(n)
    step = max(1, CELLS // len(kmers))
    for s in range(0, n, step):
        hashed = (by[s : s + step, None] * kmers >> np.uint64(32)).astype(np.uint32)
        at = np.argpartition(hashed, picked - 1, axis=1)[:, :picked]
        at.sort(axis=1)
        value = by[s : s + step].copy()
        for t in range(picked):
            value = W.mix(value * W.CHAIN + kmers[at[:, t]])
        found.append(value)
    return np.concatenate(found)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a text, given its words' hashes; empty for a text without words.

    ``K - 1`` marks stand before and behind the text, so a text of n words has n + K - 1 k-mers: words at
    its ends are in as many as others, and the shortest text has more than ``PICKED``. One rule holds for
    all lengths.
    """
    if not len(hashes):
        return np.zeros(0, np.uint64)
    mark = np.full(K - 1, W.CHAIN, np.uint64)
    hashes = np.concatenate([mark, hashes, ~mark])
    kmers, _ = W.grams(hashes, np.zeros(len(hashes), np.int8), K)
    return values(labelled(kmers), SKETCHES, PICKED)


def copy_keys(w: W.Words, hashes: np.ndarray) -> list[np.ndarray]:
    """Two independent hashes of each text's whole sequence of words."""
    place = np.arange(len(hashes)) - w.first[w.doc]
    keys = []
    for base in (W.STEP, W.CHAIN):
        power = W.mix(place.astype(np.uint64) * base + base)
        total = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(hashes ^ base) * power)])
        keys.append(W.mix(total[w.first[1:]] - total[w.first[:-1]] + np.diff(w.first).astype(np.uint64)).view(np.int64))
    return keys


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in W.chunks(texts):
            w = W.words(texts[i:j])
            one, two = copy_keys(w, w.hashes())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(one), pa.array(two)], names=["id", "one", "two"])


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in W.chunks(texts):
            w = W.words(texts[i:j])
            hashes = w.hashes()
            one, two = copy_keys(w, hashes)
            sketches = [sketch(hashes[w.first[d] : w.first[d + 1]]).view(np.int64) for d in range(j - i)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(i, j - i), pa.array(one), pa.array(two),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *sketches]))),
                ],
                names=["id", "one", "two", "sketch"],
            )


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's words as 32-bit hashes."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in W.chunks(texts):
            w = W.words(texts[i:j])
            short = (w.hashes() >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(short))], names=["id", "words"]
            )


def _bag_apart(a: np.ndarray, b: np.ndarray) -> int:
    """Words that one text has more often than the other, in any order: no fewer edits will do."""
    both, sign = np.concatenate([a, b]), np.repeat([1, -1], [len(a), len(b)])
    order = np.argsort(both, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], both[order][1:] != both[order][:-1]]))
    surplus = np.add.reduceat(sign[order], edge) if len(both) else both
    return int(max(surplus[surplus > 0].sum(), -surplus[surplus < 0].sum()))


class _Runs:
    """Lengths of equal runs of words between places of two sequences, by hashes of ranges."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        self.sums = [np.concatenate([[np.uint64(0)], np.cumsum(W.mix(x.astype(np.uint64) + W.STEP) * W.powers(W.STEP, len(x)))]) for x in (a, b)]
        self.unpower = W.powers(W.UNSTEP, max(len(a), len(b)) + 1)

    def __call__(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``i`` of the first and ``j`` of the second on are equal, ``most`` at most."""
        run = np.zeros(len(i), np.int64)
        bit = 1 << int(most.max(initial=0)).bit_length()
        one, two, ui, uj = self.sums[0][i], self.sums[1][j], self.unpower[i], self.unpower[j]
        while bit:
            some = np.flatnonzero(run + bit <= most)
            more = run[some] + bit
            same = (self.sums[0][i[some] + more] - one[some]) * ui[some] == (self.sums[1][j[some] + more] - two[some]) * uj[some]
            run[some[same]] += bit
            bit >>= 1
        return run


def _aligned(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Edit distances of some pairs of word sequences, or -1 if more than ``most``.

    The band holds the diagonals that d edits can reach, one more on either side for each edit. On
    each diagonal stands the furthest word of the first text that d edits reach; equal words behind
    it cost nothing. All pairs are aligned at once, d by d.
    """
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    runs = _Runs(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
    at_a, at_b = (np.concatenate([[0], np.cumsum(x)[:-1]]) for x in (n, m))
    last_a, last_b = len(runs.a) - 1, len(runs.b) - 1
    never = -(1 << 40)
    result = np.full(len(pairs), -1, np.int64)
    row = np.arange(len(pairs))
    reach = np.full((len(pairs), 1), -1, np.int64)
    for d in range(int(most.max(initial=-1)) + 1):
        k = np.arange(-d, d + 1)
        if d:
            wide = np.pad(reach, ((0, 0), (2, 2)), constant_values=never)
            # a word replaced, dropped from the first text, or added to it
            reach = np.maximum(np.maximum(wide[:, 1:-1], wide[:, 2:]) + 1, wide[:, :-2])
        else:
            reach = np.zeros((len(row), 1), np.int64)
        end = np.minimum(n[row][:, None], m[row][:, None] - k)
        reach = np.minimum(reach, end)
        reach[(reach < 0) | (reach + k < 0)] = never
        # words that follow on the diagonal and are equal
        i, j = at_a[row][:, None] + reach, at_b[row][:, None] + reach + k
        open_ = (reach >= 0) & (reach < end)
        if last_a >= 0 and last_b >= 0:
            open_ &= runs.a[np.clip(i, 0, last_a)] == runs.b[np.clip(j, 0, last_b)]
            r, c = np.nonzero(open_)
            reach[r, c] += runs(i[r, c], j[r, c], (end - reach)[r, c])
        at_end = (m - n)[row] + d
        done = (at_end >= 0) & (at_end <= 2 * d)
        done[done] = reach[np.flatnonzero(done), at_end[done]] >= n[row[done]]
        result[row[done]] = d
        stay = ~done & (most[row] > d)
        row, reach = row[stay], reach[stay]
        if not len(row):
            break
    return result


def apart(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """The least number of edits that each pair's words, in any order, need; where already their lengths
    differ by more than ``most``, that difference."""
    found = np.array([abs(len(a) - len(b)) for a, b in pairs], np.int64)
    for i in np.flatnonzero(found <= most):
        found[i] = _bag_apart(*pairs[i])
    return found


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """Edit distance of each pair of word sequences, or -1 if it is more than ``most``.

    Pairs that need more edits (``least``) are settled; the others are aligned, as many at a time as fill
    tables of bounded size.
    """
    result = np.full(len(pairs), -1, np.int64)
    least = apart(pairs, most) if least is None else least
    left = [i for i in range(len(pairs)) if least[i] <= most[i]]
    left.sort(key=lambda i: len(pairs[i][0]))
    at = 0
    while at < len(left):
        n, total = 0, 0
        while at + n < len(left) and n < 256 and (not n or total + len(pairs[left[at + n]][0]) <= CELLS // 8):
            total += len(pairs[left[at + n]][0])
            n += 1
        part = left[at : at + n]
        result[part] = _aligned([pairs[i] for i in part], most[part])
        at += n
    return result


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``near`` (duplicates) and ``within`` (not known to be far apart) of pairs.

    Only distances of duplicates are worked out: their band is narrow. Whether others are far apart is
    told by their words in any order, which can only understate it.
    """
    for batch in batches:
        flat = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column("words"), batch.column("other"))]
        pairs = [tuple(v[o[i] : o[i + 1]] for o, v in flat) for i in range(len(batch))]
        greatest = np.array([(1 - LEAST) * max(len(x), len(y)) + 1e-9 for x, y in pairs])
        far = np.floor(FAR * greatest).astype(np.int64)
        least = apart(pairs, far)
        d = distances(pairs, np.floor(greatest).astype(np.int64), least)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(d >= 0), pa.array(least <= far)], names=["a", "b", "near", "within"])


def _compared(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) with what ``_verified`` tells of them."""
    return (
        pairs.join(words.select(F.col("id").alias("b"), "words").hint("merge"), "b")
        .join(words.select(F.col("id").alias("a"), F.col("words").alias("other")).hint("merge"), "a")
        .select("a", "b", "words", "other")
        .mapInArrow(_verified, "a long, b long, near boolean, within boolean")
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's words, one a row; the lower half of ``token`` is the word's occurrence (0 for the first).
    The other columns are as given."""
    for batch in batches:
        offsets, words = batch.column("words").offsets.to_numpy(), batch.column("words").values.to_numpy(zero_copy_only=False)
        words = words[offsets[0] : offsets[-1]]
        if not len(words):
            continue
        text = np.repeat(np.arange(len(batch)), np.diff(offsets))
        order = np.lexsort((words, text))
        words, text = words[order], text[order]
        begin = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (text[1:] != text[:-1])]))
        occurrence = np.arange(len(words)) - np.repeat(begin, np.diff(np.append(begin, len(words))))
        columns = [*(batch.column(c).to_numpy()[text] for c in ("id", "form", "class_id")), (words.astype(np.int64) << 32) | occurrence]
        for i in range(0, len(words), CELLS):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + CELLS]) for c in columns], names=["id", "form", "class_id", "token"])


def _slack(n: Column) -> Column:
    """The greatest edit distance of duplicates of which the longer has ``n`` words."""
    return F.floor(n * (1 - LEAST) + 1e-9).cast("int")


def _rare_pairs(left: DataFrame, words: DataFrame, shelf: Shelf) -> DataFrame:
    """Pairs ``a`` < ``b`` of texts that share a value, are of different groups and have a rare word in common
    (``left``: ``value``, ``id``, ``class_id``). All duplicates are among them; a pair may come more than once.

    Let M be the words of the longer text and D the greatest distance of duplicates of that length. Duplicates
    have M - D words in common, repeated ones counted. So if all words are put in one order, whatever it is,
    the first common one has M - D - 1 others behind it in both. The order is from rarest to most
    frequent among these texts, so passages that many texts quote come last and bring few of them
    together. Words that only texts of one group have bring no one together and are left out, as are pairs
    that have met by one of the ``BACK`` words before.

    Texts of one group share even the rarest words. Those of groups of more than ``LARGE`` texts therefore meet texts of
    smaller groups, and one another by the highest bit in which the numbers of their groups differ: never
    texts of their own group.
    """
    texts = left.groupBy("id").agg(F.min("class_id").alias("class_id"), F.collect_list("value").alias("shared"))
    large = shelf.put("large", texts.groupBy("class_id").count().where(F.col("count") > LARGE).select("class_id", F.row_number().over(Window.orderBy("class_id")).alias("code")))
    bits = large.count().bit_length()
    # an id can have several texts
    formed = words.join(texts.select("id", "class_id").hint("merge"), "id").withColumn("form", F.xxhash64("words"))
    tokens = formed.mapInArrow(_numbered, "id long, form long, class_id long, token long")
    having = Window.partitionBy("token")
    counted = tokens.select("id", "form", "token", F.count("*").over(having).alias("texts"), (F.min("class_id").over(having) < F.max("class_id").over(having)).alias("meets"))
    ordered = (
        counted.groupBy("id", "form").agg(F.sort_array(F.collect_list(F.struct("texts", "token", "meets"))).alias("tokens"))
        .withColumn("n", F.size("tokens"))
        .withColumn("first", F.transform(F.slice("tokens", 1, _slack(F.col("n")) + 1), lambda t, at: F.struct(t["token"].alias("token"), at.alias("at"), t["meets"].alias("meets"))))
        .select("id", "n", F.filter("first", lambda t: t["meets"]).alias("rare"))
    )
    # files of few texts are read by few tasks; rows are made of words in all of them
    rare = shelf.put("rare", ordered.join(texts.hint("merge"), "id").join(large.hint("merge"), "class_id", "left")).repartition("id")

    def side(name: str, bit: int) -> DataFrame:
        parted = [F.when(F.shiftright("code", k).bitwiseAND(F.lit(1)) == bit, F.shiftright("code", k + 1) * 64 + k) for k in range(bits)]
        small = F.array(F.when(F.col("code").isNull() | F.lit(bit == 1), F.lit(-1)))
        slots = F.array_compact(F.concat(small, F.array(*parted)) if parted else small)
        met = F.slice(F.col("rare.token"), F.greatest(F.col("k") - BACK, F.lit(0)) + 1, F.least("k", F.lit(BACK))).alias("met")
        rows = rare.select("*", F.posexplode("rare").alias("k", "word")).select("id", "class_id", "shared", "n", "code", "word.*", met)
        return rows.select(F.explode(slots).alias("slot"), "token", F.struct("id", "class_id", "code", "n", "at", "met", "shared").alias(name))

    one, two = F.col("one"), F.col("two")
    longer = F.greatest("one.n", "two.n")
    common = longer - _slack(longer)
    possible = (
        (one["class_id"] != two["class_id"])
        & ((F.col("slot") >= 0) | two["code"].isNotNull() | (one["id"] < two["id"]))
        & (one["at"] <= one["n"] - common) & (two["at"] <= two["n"] - common)
        & ~F.arrays_overlap("one.met", "two.met") & F.arrays_overlap("one.shared", "two.shared")
    )
    pairs = side("one", 0).join(side("two", 1).hint("merge"), ["slot", "token"]).where(possible)
    return pairs.select(F.least("one.id", "two.id").alias("a"), F.greatest("one.id", "two.id").alias("b"))


def groups(members: DataFrame, words: DataFrame, shelf: Shelf) -> DataFrame:
    """``id`` and ``class_id`` (smallest id of its group) of all texts that are duplicates of others
    with which they share a value (``members``: ``value``, ``id``); ``words`` has the texts by ``id``.

    The texts of a value are compared with its leader, the smallest id. Two texts of which one is a
    duplicate of the leader and the other is far from it need no comparison, nor do texts of one group. So
    a text goes on if it is no duplicate of its leader, or fails one closely, or is a duplicate of a leader
    that another failed closely, and a value if texts of several groups are left in it. Those that go on
    meet as ``_rare_pairs`` says, and all pairs that meet are compared.

    Tables are written before they are used again. Joins are merge joins, so no table goes through the driver.
    """
    leading = members.groupBy(F.col("value").alias("of")).agg(F.min("id").alias("lead"))
    met = members.join(leading.hint("merge"), (F.col("value") == F.col("of")) & (F.col("id") != F.col("lead")))
    # a leader is its value's smallest id
    led = shelf.put("led", met.select("value", "id", F.col("lead").alias("a"), F.col("id").alias("b")))
    checked = shelf.put("checked", _compared(led.select("a", "b").distinct(), words))
    near = checked.where("near").select("a", "b")
    labels = members.sparkSession.createDataFrame([], "id long, class_id long") if near.isEmpty() else _merged(None, near, shelf)
    judged = led.join(checked.hint("merge"), ["a", "b"]).withColumn("close", F.col("within") & ~F.col("near"))
    missed = judged.groupBy("value").agg(F.max("close").alias("missed"))
    going = (
        judged.join(missed.hint("merge"), "value")
        .groupBy("value", "id")
        .agg(F.max(F.col("near") & F.col("missed")).alias("wanted"), (F.max("close") | ~F.max("near")).alias("apart"))
        .where("apart or wanted")
        .join(labels.hint("merge"), "id", "left")
        .select("value", "id", "apart", F.coalesce("class_id", "id").alias("class_id"))
    )
    going = shelf.put("going", going)
    # duplicates of a leader are in one group
    several = going.groupBy("value").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.max("apart").alias("any"))
    left = shelf.put("left", going.join(several.where("low < high and any").select("value").hint("merge"), "value").select("value", "id", "class_id"))
    if not left.isEmpty():
        pairs = shelf.put("pairs", _rare_pairs(left, words, shelf).distinct().join(checked.hint("merge"), ["a", "b"], "left_anti"))
        near = shelf.put("found", _compared(pairs, words)).where("near").select("a", "b")
        if not near.isEmpty():
            labels = _merged(labels, near, shelf)
    shelf.drop("led", "checked", "going", "left", "large", "rare", "pairs", "found", "between", "renamed")
    return labels


def _merged(labels: DataFrame | None, near: DataFrame, shelf: Shelf) -> DataFrame:
    """Groups with further links: the links between groups are followed, then all are renamed."""
    if labels is None:
        return shelf.put("labels", components(near, shelf, "renamed"))
    a = labels.select(F.col("id").alias("a"), F.col("class_id").alias("ca"))
    b = labels.select(F.col("id").alias("b"), F.col("class_id").alias("cb"))
    joined = near.join(a.hint("merge"), "a", "left").join(b.hint("merge"), "b", "left")
    between = shelf.put("between", joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct())
    renamed = components(between, shelf, "renamed").select(F.col("id").alias("old"), F.col("class_id").alias("new"))
    kept = labels.join(renamed.hint("merge"), F.col("class_id") == F.col("old"), "left").select("id", F.coalesce("new", "class_id").alias("class_id"))
    fresh = renamed.join(labels.select(F.col("id").alias("old")).hint("merge"), "old", "left_anti").select(F.col("old").alias("id"), F.col("new").alias("class_id"))
    return shelf.put("labels", kept.unionByName(fresh))


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``class_id`` of every given row: the smallest ``doc_id`` of its group.

    A group is what links of at least ``LEAST`` similarity connect; words are longest runs of other
    code points than U+0020 and U+0009 to U+000D, compared as they stand, so texts that differ in
    white space alone are copies. Empty and white-space texts are copies of one another. Null texts are in no group: their class
    is their own id. Rows without ``doc_id`` have no class (null) and take no part. Repeated rows of
    one id are one document. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shelf = Shelf(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    distinct = (
        texts.mapInArrow(_sketch_rows, "id long, one long, two long, sketch array<long>")
        .groupBy("one", "two").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"))
    )
    shown = distinct.select("id", F.explode("sketch").alias("value"))
    shared = shown.groupBy("value").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("value")
    members = shelf.put("shared", shown.join(shared, "value").select("value", "id").distinct())
    words = shelf.put("words", texts.join(members.select("id").distinct(), "id").mapInArrow(_word_rows, "id long, words array<int>").distinct())
    linked = groups(members, words, shelf)
    shelf.drop("shared", "words")
    first = texts.mapInArrow(_key_rows, "id long, one long, two long")
    copies = first.groupBy("one", "two").agg(F.min("id").alias("copy_of"))
    known = (
        first.join(copies, ["one", "two"])
        .join(linked.select(F.col("id").alias("copy_of"), "class_id"), "copy_of", "left")
        .select("id", F.coalesce("class_id", "copy_of").alias("class_id"))
    )
    rest = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("doc_id is null or text is null").select("id", F.col("id").alias("class_id"))
    return known.unionByName(rest).withColumnRenamed("id", "doc_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The given rows, all columns as they are, one for each group: the one with the smallest
    ``doc_id`` (of its repeated rows, one). Rows without ``doc_id`` all stay."""
    mark = "kept"
    while mark in docs.columns:
        mark += "_"
    kept = classes(docs).where("doc_id = class_id").select(F.col("doc_id").alias(mark)).distinct()
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col(mark), "left_semi")
    repeat = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    return named.withColumn(mark, repeat).where(F.col(mark) == 1).drop(mark).unionByName(docs.where("doc_id is null"))
