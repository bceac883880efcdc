"""How filters of documents interact: what each removes in every order, and its fair share.

Whether a document fails each of the five filters is one number of five bits. Counting documents by part
and that number gives what every one of the 32 coalitions of filters removes: all documents that fail one
of them at least. Everything asked for follows from these 32 counts: a step of an order removes the
difference of two coalitions, and a filter's Shapley value is the solution of a least-squares problem.
The value of every coalition is fitted by the sum of its filters' values, weighted by the Shapley kernel,
with the values of all filters adding up to what all of them remove. Its normal equations do not depend on
the counts, so they are solved once in rationals, for each coalition's count as a unit; with the counts
put in, the sums over all orders are whole numbers, exactly.

Documents are read once. Copies of one text are counted by partial aggregation before they are shuffled,
so a text that holds a third of all rows is a few rows; a part is one row of 32 counts.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: Fewest words; least per cent of different words; most per cent of capitals; signs that no text may hold.
WORDS, VARIETY, CAPITALS, SIGNS = 50, 65, 5, r"[#$%&*|]"


def _size(coalition: int) -> int:
    return bin(coalition).count("1")


def shapley_weights(m: int) -> list[list[Fraction]]:
    """For each of ``m`` filters, the factor of every coalition's value in its Shapley value.

    Minimises the sum over coalitions S, neither empty nor whole, of k(S) (v(S) - v(none) - sum of S's
    values)^2 with k(S) = (m - 1) / (C(m, |S|) |S| (m - |S|)), the values' sum held to v(all) - v(none).
    The last unknown is the multiplier of that condition.
    """
    inner = [s for s in range(1, 1 << m) if s != (1 << m) - 1]
    kernel = {s: Fraction(m - 1, comb(m, _size(s)) * _size(s) * (m - _size(s))) for s in inner}
    everyone = (1 << m) - 1

    def row(i: int) -> list[Fraction]:
        """Normal equation of filter ``i``: unknowns, then the factors of all coalitions' values."""
        left = [sum((kernel[s] for s in inner if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(m)]
        right = [Fraction(0)] * (1 << m)
        for s in inner:
            if s >> i & 1:
                right[s] += kernel[s]
                right[0] -= kernel[s]
        return [*left, Fraction(1), *right]

    held = [Fraction(1)] * m + [Fraction(0)] + [Fraction((s == everyone) - (s == 0)) for s in range(1 << m)]
    table = [row(i) for i in range(m)] + [held]
    for k in range(m + 1):
        pivot = next(r for r in range(k, m + 1) if table[r][k])
        table[k], table[pivot] = table[pivot], table[k]
        table[k] = [x / table[k][k] for x in table[k]]
        for r in range(m + 1):
            if r != k and table[r][k]:
                table[r] = [x - table[r][k] * y for x, y in zip(table[r], table[k], strict=True)]
    return [table[i][m + 1 :] for i in range(m)]


def failures(text: Column) -> list[Column]:
    """Whether a text fails each filter that looks at it alone; all of them are false or true, never null."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # the words are bound once: written twice, they would be searched twice
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different")))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    both = F.transform(
        F.array(counted),
        lambda c: F.struct((c["n"] < WORDS).alias("few"), (c["different"].cast("bigint") * 100 < c["n"].cast("bigint") * VARIETY).alias("dull")),
    )[0]
    return [both, capitals.cast("bigint") * 100 > F.length(text).cast("bigint") * CAPITALS, text.rlike(SIGNS)]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask`` (bit i: fails filter i), ``n``, ``good``, ``toxic``: documents counted.

    ``part`` is the source, null as the empty string. Null texts count as empty, and so as copies of
    empty ones. E fails where the text is that of a smaller ``doc_id``; rows without ``doc_id`` neither
    fail E nor make another fail it, and have no label; repeated rows of an id count one each. An id that has
    several labels is good (toxic) if one of them says so.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the text's own columns first, so that what is read of a row is its text, id and source alone
    judged = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    words, capitals, signs = failures(F.col("t"))
    judged = judged.select("id", "part", F.sha2("t", 256).alias("key"), words.alias("w"), capitals.alias("c"), signs.alias("d"))
    bits = [F.col("w.few"), F.col("w.dull"), F.col("c"), F.col("d")]
    own = sum((F.when(bit, 1 << i).otherwise(0) for i, bit in enumerate(bits)), F.lit(0))
    # rows without an id meet no label; by their texts they spread over all tasks
    named = F.coalesce("id", F.xxhash64("key")).alias("at")
    judged = judged.select(named, F.col("id").isNull().alias("none"), "part", F.unhex("key").alias("key"), own.alias("own"))
    wanted = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("at"), F.lit(False).alias("none")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("g"), F.max((F.col("toxic") == 1).cast("int")).alias("x")
    )
    texts = ["key", "part", "own", F.coalesce("g", F.lit(0)).alias("good"), F.coalesce("x", F.lit(0)).alias("toxic")]
    rows = judged.join(wanted, ["at", "none"], "left").groupBy("at", "none", *texts).agg(F.count("*").alias("n"))
    # rows of one text, part and labels become one, with the smallest id and how many rows have that
    alike = rows.groupBy("key", "part", "own", "good", "toxic").agg(
        F.min(F.struct("none", "at", "n")).alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("none"), F.col("n")).otherwise(0)).alias("unnamed")
    )
    lowest = F.min(F.when(~F.col("first.none"), F.col("first.at"))).over(Window.partitionBy("key"))
    placed = alike.select("part", "own", "good", "toxic", "n", "unnamed", "first", lowest.alias("lowest"))
    at_lowest = ~F.col("first.none") & (F.col("first.at") == F.col("lowest"))
    passing = F.col("unnamed") + F.when(at_lowest, F.col("first.n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("own").alias("mask"), passing.alias("count")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - passing).alias("count"))
    )
    counted = placed.select("part", "good", "toxic", F.explode(sides).alias("side")).where("side.count > 0")
    return counted.groupBy("part", F.col("side.mask").alias("mask")).agg(
        F.sum("side.count").alias("n"), F.sum(F.col("side.count") * F.col("good")).alias("good"), F.sum(F.col("side.count") * F.col("toxic")).alias("toxic")
    )


def removals(counts: DataFrame) -> DataFrame:
    """``part``, ``total`` and, for every coalition s of filters, what it removes: ``removed[s]``,
    ``good[s]``, ``toxic[s]`` (documents whose mask shares a bit with s)."""
    mask = F.col("mask")

    def table(column: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(mask.bitwiseAND(s) != 0, F.col(column))), F.lit(0)) for s in range(ALL + 1)])

    return counts.groupBy("part").agg(
        F.sum("n").alias("total"), table("n").alias("removed"), table("good").alias("good"), table("toxic").alias("toxic")
    )


def steps() -> list[tuple[str, int, int, int, int]]:
    """Every step of every order: the order, the step (from 1), its filter, and the coalitions before and
    after it."""
    found = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, i in enumerate(order):
            found.append(("".join(FILTERS[j] for j in order), k + 1, i, before, before | 1 << i))
            before |= 1 << i
    return found


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fails its filter, gone before),
    ``unique_fails`` (fails no other filter), ``good_lost``, ``toxic_lost``, and ``shapley``: what its
    filter removes at whatever step, summed over all orders. Columns but ``doc_id``, ``text`` and
    ``source`` are not looked at. Tables without documents have no part and so no row.
    """
    orders = factorial(len(FILTERS))
    factors = [[f * orders for f in row] for row in shapley_weights(len(FILTERS))]
    if any(f.denominator != 1 for row in factors for f in row):
        raise ArithmeticError("sums over all orders must be whole numbers")
    tables = removals(masks(docs, labels))
    values = F.array(*[sum((F.col("removed")[s] * int(f) for s, f in enumerate(row) if f), F.lit(0)) for row in factors])
    tables = tables.withColumn("values", values)
    step = "struct<filter_order: string, step: int, i: int, before: int, after: int>"
    listed = F.explode(F.array(*[F.struct(F.lit(o), F.lit(k), F.lit(i), F.lit(b), F.lit(a)) for o, k, i, b, a in steps()]).cast(f"array<{step}>"))
    rows = tables.select("part", "total", "removed", "good", "toxic", "values", listed.alias("s"))
    after, before = F.col("s.after"), F.col("s.before")
    alone = F.expr("shiftleft(1, s.i)")
    removed = F.get("removed", after) - F.get("removed", before)
    return rows.select(
        "part", "s.filter_order", "s.step",
        (F.col("total") - F.get("removed", after)).alias("kept"), removed.alias("removed"),
        (F.get("removed", alone) - removed).alias("redundant"),
        (F.get("removed", F.lit(ALL)) - F.get("removed", F.lit(ALL) - alone)).alias("unique_fails"),
        (F.get("good", after) - F.get("good", before)).alias("good_lost"),
        (F.get("toxic", after) - F.get("toxic", before)).alias("toxic_lost"),
        F.get("values", F.col("s.i")).alias("shapley"),
    )
