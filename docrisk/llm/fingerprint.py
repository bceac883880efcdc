"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

Each paragraph is hashed to a wide vector, and the fingerprint is the sum of the paragraphs' vectors,
lane by lane, modulo 2^32. So the order of paragraphs does not matter, and a fingerprint is kept up to
date by adding the vectors of paragraphs that come and taking off those that go (``plus``, ``minus``);
the rest of the text is not read again.

A paragraph's vector has three parts. ``IDENTITY`` lanes are the SHA-256 of the paragraph: they tell
different multisets apart. One lane counts words. ``LIKENESS`` lanes count, for each bit of a hash of a
word with the word behind it, the pairs that have that bit: with the count they are sums of +1 and -1, whose
products estimate how many pairs two texts share, so likeness is read from fingerprints alone.

Everything is expressions on whole rows in the JVM; a text is never exploded, so there is no shuffle by
paragraph or word and no hot one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrisk.llm.scratch import cut

#: Lanes of 32 bits. Bits of a pair's hash are taken BYTES times 8 at a time.
IDENTITY, BYTES = 8, 7
LIKENESS = 8 * BYTES
MASK = (1 << 32) - 1
#: Pairs that are counted in bytes before they are added to lanes; a byte holds no more.
RUN = 255
#: The lowest bit of each byte.
LOW = sum(1 << 8 * i for i in range(BYTES))
BLANK = " \t\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def paragraphs(text: Column) -> Column:
    """Lines without blanks at their ends, but for empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), lambda p: F.btrim(p, F.lit(BLANK))), lambda p: p != "")


def _hex(digits: Column, begin: int, n: int) -> Column:
    return F.conv(F.substring(digits, begin + 1, n), 16, 10).cast("bigint")


def _pairs(paragraph: Column) -> Column:
    """A hash of each word with the one behind it (the last stands alone)."""
    words = F.split(paragraph, r"[\x20\x09-\x0D]+")
    pair = lambda a, b: _hex(F.md5(F.concat_ws(" ", a, b)), 0, 2 * BYTES)
    return _let(words, lambda w: F.zip_with(w, F.slice(w, 2, F.size(w)), pair))


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda total, v: total + of(v))


def vector(text: Column) -> Column:
    """The vector of a text (null: empty) as ``array<bigint>``: ``IDENTITY`` lanes, the count, ``LIKENESS`` lanes."""

    def lanes(found: Column, pairs: Column) -> Column:
        begins = F.when(F.size(pairs) > 0, F.sequence(F.lit(0), F.size(pairs) - 1, F.lit(RUN))).otherwise(F.array().cast("array<int>"))
        # a run's bits at distance 8 are added within one number, a byte for each
        counted = lambda run: F.array(*[_sum(run, lambda h, s=s: F.shiftright(h, s).bitwiseAND(F.lit(LOW))) for s in range(8)])
        runs = F.transform(begins, lambda b: _let(F.slice(pairs, b + 1, RUN), counted))
        bits = lambda rs: [_sum(rs, lambda r, s=s, f=f: F.shiftright(r[s], 8 * f).bitwiseAND(F.lit(255))) for s in range(8) for f in range(BYTES)]
        whole = lambda hs: [_sum(hs, lambda h, i=i: _hex(h, 8 * i, 8)) for i in range(IDENTITY)]
        named = _let(F.transform(found, lambda p: F.sha2(p, 256)), lambda hs: F.array(*whole(hs)))
        liked = _let(runs, lambda rs: F.array(*bits(rs)))
        return _modulo(F.concat(named, F.array(F.size(pairs).cast("bigint")), liked))

    found = paragraphs(F.coalesce(text, F.lit("")))
    return _let(found, lambda ps: _let(F.flatten(F.transform(ps, _pairs)), lambda pairs: lanes(ps, pairs)))


def _modulo(lanes: Column) -> Column:
    return F.transform(lanes, lambda x: x.bitwiseAND(F.lit(MASK)))


def plus(a: Column, b: Column) -> Column:
    """The vector of the paragraphs of both."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MASK)))


def minus(a: Column, b: Column) -> Column:
    """The vector of ``a``'s paragraphs without those of ``b``."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MASK)))


def shown(lanes: Column) -> Column:
    """A vector as text: eight hex digits a lane."""
    return F.concat_ws("", F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """How alike the texts of two vectors are, from 0 to 1: the cosine of their counts of word pairs, as
    estimated from ``LIKENESS`` lanes (within about 0.13), 1 for equal vectors and 0 where one has no words."""
    count = IDENTITY
    signed = lambda v: F.transform(F.slice(v, count + 2, LIKENESS), lambda x: (2 * x - v[count]).cast("double"))
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)

    def cosine(x: Column, y: Column) -> Column:
        length = F.sqrt(product(x, x) * product(y, y))
        return F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), product(x, y) / length))).otherwise(0.0)

    return F.when(a == b, 1.0).otherwise(_let(F.struct(signed(a).alias("x"), signed(b).alias("y")), lambda s: cosine(s["x"], s["y"])))


_KEY = ("none", "id", "h")


def _followers(keys: DataFrame) -> DataFrame:
    """Each key (different ones, ``_KEY``) with the next in order as ``next``; the first follows the last.

    Keys alone are dealt out by ranges and written; each range is then one window. The first keys of all
    ranges, as many as there are partitions, link one range to the next.
    """
    ranged = cut(keys.repartitionByRange(*_KEY).withColumn("range", F.spark_partition_id()))
    key = F.struct(*_KEY)
    firsts = ranged.groupBy("range").agg(F.min(key).alias("first"))
    in_order = Window.orderBy("range")
    onward = F.coalesce(F.lead("first").over(in_order), F.first("first").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    behind = firsts.select("range", onward.alias("behind"))
    within = ranged.withColumn("next", F.lead(key).over(Window.partitionBy("range").orderBy(*_KEY)))
    return within.join(F.broadcast(behind), "range").select(*_KEY, "n", F.coalesce("next", "behind").alias("next"))


def edited(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_text``, ``vector``, ``edited_vector``, ``next_vector`` of every row.

    The edited text ends in the first code points of the next document's text in place of the last quarter
    (rounded down) of its own, or in all of them if that has fewer. Documents are in order of ``doc_id``;
    rows without one come last, and rows of one id in the order of a hash of their texts. Rows that repeat
    id and text are one document and give equal results. The last document is followed by the first, a
    single one by itself. Null texts count as empty. Other columns are not looked at, whatever their names.
    An empty table gives an empty result.

    The edited vector is not worked out anew: paragraphs before the edited one stand, those behind are taken
    off and the new ones added. Texts are shuffled once, with their vectors, by their key; both joins read
    that exchange. What goes from a document to the one before is a head and a vector.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("t"))
    keyed = held.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("t").alias("h"), "t")
    rows = keyed.select(*_KEY, "t", vector(F.col("t")).alias("vector"))
    keys = keyed.select(*_KEY, F.length("t").alias("n")).groupBy(*_KEY).agg(F.min("n").alias("n"))
    followers = _followers(keys)
    wanted = followers.select("next.*", F.struct(*_KEY).alias("of"), F.expr("n div 4").cast("int").alias("most"))
    heads = rows.join(wanted, [*_KEY]).select("of.*", F.expr("substring(t, 1, most)").alias("head"), F.col("vector").alias("next_vector"))
    met = rows.join(heads.dropDuplicates([*_KEY]), [*_KEY])
    n = F.length("t")
    kept = F.expr("substring(t, 1, length(t) - length(t) div 4)")
    begun = met.select("none", "id", "t", "vector", "head", "next_vector", n.alias("n"), kept.alias("kept"))
    # where the paragraph begins in which the text is cut
    at = F.length("kept") - F.length(F.substring_index("kept", "\n", -1))
    parted = begun.select("none", "id", "t", "vector", "n", "next_vector", F.concat("kept", "head").alias("edited_text"), at.alias("at"))
    tail = lambda c: F.substring(c, F.col("at") + 1, F.length(c))
    hashed = parted.select(
        "none", "id", "n", "edited_text", "vector", "next_vector",
        vector(tail(F.col("t"))).alias("gone"), vector(tail(F.col("edited_text"))).alias("come"),
    )
    return hashed.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), F.col("n").cast("bigint").alias("n_chars"), "edited_text", "vector",
        plus(minus(F.col("vector"), F.col("gone")), F.col("come")).alias("edited_vector"), "next_vector",
    )


def digest(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, both fingerprints and the likenesses."""
    v, e, n = F.col("vector"), F.col("edited_vector"), F.col("next_vector")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), shown(v).alias("fingerprint"), shown(e).alias("edited_fingerprint"),
        likeness(v, e).alias("near_edited"), likeness(v, n).alias("near_next"),
    )
