"""Fill-in-middle transformation by counted quantifiers.

A text is a run of units: white space with the word behind it, or the white space at the end. How many
units there are is counted by one pattern; two of their bounds are drawn from the document's id. A second
pattern, made for the row, then captures prefix, middle and suffix in one match: ``(unit{a})`` and
``(unit{b-a})`` with possessive quantifiers, which never give back, so the match is linear and takes no
stack however long the text is. The replacement of that match is the output.

All of it is column expressions of one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One unit. Each part takes all it can and gives nothing back; the second arm is left at the end alone.
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of documents that are transformed, and of these that begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 for a document: the first four groups of eight hex digits of the SHA-256 of
    the seed, a colon and the id (nothing behind the colon for a null id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def units(text: Column) -> Column:
    """How many units a text has."""
    return F.regexp_count(text, F.lit(UNIT)).cast("bigint")


def _match(a: Column, b: Column) -> Column:
    """The row's pattern: ``a`` units, ``b - a`` units, the rest."""
    first, second = F.least(a, b), F.greatest(a, b)
    return F.concat(
        F.lit(rf"(?s)\A({UNIT}{{"), first.cast("string"), F.lit(rf"}}+)({UNIT}{{"), (second - first).cast("string"), F.lit(r"}+)(.*+)\z")
    )


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``document`` (the given row) with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    The prefix ends after the smaller, the middle after the larger of two numbers from 0 to ``n`` that are
    drawn from the id alone. ``form`` is ``plain`` (output is the text; no
    lengths), ``psm`` (prefix, suffix, middle, each behind its mark) or ``spm`` (suffix first). Texts that
    are empty or hold a mark stay plain, so an output can always be read back. Null texts count as empty; a
    null id is drawn for as the empty string, so rows that repeat an id are cut at the same draws. Given
    columns of any name are kept inside ``document``. An empty table gives an empty result.
    """
    row = F.struct(*docs.columns).alias("document")
    text = F.coalesce(F.col("document.text").cast("string"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col("document.doc_id"), seed)
    held = docs.select(row).select("document", text.alias("t"))
    counted = held.select("document", "t", units(F.col("t")).alias("n"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("t").contains(mark)
    form = F.when((F.col("t") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    cut = counted.select("document", "t", "n", form.alias("form"), (h1 % (F.col("n") + 1)).alias("a"), (h2 % (F.col("n") + 1)).alias("b"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"))
    made = F.call_function("regexp_replace", F.col("t"), _match(F.col("a"), F.col("b")), order)
    done = cut.select("document", "n", "form", F.when(F.col("form") == "plain", F.col("t")).otherwise(made).alias("output"))
    lengths = [F.when(F.col("form") != "plain", F.length(p)).cast("bigint") for p in _parts()[::2]]
    return done.select("document", "n", "form", lengths[0].alias("prefix_chars"), lengths[1].alias("middle_chars"), "output")


def _parts() -> tuple[Column, Column, Column]:
    """Prefix, suffix and middle of an output that is not plain, read back from its marks. No piece holds a
    mark, and a mark that begins inside a piece cannot end in one: '<' begins and '>' ends each."""
    output, spm = F.col("output"), F.col("form") == "spm"
    at = {mark: F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE)}
    step = len(PREFIX)
    prefix = F.substring(output, at[PREFIX] + step, F.when(spm, at[MIDDLE]).otherwise(at[SUFFIX]) - at[PREFIX] - step)
    suffix = F.substring(output, at[SUFFIX] + step, F.when(spm, at[PREFIX]).otherwise(at[MIDDLE]) - at[SUFFIX] - step)
    middle = F.substring(output, at[MIDDLE] + step, F.length(output))
    return prefix, suffix, middle


def restore(transformed: DataFrame) -> DataFrame:
    """The rows of ``transform`` with ``restored``: the text, rebuilt from ``output`` and ``form`` alone."""
    prefix, suffix, middle = _parts()
    whole = F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat(prefix, middle, suffix))
    return transformed.withColumn("restored", whole)


def digest(transformed: DataFrame) -> DataFrame:
    """``doc_id``, ``n``, ``form``, lengths, and the SHA-256 of the output and of the text rebuilt from it."""
    return restore(transformed).select(
        F.col("document.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
