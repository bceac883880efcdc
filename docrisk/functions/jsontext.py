"""Lenient reading of JSON that a text generator wrapped in fences or prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.functions.values import BLANKS, strip

# Appended after the text inside one array: if the text closes that array early, or holds more
# than one value, the sentinel is not the second element and the text is rejected.
_SENTINEL = "\u241eend"


def strip_fences(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the stripped text without a leading ```json or ``` and a trailing ```.

    Looks at both ends only; patterns would walk through the whole text several times, and so does trimming at
    the right end, which is left out where the text ends with a brace.
    """
    blanks = F.lit(BLANKS)
    c, given = F.col(out), F.col(text)
    end = F.length(c) - 3
    return (
        df.withColumn(out, F.when(given.endswith("}"), F.ltrim(given, blanks)).otherwise(strip(given)))
        .withColumn(out, F.when(F.lower(F.left(c, F.lit(7))) == "```json", F.ltrim(F.substring(c, 8, 2**31 - 1), blanks)).otherwise(c))
        .withColumn(out, F.when(c.startswith("```"), F.ltrim(F.substring(c, 4, 2**31 - 1), blanks)).otherwise(c))
        .withColumn(out, F.when(c.endswith("```"), F.rtrim(F.left(c, end), blanks)).otherwise(c))
    )


def braced(text: Column) -> Column:
    """The part from the first { to the last }, NULL when there is none."""
    return F.regexp_substr(text, F.lit(r"(?s)\{.*\}"))


def _wrapped(text: Column) -> Column:
    # try_parse_json ignores anything after the first value, hence the array with a sentinel
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_SENTINEL}"]')))


def _is_whole(wrapped: Column) -> Column:
    return F.coalesce(F.try_variant_get(wrapped, "$[1]", "string") == _SENTINEL, F.lit(False))


def whole_json(text: Column) -> Column:
    """The variant a text holds; NULL if it holds none, or anything behind it."""
    wrapped = _wrapped(text)
    return F.when(_is_whole(wrapped), F.try_variant_get(wrapped, "$[0]", "variant"))


def parse_lenient(df: DataFrame, text: str, out: str, objects_only: bool = False, source: str | None = None) -> DataFrame:
    """Add ``out``: the variant a text holds, after removing fences; failing that, the variant
    its braced part holds; else NULL.

    ``source`` names a column to add: the very text that ``out`` was read from, NULL where ``out`` is.

    ``objects_only`` also turns null and scalars into NULL. They are told apart by the first
    character of the text, which is cheaper than asking the parsed value. The text is parsed once,
    its braced part only where that failed.
    """
    whole = _is_whole(F.col("_all"))
    staged = (
        strip_fences(df, text, "_clean")
        .withColumn("_all", _wrapped(F.col("_clean")))
        .withColumn("_part", F.when(~whole, _wrapped(braced(F.col("_clean")))))
    )
    wanted = F.substring("_clean", 1, 1).isin("{", "[") if objects_only else F.lit(True)
    part = _is_whole(F.col("_part"))
    value = F.when(whole & wanted, F.try_variant_get("_all", "$[0]", "variant")).when(
        part, F.try_variant_get("_part", "$[0]", "variant")
    )
    added = {out: value}
    if source:
        added[source] = F.when(whole & wanted, F.col("_clean")).when(part, braced(F.col("_clean")))
    return staged.withColumns(added).drop("_clean", "_all", "_part")
