"""Value semantics of loosely typed input, as Column expressions.

The records come from JSON written by other services, so "missing", JSON null, numbers in
quotes and blank strings all occur and mean different things. These helpers keep the
differences; nothing here needs a Python worker.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# blanks as web clients know them: Java's \s plus the Unicode spaces it leaves out
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# the same characters one by one, for trimming: far cheaper than a pattern on long texts
BLANKS = "".join(
    [" \t\n\v\f\r\u00a0\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028\u2029\u202f\u205f\u3000\ufeff"]
)

# a word edge that knows ASCII letters, digits and _ only (Java's \b is Unicode aware)
WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def strip(text: Column) -> Column:
    """Remove leading and trailing blanks of every kind, not just U+0020."""
    return F.btrim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    """Strip and collapse inner runs of blanks to one space."""
    return F.regexp_replace(strip(text), rf"{BLANK}+", " ")


def drop_blanks(text: Column) -> Column:
    return F.regexp_replace(text, rf"{BLANK}+", "")


def non_empty(text: Column) -> Column:
    """The text, or NULL when it is empty."""
    return F.nullif(text, F.lit(""))


def first_text(*texts: Column) -> Column:
    """The first text that is neither NULL nor empty."""
    return F.coalesce(*[non_empty(t) for t in texts])


def first_number(*numbers: Column) -> Column:
    """The first number that is neither NULL nor zero."""
    return F.coalesce(*[F.nullif(n, F.lit(0)) for n in numbers])


def is_true(flag: Column) -> Column:
    """True or false, never NULL."""
    return F.coalesce(flag, F.lit(False))


# --- variants --------------------------------------------------------------------------


def member(value: Column, path: str) -> Column:
    """The variant at ``path``; NULL when the key is missing, a variant null for JSON null."""
    return F.try_variant_get(value, f"$.{path}", "variant")


def text_of(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "string")


def kind(value: Column) -> Column:
    """VOID, BOOLEAN, STRING, a number type, OBJECT<..> or ARRAY<..>; NULL when missing."""
    return F.schema_of_variant(value)


def is_exactly(value: Column, flag: bool) -> Column:
    """A JSON boolean equal to ``flag``; the text "true" or the number 1 do not count."""
    return is_true((kind(value) == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(flag)))


def number_from_text(text: Column) -> Column:
    """Numeric text as double: blank text is 0, anything that is not a number is NULL."""
    t = strip(text)
    return (
        F.when(t == "", F.lit(0.0))
        .when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"), t.try_cast("double"))
        .when(t.rlike(r"^0[xX][0-9a-fA-F]{1,15}\z"), F.conv(F.substring(t, 3, 15), 16, 10).try_cast("double"))
        .when(t.rlike(r"^\+?Infinity\z"), F.lit(float("inf")))
        .when(t == "-Infinity", F.lit(float("-inf")))
    )


def number(value: Column) -> Column:
    """A variant as double: JSON null is 0, booleans are 0 or 1, numeric text is read.

    Missing and non-numeric values are NULL.
    """
    return F.when(F.is_variant_null(value), F.lit(0.0)).otherwise(
        F.when(kind(value) == "STRING", number_from_text(F.try_variant_get(value, "$", "string"))).otherwise(
            F.try_variant_get(value, "$", "double")
        )
    )


def truthy(value: Column) -> Column:
    """Whether a variant holds something: not missing, null, false, 0 or empty text."""
    k = kind(value)
    return is_true(
        F.when(k == "VOID", F.lit(False))
        .when(k == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(k == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(k.startswith("OBJECT") | k.startswith("ARRAY"), F.lit(True))
        .otherwise(F.try_variant_get(value, "$", "double") != 0)
    )


def present(value: Column) -> Column:
    """The variant unless it is JSON null."""
    return F.when(~F.is_variant_null(value), value)


def if_truthy(value: Column) -> Column:
    return F.when(truthy(value), value)


# --- numbers ---------------------------------------------------------------------------


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Limit a non-NULL value to [low, high]; greatest and least skip NULL, so guard before."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def half_up(value: Column) -> Column:
    """Round a non-negative double half up to int."""
    return F.round(value).cast("int")


def finite(value: Column) -> Column:
    """The double unless it is NaN or infinite (NaN sorts above every number)."""
    return F.when(is_finite(value), value)


def is_finite(value: Column) -> Column:
    return value.between(-sys.float_info.max, sys.float_info.max)
