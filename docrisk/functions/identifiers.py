"""Format checks of identifiers: IBAN, BIC, chain address."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrisk import dims
from docrisk.functions.values import drop_blanks, is_true, strip


def iban_valid(iban: Column) -> Column:
    """Country length and mod-97 check of an IBAN, blanks ignored; NULL stays NULL."""
    v = F.upper(drop_blanks(iban))
    lengths = F.create_map(*[F.lit(x) for x in chain.from_iterable(dims.IBAN_LENGTHS.items())])
    length_ok = F.length(v) == F.coalesce(F.try_element_at(lengths, F.substring(v, 1, 2)), F.length(v))
    rotated = F.concat(v.substr(F.lit(5), F.length(v)), F.substring(v, 1, 4))

    def fold(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code < 65, acc * 10 + (code - 48)).otherwise(acc * 100 + (code - 55)) % 97

    remainder = F.aggregate(F.split(rotated, ""), F.lit(0), fold)
    shaped = v.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z")
    return F.when(iban.isNotNull(), F.when(shaped & length_ok, remainder == 1).otherwise(F.lit(False)))


def bic_valid(bic: Column) -> Column:
    """Eight or eleven characters: bank, country, place and optional branch."""
    return strip(bic).rlike(r"^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\z")


def clean_address(address: Column) -> Column:
    return strip(F.coalesce(address, F.lit("")))


def valid_address(address: Column) -> Column:
    """T and 33 base-58 characters after removing surrounding blanks; no checksum."""
    return is_true(clean_address(address).rlike(r"^T[1-9A-HJ-NP-Za-km-z]{33}\z"))
