"""Bank names: canonical key and display name."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrisk import dims
from docrisk.functions.values import drop_blanks

# Keys in match order: equality for the first two, containment for the rest.
_EQUAL = [("akbank", ["akbank"]), ("enpara", ["enpara", "enparafinans"])]
_CONTAINS = [
    ("vakifbank", ["vakifbank"]),
    ("isbankasi", ["isbankasi", "isbank"]),
    ("ziraat", ["ziraat"]),
    ("garanti", ["garanti"]),
    ("denizbank", ["denizbank"]),
    ("halkbank", ["halkbank"]),
    ("yapikredi", ["yapikredi"]),
]


def canonical_bank(name: Column, mode: str = "compat") -> Column:
    """The bank key of a free-text bank name, NULL when unknown.

    A capital dotted İ lower-cases to i plus a combining dot. ``compat`` leaves the dot in, so
    such names stay unknown; ``fixed`` removes it.
    """
    folded = F.translate(drop_blanks(F.lower(name)), "ışğüöç", "isguoc")
    if mode == "fixed":
        folded = F.translate(folded, "\u0307", "")
    found = F.when(name == "", F.lit(None).cast("string"))
    for key, spellings in _EQUAL:
        found = found.when(folded.isin(spellings), key)
    for key, parts in _CONTAINS:
        hit = folded.contains(parts[0])
        for part in parts[1:]:
            hit = hit | folded.contains(part)
        found = found.when(hit, key)
    return found


def bank_display(key: Column) -> Column:
    """Display name of a bank key; unknown keys pass through."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(dims.BANK_NAMES.items())])
    return F.coalesce(F.try_element_at(names, key), key)
