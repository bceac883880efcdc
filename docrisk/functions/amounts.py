"""Amounts written in Turkish or English notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrisk.functions.values import strip

# comma decimals / dot decimals; a dot before three digits groups thousands
COMMA_DECIMAL = r"^(?:\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?|\d+,\d{1,2})\z"
DOT_DECIMAL = r"^(?:\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+\.\d{1,2})\z"
PLAIN = r"^\d+\z"

_CURRENCIES = {"TL": "TRY", "₺": "TRY", "EURO": "EUR", "$": "USD"}


def amount_style(text: Column) -> Column:
    """comma, dot, plain or other; NULL for NULL."""
    t = strip(text)
    return (
        F.when(t.rlike(PLAIN), "plain")
        .when(t.rlike(COMMA_DECIMAL), "comma")
        .when(t.rlike(DOT_DECIMAL), "dot")
        .when(t.isNotNull(), "other")
    )


def parse_amount(text: Column) -> Column:
    """The amount as decimal(18,2) by its own notation; NULL when it is none of them."""
    t = strip(text)
    style = amount_style(text)
    plain = (
        F.when(style == "plain", t)
        .when(style == "comma", F.translate(t, ",.", "."))
        .when(style == "dot", F.translate(t, ",", ""))
    )
    return plain.try_cast("decimal(18,2)")


def currency_code(text: Column) -> Column:
    """ISO code of a currency word or sign; others pass through in upper case."""
    t = F.upper(strip(text))
    code = F.when(F.lit(False), t)
    for word, iso in _CURRENCIES.items():
        code = code.when(t == word, iso)
    return code.otherwise(t)
