"""Claims: what a sender says a document shows, read from free text, and its comparison.

``compat`` reproduces the bot's extraction exactly, including its blind spots; ``fixed`` reads
complete IBANs, bank names with a final ı, upper-case bank names and plain-number amount lines.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk import dims
from docrisk.functions.amounts import currency_code, parse_amount
from docrisk.functions.identifiers import bic_valid, iban_valid
from docrisk.functions.values import BLANK, WORD_EDGE, drop_blanks, first_text, is_true, non_empty, squeeze, strip

__all__ = [
    "extract_claims", "has_claim", "claim_payload", "reconcile_claims", "comparison_summary",
    "repeated_digits", "digit_state", "iban_valid", "bic_valid",
]

# --- fixed values: patterns (blank-separated parts are joined with BLANK) -------------------
_CURRENCY = r"TL|TRY|₺|EUR|EURO|USD|\$"
_GROUPED = r"\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?"
_PLAIN = r"\d+(?:[.,]\d{1,2})?"
_LABEL_GAP = rf"{BLANK}*[:\-]?{BLANK}*"
SENDER = rf"(?i)(?:g[öÖ]nderen|gonderen|sender){_LABEL_GAP}([^\n]+)"
RECIPIENT = rf"(?i)(?:alıcı|alici|recipient){_LABEL_GAP}([^\n]+)"
IBAN = {
    "compat": rf"(?i){WORD_EDGE}([A-Z]{{2}}{BLANK}?\d{{2}}(?:{BLANK}?\d{{4}}){{4,7}}){WORD_EDGE}",
    "fixed": rf"(?i){WORD_EDGE}([A-Z]{{2}}{BLANK}?\d{{2}}(?:{BLANK}?\d{{4}}){{3,7}}(?:{BLANK}?\d{{1,3}})?){WORD_EDGE}",
}
AMOUNT_WITH_CURRENCY = rf"(?i)(?:^|{BLANK})({_GROUPED}|{_PLAIN}){BLANK}*({_CURRENCY})(?={BLANK}|\z)"
LIRA = r"(?i)TL|TRY|₺"
LABELLED_AMOUNT = rf"(?i)(?:tutar|miktar|amount){_LABEL_GAP}([0-9][0-9.,]*){BLANK}*({_CURRENCY})?"
BARE_AMOUNT = rf"^(?:{_GROUPED}|{_PLAIN})\z"
IBAN_LINE = rf"(?i)iban|{WORD_EDGE}TR\d{{2}}"
CLOCK_LINE = r"^\d{1,2}[.:]\d{2}\z"
LONG_NUMBER = r"^\d{5,}\z"
BANK_LINE = {
    "compat": (
        rf"(?i){WORD_EDGE}(?:akbank|garanti(?:{BLANK}+bbva)?|garanti{BLANK}+bankası|enpara|vakıfbank"
        rf"|i[şŞ]{BLANK}+bankası|isbankası|ziraat(?:{BLANK}+bankası)?|denizbank|halkbank"
        rf"|yapı{BLANK}+kredi){WORD_EDGE}"
    ),
    "fixed": (
        r"(?i)(?<![\p{L}\p{N}_])(?:akbank|garanti|enpara|vak[ıiIİ]fbank"
        rf"|[iİ](?:[şŞ]|s){BLANK}*bankas[ıiIİ]|ziraat|denizbank|halkbank"
        rf"|yap[ıiIİ]{BLANK}+kredi)(?![\p{{L}}\p{{N}}_])"
    ),
}
AMOUNT_LINE = {
    "compat": rf"(?i)^{_GROUPED}{BLANK}*(?:{_CURRENCY})\z",
    "fixed": rf"(?i)^(?:{_GROUPED}|{_PLAIN}){BLANK}*(?:{_CURRENCY})\z",
}


def _capture(text: Column, pattern: str, group: int = 1) -> Column:
    return non_empty(F.regexp_extract(text, pattern, group))


def extract_claims(df: DataFrame, text: str = "text", mode: str = "compat") -> DataFrame:
    """Add ``claim``: sender, recipient, amount, currency and IBAN found in a caption."""
    source = F.col(text)
    normal = strip(F.regexp_replace(source, "\r", ""))
    lines = F.filter(F.transform(F.split(normal, "\n"), squeeze), lambda x: x != "")
    base = df.withColumn("_text", non_empty(normal)).withColumn("_lines", lines)

    t, lines = F.col("_text"), F.col("_lines")
    sender, recipient = strip(_capture(t, SENDER)), strip(_capture(t, RECIPIENT))
    iban = F.upper(drop_blanks(_capture(t, IBAN[mode])))
    bare = F.get(
        F.filter(lines, lambda x: x.rlike(BARE_AMOUNT) & ~x.rlike(CLOCK_LINE) & ~x.rlike(IBAN_LINE)), F.lit(0)
    )
    amount = F.coalesce(_capture(t, LABELLED_AMOUNT), _capture(t, AMOUNT_WITH_CURRENCY), bare)
    currency = F.upper(
        F.coalesce(
            _capture(t, LABELLED_AMOUNT, 2),
            _capture(t, AMOUNT_WITH_CURRENCY, 2),
            F.when(t.rlike(LIRA), "TRY"),
        )
    )

    def is_bank(line: Column) -> Column:
        return line.rlike(BANK_LINE[mode])

    def is_amount(line: Column) -> Column:
        return line.rlike(AMOUNT_LINE[mode])

    def is_long_number(line: Column) -> Column:
        return drop_blanks(line).rlike(LONG_NUMBER)

    def is_clock(line: Column) -> Column:
        return line.rlike(CLOCK_LINE)

    def is_iban(line: Column) -> Column:
        return line.rlike(IBAN_LINE)

    clean = F.filter(
        lines,
        lambda x: ~(is_iban(x) | is_bank(x) | is_clock(x) | is_amount(x) | is_long_number(x)),
    )
    # one-based position of the first bank and amount line, 0 when there is none
    staged = base.withColumns(
        {
            "_sender": sender,
            "_recipient": recipient,
            "_iban": iban,
            "_amount": amount,
            "_currency": currency,
            "_clean": clean,
            "_bank_at": F.array_position(F.transform(lines, is_bank), F.lit(True)),
            "_amount_at": F.array_position(F.transform(lines, is_amount), F.lit(True)),
        }
    )
    unlabelled = F.col("_sender").isNull() & F.col("_recipient").isNull() & (F.size("_clean") > 0)
    before_bank = F.filter(
        F.slice(lines, 1, (F.greatest(F.col("_bank_at"), F.lit(1)) - 1).cast("int")),
        lambda x: ~(is_long_number(x) | is_clock(x)),
    )
    after_amount = F.filter(
        F.slice(lines, (F.col("_amount_at") + 1).cast("int"), F.size(lines)),
        lambda x: ~(is_iban(x) | is_bank(x) | is_clock(x)),
    )
    guessed_sender = F.when(
        unlabelled & (F.col("_bank_at") > 1) & (F.size(before_bank) > 0), strip(F.array_join(before_bank, " "))
    )
    guessed_recipient = F.when(
        unlabelled & (F.col("_amount_at") > 0) & (F.size(after_amount) > 0), strip(F.array_join(after_amount, " "))
    )
    two = F.size("_clean") >= 2
    claim = F.struct(
        F.coalesce(F.col("_sender"), guessed_sender, F.when(two, F.get("_clean", F.lit(0)))).alias("senderName"),
        F.coalesce(
            F.col("_recipient"), guessed_recipient, F.when(two, F.get("_clean", F.size("_clean") - 1))
        ).alias("recipientName"),
        F.col("_amount").alias("amount"),
        F.col("_currency").alias("currency"),
        F.col("_iban").alias("iban"),
        F.coalesce(source, F.lit("")).alias("rawText"),
    )
    staging = ["_text", "_lines", "_sender", "_recipient", "_iban", "_amount", "_currency", "_clean",
               "_bank_at", "_amount_at"]
    return staged.withColumn("claim", claim).drop(*staging)


def has_claim(claim: Column) -> Column:
    """Whether any field, the raw text included, holds something."""
    fields = [*dims.CLAIM_FIELDS, "rawText"]
    return F.exists(F.array(*[claim[f] for f in fields]), lambda x: F.coalesce(strip(x) != "", F.lit(False)))


def claim_payload(claim: Column) -> Column:
    """The claim as JSON with its five fields; empty ones are null."""
    fields = F.struct(*[non_empty(claim[f]).alias(f) for f in dims.CLAIM_FIELDS])
    return F.to_json(fields, {"ignoreNullFields": "false"})


# --- comparison with the document -------------------------------------------------------------

_TR_UPPER, _TR_LOWER = "İIŞĞÜÖÇ", "iışğüöç"


def _name_key(name: Column) -> Column:
    """Names compare without case (Turkish rules) and without extra blanks."""
    return non_empty(F.lower(F.translate(squeeze(name), _TR_UPPER, _TR_LOWER)))


def comparable(field: str, value: Column) -> Column:
    """A claim field in the form it is compared in."""
    if field in ("senderName", "recipientName"):
        return _name_key(value)
    if field == "amount":
        return F.coalesce(parse_amount(value).cast("string"), non_empty(strip(value)))
    if field == "currency":
        return non_empty(currency_code(value))
    return non_empty(F.upper(drop_blanks(value)))


def reconcile_claims(claims: DataFrame, fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """Compare each claimed field with the one read from the document.

    ``claims`` has a ``claim`` struct, ``fields`` the same five fields as columns, one row per
    document. Adds ``comparison``: provided, enabled, matches (match, mismatch or unknown per
    claimed field) and warnings.
    """
    read = fields.select(key, F.struct(*[F.col(f).alias(f) for f in dims.CLAIM_FIELDS]).alias("_read"))
    joined = claims.join(read, key, "left")
    # both sides in comparable form first: each is asked several times below
    forms = {f"_said_{f}": comparable(f, F.col("claim")[f]) for f in dims.CLAIM_FIELDS}
    forms |= {f"_seen_{f}": comparable(f, F.col("_read")[f]) for f in dims.CLAIM_FIELDS}
    joined = joined.withColumns(forms)

    def verdict(field: str) -> Column:
        said, seen = F.col(f"_said_{field}"), F.col(f"_seen_{field}")
        return F.when(said.isNotNull(), F.when(seen.isNull(), "unknown").when(said == seen, "match").otherwise("mismatch"))

    all_fields = F.map_from_arrays(
        F.array(*[F.lit(f) for f in dims.CLAIM_FIELDS]), F.array(*[verdict(f) for f in dims.CLAIM_FIELDS])
    )
    joined = joined.withColumn("_matches", F.map_filter(all_fields, lambda _, v: v.isNotNull()))
    matches = F.col("_matches")
    given = F.size(matches) > 0
    comparison = F.struct(
        F.when(given, claim_payload(F.col("claim"))).alias("provided"),
        given.alias("enabled"),
        given.alias("hasExpectedDetails"),
        matches.alias("matches"),
        F.array().cast("array<string>").alias("warnings"),
    )
    return joined.withColumn("comparison", comparison).drop("_read", "_matches", *forms)


def _labels() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(dims.CLAIM_FIELD_LABELS.items())])


def comparison_summary(df: DataFrame, comparison: str = "comparison") -> DataFrame:
    """Add state (none, consistent, mismatch, unverified), counts and the mismatched field labels."""
    c = F.col(comparison)
    asked = is_true(c["enabled"]) | is_true(c["hasExpectedDetails"]) | c["provided"].isNotNull()
    asked = is_true(c.isNotNull() & asked)
    values = F.coalesce(F.map_values(c["matches"]), F.array().cast("array<string>"))
    mismatches = F.size(F.filter(values, lambda v: is_true(v.isin("mismatch", "false"))))
    unknowns = F.size(F.filter(values, lambda v: v.isNull() | (v == "unknown")))
    warnings = F.coalesce(F.size(c["warnings"]), F.lit(0))
    entries = F.filter(F.map_entries(c["matches"]), lambda e: is_true(e["value"].isin("mismatch", "false")))
    labels = F.transform(entries, lambda e: F.coalesce(F.try_element_at(_labels(), e["key"]), e["key"]))
    out = df.withColumns(
        {
            "n_mismatch": F.when(asked, mismatches).otherwise(0),
            "n_unknown": F.when(asked, unknowns).otherwise(0),
            "mismatch_fields": F.coalesce(F.when(asked, labels), F.array().cast("array<string>")),
        }
    )
    state = (
        F.when(~asked, "none")
        .when((F.col("n_mismatch") == 0) & (F.col("n_unknown") == 0) & (warnings == 0), "consistent")
        .when(F.col("n_mismatch") > 0, "mismatch")
        .otherwise("unverified")
    )
    return out.withColumn("state", state)


# --- repeated digits -----------------------------------------------------------------------------


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def _counts(digits: Column) -> Column:
    """Array of (digit, n) in digit order; ten entries whatever the length of the text."""
    return F.array(
        *[
            F.struct(F.lit(str(d)).alias("digit"),
                     (F.length(digits) - F.length(F.replace(digits, F.lit(str(d)), F.lit("")))).alias("n"))
            for d in range(10)
        ]
    )


def repeated_digits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digits seen at least twice in a text, with their counts.

    Counted inside the row (digits with and without the one in question), so nothing is exploded
    per character and nothing is shuffled. Texts with fewer than two digits have none.
    """
    digits = df.select(key, _digits(F.col(text)).alias("_digits")).filter(F.length("_digits") >= 2)
    long = digits.select(key, F.explode_outer(_counts(F.col("_digits"))).alias("c"))
    return long.filter(F.col("c.n") >= 2).select(key, "c.*")


def digit_state(text: Column) -> Column:
    """no_text, too_few, no_repeats or ready."""
    digits = _digits(text)
    return (
        F.when(first_text(text).isNull(), "no_text")
        .when(F.length(digits) < 2, "too_few")
        .when(~digits.rlike(r"([0-9])[0-9]*\1"), "no_repeats")
        .otherwise("ready")
    )
