"""Model responses: from text to typed columns, and the contract they should keep."""

from __future__ import annotations

import re
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk import dims
from docrisk.functions.jsontext import parse_lenient
from docrisk.functions.values import is_exactly, kind, member, number, text_of

__all__ = ["parse_lenient", "parse_responses", "receipt_fields", "statement_fields", "explode_checks", "violations"]


def parse_responses(df: DataFrame, text: str = "output_text", source: str | None = None) -> DataFrame:
    """Add ``response``: the parsed object, NULL where the text holds none; ``source``: the text it was read from."""
    return parse_lenient(df, text, "response", objects_only=True, source=source)


def _texts(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "array<string>")


_RAW_CHECKS = (
    "struct<" + ",".join(f"{n}:struct<status:string,score:variant,evidence:string>" for n in dims.CHECK_NAMES) + ">"
)


def receipt_fields(df: DataFrame, response: str = "response", shared: str | None = None) -> DataFrame:
    """Typed columns of a receipt or video response.

    The fields every kind of response has are read from ``shared``, by default the same column.

    A check score is 0 for JSON null and NULL when it is missing or no number (infinite ones are
    left to the engine, which skips them). ``amount`` keeps
    what the arithmetic bonus asks: is the flag exactly false, are the totals other than JSON
    null (a missing total counts as given), how large is the difference.
    """
    v, every = F.col(response), F.col(shared or response)
    # all numbers go through one lambda: 33 copies of its rule would not be worth their code size
    sources = [f"_raw.{n}.score" for n in dims.CHECK_NAMES]
    paths = ["overallRisk", "confidence", *[f"categories.{c}" for c in dims.CATEGORY_WEIGHTS]]
    sources += [f"try_variant_get({shared or response}, '$.{p}', 'variant')" for p in paths]
    sources.append(f"try_variant_get({response}, '$.amountAnalysis.difference', 'variant')")
    numbers = F.transform(F.expr(f"array({', '.join(sources)})"), number)
    at = {name: F.get(F.col("_numbers"), F.lit(len(dims.CHECK_NAMES) + i)) for i, name in enumerate([*paths, "difference"])}
    checks = ", ".join(
        f"struct(_raw.{n}.status AS status, _numbers[{i}] AS score, _raw.{n}.evidence AS evidence) AS {n}"
        for i, n in enumerate(dims.CHECK_NAMES)
    )

    def not_null(path: str) -> Column:
        return ~F.is_variant_null(member(v, path))

    columns = {
        "model_risk": F.coalesce(at["overallRisk"], F.lit(0.0)),
        "model_label": text_of(every, "riskLabel"),
        "confidence": F.coalesce(at["confidence"], F.lit(0.0)),
        "summary": text_of(every, "summary"),
        "model_categories": F.struct(*[at[f"categories.{c}"].alias(c) for c in dims.CATEGORY_WEIGHTS]),
        "limitations": _texts(every, "limitations"),
        "checks": F.expr(f"struct({checks})"),
        "amount": F.struct(
            is_exactly(member(v, "amountAnalysis.calculationConsistent"), False).alias("inconsistent"),
            not_null("amountAnalysis.calculatedTotal").alias("calculated_given"),
            not_null("amountAnalysis.totalAmount").alias("total_given"),
            at["difference"].alias("difference"),
            text_of(v, "amountAnalysis.evidence").alias("evidence"),
        ),
    }
    staged = df.withColumn("_raw", F.try_variant_get(v, "$.checks", _RAW_CHECKS)).withColumn("_numbers", numbers)
    return staged.withColumns(columns).drop("_raw", "_numbers")


def amount_analysis(response: Column) -> Column:
    """The model's amounts as it gave them; a field of another kind is NULL, and so is the whole
    where there is none."""
    numbers = ["amount", "subtotal", "taxAmount", "totalAmount", "calculatedTotal", "difference"]
    fields = F.struct(
        *[F.try_variant_get(response, f"$.amountAnalysis.{n}", "double").alias(n) for n in numbers],
        F.try_variant_get(response, "$.amountAnalysis.calculationConsistent", "boolean").alias("calculationConsistent"),
        text_of(response, "amountAnalysis.evidence").alias("evidence"),
    )
    return F.when(F.try_variant_get(response, "$.amountAnalysis", "variant").isNotNull(), fields)


def statement_fields(df: DataFrame, response: str = "response") -> DataFrame:
    """Typed columns only statement responses have; ``evidence_list`` is empty where it has none."""
    v = F.col(response)
    sums = ["openingBalance", "totalIncoming", "totalOutgoing", "calculatedClosingBalance",
            "documentClosingBalance", "difference"]
    balance = F.struct(
        *[F.try_variant_get(v, f"$.balanceAnalysis.{n}", "double").alias(n) for n in sums],
        F.try_variant_get(v, "$.balanceAnalysis.calculationConsistent", "boolean").alias("calculationConsistent"),
        text_of(v, "balanceAnalysis.evidence").alias("evidence"),
    )
    transactions = F.struct(
        F.try_variant_get(v, "$.transactionAnalysis.transactionCount", "bigint").alias("transactionCount"),
        text_of(v, "transactionAnalysis.dateConsistency").alias("dateConsistency"),
        _texts(v, "transactionAnalysis.duplicateTransactions").alias("duplicateTransactions"),
        _texts(v, "transactionAnalysis.suspiciousTransactions").alias("suspiciousTransactions"),
    )
    return df.withColumns(
        {
            "balance_analysis": balance,
            "transaction_analysis": transactions,
            "evidence_list": F.coalesce(_texts(v, "evidence"), F.array().cast("array<string>")),
        }
    )


def explode_checks(df: DataFrame, keys: list[str], checks: str = "checks") -> DataFrame:
    """One row per document and check that is there: keys, check, status, score."""
    rows = ", ".join(
        f"CASE WHEN {checks}.{n} IS NOT NULL THEN "
        f"named_struct('check', '{n}', 'status', {checks}.{n}.status, 'score', {checks}.{n}.score) END"
        for n in dims.CHECK_NAMES
    )
    long = df.select(*keys, F.explode_outer(F.expr(f"array({rows})")).alias("c"))
    return long.filter(F.col("c").isNotNull()).select(*keys, "c.*")


# --- response contract --------------------------------------------------------------------
# name -> type; a trailing ? allows null. Nested objects are dicts.

_PERCENT, _COUNT = "0..100", "0.."
_CATEGORIES = {c: _PERCENT for c in dims.CATEGORY_WEIGHTS}
_SHARED = {
    "overallRisk": _PERCENT,
    "riskLabel": dims.RISK_LABELS,
    "confidence": _PERCENT,
    "summary": "text",
    "categories": _CATEGORIES,
}
_CHECK = {"status": dims.CHECK_STATUSES, "score": _PERCENT, "evidence": "text"}
CONTRACTS = {
    "receipt": _SHARED
    | {
        "checks": "checks",
        "limitations": "texts",
        "amountAnalysis": {
            "amount": "text?", "subtotal": "number?", "taxAmount": "number?", "totalAmount": "number?",
            "calculatedTotal": "number?", "difference": "number?", "calculationConsistent": "flag",
            "evidence": "text",
        },
    },
    "statement": _SHARED
    | {
        "balanceAnalysis": {
            "openingBalance": "number?", "totalIncoming": "number?", "totalOutgoing": "number?",
            "calculatedClosingBalance": "number?", "documentClosingBalance": "number?",
            "difference": "number?", "calculationConsistent": "flag", "evidence": "text",
        },
        "transactionAnalysis": {
            "transactionCount": _COUNT, "dateConsistency": "text", "duplicateTransactions": "texts",
            "suspiciousTransactions": "texts",
        },
        "limitations": "texts",
        "evidence": "texts",
    },
}


def _is_number(k: Column) -> Column:
    return k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")


def _bad_value(value: Column, spec) -> Column:
    """Whether a variant that is there breaks its type, enumeration or bounds."""
    k = kind(value)
    if isinstance(spec, list):
        # text form: a number or flag never equals one of the words
        ok = F.try_variant_get(value, "$", "string").isin(spec)
    elif spec in (_PERCENT, _COUNT):
        n = F.try_variant_get(value, "$", "double")
        ok = (n >= 0) & (n == F.floor(n)) & (k != "STRING") & (k != "BOOLEAN")
        if spec == _PERCENT:
            ok = (n <= 100) & ok
    elif spec == "text":
        ok = k == "STRING"
    elif spec == "texts":
        # an empty array has no element type yet
        ok = k.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.try_variant_get(value, "$[0]", "variant").isNull() | (
            k == "ARRAY<STRING>"
        )
    elif spec == "flag":
        ok = k == "BOOLEAN"
    elif spec == "text?":
        ok = k.isin("STRING", "VOID")
    elif spec == "number?":
        ok = _is_number(k) | (k == "VOID")
    else:
        raise ValueError(f"unknown type {spec!r}")
    return ~F.coalesce(ok, F.lit(False))


# values become NULL at once; a plain type would be tried on each
_KEYS_ONLY = "map<string,array<struct<x:boolean>>>"


def _keys(value: Column, path: str = "$") -> Column:
    """Keys of an object variant, in order; NULL when it is missing or no object."""
    return F.map_keys(F.try_variant_get(value, path, _KEYS_ONLY))


def _names(names) -> Column:
    return F.array(*[F.lit(n) for n in sorted(names)])


def _name_findings(keys: Column, names: Column, missing: str, unexpected: str) -> Column:
    """Rule names for the keys that lack and those that are too many; most objects have just ``names``."""
    lacking = F.transform(F.array_except(names, keys), lambda n: F.concat(F.lit(f"missing:{missing}"), n))
    more = F.transform(F.array_except(keys, names), lambda n: F.lit(f"unexpected:{unexpected}*"))
    return F.when(keys != names, F.concat(lacking, more))


def _object_findings(
    value: Column, keys: Column, spec: dict, path: str, inside: str = "", doubts: Column | None = None
) -> list[Column]:
    """Arrays of rule names broken by the object at ``path`` (empty path: the response) itself, which is ``value`` or
    its member ``inside``; values only of the names in ``doubts``, of all where that is NULL."""
    at = f"{path}." if path else ""
    whole = member(value, inside) if inside else value
    # in two steps: what is asked only once needed must not stand in a condition, or it is worked out for all
    found = [
        F.when(keys.isNull(), F.when(whole.isNotNull(), F.array(F.lit(f"type:{path or 'response'}")))),
        _name_findings(keys, _names(spec), at, at or "response."),
    ]
    for name, part in spec.items():
        if not isinstance(part, dict) and part != "checks":
            item = member(value, f"{inside}.{name}" if inside else name)
            bad = item.isNotNull() & _bad_value(item, part)
            if doubts is not None:
                bad = F.when(F.coalesce(F.array_contains(doubts, name), F.lit(True)), bad)
            found.append(F.when(bad, F.array(F.lit(f"value:{at}{name}"))))
    return found


# --- what the text shows ------------------------------------------------------------------
# Values that are right beyond doubt, as they stand in JSON text. Groups are possessive: they take no stack, however
# long the text.

_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TEXTS = rf"\[\s*+(?:{_TEXT}(?:\s*+,\s*+{_TEXT})*+)?+\s*+\]"
_END = r"(?=\s*+[,}])"
_NUMBER = rf"-?+\d++(?:\.\d++)?+(?:[eE][+-]?+\d++)?+{_END}"
_RIGHT = {
    _PERCENT: rf"(?:100|\d{{1,2}}+){_END}", _COUNT: rf"\d{{1,18}}+{_END}", "text": _TEXT, "texts": _TEXTS,
    "flag": "(?:true|false)", "text?": f"(?:null|{_TEXT})", "number?": f"(?:null|{_NUMBER})",
}
# the opening quote of a word: none that is part of a text behind a backslash
_OPEN, _COLON = r'"(?=\w)(?<!\\")', r"\s*+:\s*+"


def _right(part) -> str:
    return rf'"(?:{"|".join(map(re.escape, part))})"' if isinstance(part, list) else _RIGHT[part]


def _scalars(spec: dict) -> list[tuple[str, object]]:
    """Names and types of all members, at any depth, that are no objects."""
    found = []
    for name, part in spec.items():
        inner = _CHECK if part == "checks" else part
        found += _scalars(inner) if isinstance(inner, dict) else [(name, inner)]
    return found


def _right_members(spec: dict) -> str:
    """A pattern without groups for a member, or a whole check, that is right wherever it stands, behind its first quote."""
    types: dict[str, set[str]] = {}
    for name, part in _scalars(spec):
        types.setdefault(name, set()).add(_right(part))
    alike: dict[str, list[str]] = {}
    for name, right in types.items():
        if len(right) == 1:  # a name of two types is always in doubt
            alike.setdefault(*right, []).append(name)
    members = [(names, right) for right, names in alike.items()]
    if "checks" in spec and all(len(types[n]) == 1 for n in _CHECK):
        check = "|".join(r"\s*+,\s*+".join(rf'"{n}"{_COLON}{_right(_CHECK[n])}' for n in names) for names in permutations(_CHECK))
        members.insert(0, (dims.CHECK_NAMES, rf"\{{\s*+(?:{check})\s*+\}}"))
    return "|".join(rf'(?:{"|".join(names)})"{_COLON}{right}' for names, right in members)


def _doubts(text: Column, spec: dict) -> Column:
    """Names of the members of a JSON text, at any depth, that do not show in the text to be right: keys of ``spec``
    before a value that may be wrong, and keys unknown to it. NULL where that can't be told.

    A key of ``spec`` that is not among them has a right value wherever it stands, so its place and repeats need no
    look. This holds for valid JSON: a quote that is not escaped, a word, a quote and a colon are a key there, and
    only a key that spells a letter as ``\\u`` is not found so; texts with such a key are those that can't be told.
    """
    names = F.regexp_extract_all(text, F.lit(rf'{_OPEN}(?:{_right_members(spec)}|(\w++)"\s*+:)'), F.lit(1))
    told = ~(text.contains("\\u") & text.rlike(r'\\u[^"\\]*+"\s*+:'))
    # members that are right have no name here
    return F.when(told, F.array_remove(names, ""))


def _check_findings(checks: Column, keys: Column, doubtful: Column, entries: Column) -> list[Column]:
    """Rules over the check map; what is wrong is spelt out for the ``doubtful`` checks only."""
    def findings(name: Column) -> Column:
        check = F.try_element_at(entries, name)
        rules = _object_findings(check, _keys(check), _CHECK, "checks.*")
        return F.flatten(F.array(*[F.coalesce(r, F.array().cast("array<string>")) for r in rules]))

    return [
        F.when(keys.isNull(), F.when(checks.isNotNull(), F.array(F.lit("type:checks")))),
        _name_findings(keys, _names(dims.CHECK_NAMES), "checks.", "checks."),
        F.when(F.size(doubtful) > 0, F.flatten(F.transform(doubtful, findings))),
    ]


def violations(df: DataFrame, contract: str, keys: list[str], response: str = "response", source: str | None = None) -> DataFrame:
    """One row per broken contract rule: keys, rule.

    ``source`` names the column with the text that ``response`` was read from, as ``parse_responses`` adds it. What
    is seen there to be right is not looked at again; without it, all is looked at. The rules are the same.
    """
    spec = CONTRACTS[contract]
    v = F.col(response)
    objects = {"": spec} | {name: part for name, part in spec.items() if isinstance(part, dict)}
    # key lists as columns of their own, so that each is read off the variant once
    staged = {f"_keys_{name}": _keys(v, f"$.{name}" if name else "$") for name in objects}
    staged["_doubts"] = _doubts(F.col(source), spec) if source else F.lit(None).cast("array<string>")
    staged = df.withColumns(staged)
    if "checks" in spec:
        staged = staged.withColumn("_keys_checks", _keys(v, "$.checks"))
        names = _names(dims.CHECK_NAMES)
        staged = staged.withColumn("_doubtful", F.coalesce(F.array_intersect("_doubts", names), names))
        staged = staged.withColumn("_entries", F.when(F.size("_doubtful") > 0, F.try_variant_get(v, "$.checks", "map<string,variant>")))
    none = F.array().cast("array<string>")
    doubts = F.col("_doubts")
    found = []
    for name, part in objects.items():
        found += _object_findings(v, F.col(f"_keys_{name}"), part, name, name, doubts)
    if "checks" in spec:
        found += _check_findings(member(v, "checks"), *[F.col(c) for c in ("_keys_checks", "_doubtful", "_entries")])
    every = F.flatten(F.array(*[F.coalesce(f, none) for f in found]))
    rules = F.when(v.isNull(), F.array(F.lit("type:response"))).otherwise(every)
    # The rules are a column of their own: worked out inside the generator they would be interpreted, not compiled.
    # A plain explode would first filter on the size of the list and so work everything out twice.
    listed = staged.select(*keys, rules.alias("_rules"))
    return listed.select(*keys, F.explode_outer("_rules").alias("rule")).filter(F.col("rule").isNotNull())
