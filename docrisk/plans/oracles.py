"""SQL twins of the registered queries, written independently of the operators.

They run in another engine over the same tables. Only the input derivations in ``adapters`` and
the fixed values in ``dims`` are shared.
"""

from __future__ import annotations

from docrisk import dims
from docrisk.plans import adapters as a
from docrisk.plans.adapters import pick, sql_text

ORACLES: dict[str, str] = {}

CHECKS = range(len(dims.CHECK_NAMES))
INDEX = {n: i for i, n in enumerate(dims.CHECK_NAMES)}


def _label(score: str) -> str:
    low, moderate, high, very_high = dims.RISK_LABELS
    return (
        f"CASE WHEN {score} <= 20 THEN '{low}' WHEN {score} <= 45 THEN '{moderate}' "
        f"WHEN {score} <= 70 THEN '{high}' ELSE '{very_high}' END"
    )


# --- risk engine -------------------------------------------------------------------------------

_usable = ", ".join(
    f"CASE WHEN {a.check_missing(i)} OR {a.check_status(i)} = 'unknown' THEN NULL "
    f"ELSE CAST(greatest(0, least(100, {a.check_score(i)})) AS DOUBLE) END AS s{i}"
    for i in CHECKS
)


def _category(weights: dict[str, float]) -> str:
    total = weight = "0e0"
    for name, w in weights.items():
        i = INDEX[name]
        total = f"{total} + coalesce(s{i}, 0e0) * {w}e0"
        weight = f"{weight} + CASE WHEN s{i} IS NULL THEN 0e0 ELSE {w}e0 END"
    return f"CASE WHEN {weight} = 0 THEN 0 ELSE CAST(round(({total}) / ({weight})) AS INTEGER) END"


_categories = ", ".join(f"{_category(w)} AS {c}" for c, w in dims.CHECK_WEIGHTS.items())
_overall = " + ".join(f"{c} * {w}e0" for c, w in dims.CATEGORY_WEIGHTS.items())
RISK = (
    f"usable AS (SELECT *, {_usable} FROM orders), "
    f"risks AS (SELECT *, {_categories} FROM usable)"
)

ORACLES["risk_categories"] = f"WITH {RISK} SELECT o_orderkey AS k, {', '.join(dims.CATEGORY_WEIGHTS)} FROM risks"

INVOICE = f"""
lines AS (SELECT l_orderkey AS k, {a.LINE_NET} AS net, {a.LINE_TAX} AS tax FROM lineitem),
sums AS (SELECT k, sum(net) AS net, sum(tax) AS tax FROM lines GROUP BY k),
parts AS (
  SELECT coalesce(s.k, o.o_orderkey) AS k, s.net, s.tax, o.o_orderkey AS ok,
    CASE WHEN s.k % 3 = 0 THEN s.net + s.tax
         WHEN o.o_orderkey % 3 <> 0 AND o.o_orderkey % 17 <> 0 THEN CAST(o.o_totalprice AS DECIMAL(18,2)) END AS shown,
    CASE WHEN o.o_orderkey % 12 = 1 THEN 5 WHEN o.o_orderkey % 12 = 2 THEN -10 ELSE 0 END AS extra,
    coalesce(o.o_orderkey % 39 = 0, false) AS unreadable
  FROM sums s FULL JOIN orders o ON s.k = o.o_orderkey),
kept AS (
  SELECT * FROM parts WHERE net IS NOT NULL OR shown IS NOT NULL OR extra <> 0 OR unreadable),
invoice AS (
  SELECT k, CASE WHEN net IS NOT NULL AND shown IS NOT NULL AND NOT unreadable THEN net + tax + extra END AS calculated, shown
  FROM kept)
"""
ORACLES["invoice_reconcile"] = f"""
WITH {INVOICE}
SELECT k, CAST(calculated AS DOUBLE) AS calculated, CAST(shown AS DOUBLE) AS shown,
  CAST(calculated - shown AS DOUBLE) AS difference, coalesce(abs(calculated - shown) <= 0.01, false) AS consistent
FROM invoice"""

ORACLES["risk_overall"] = f"""
WITH {RISK}, {INVOICE},
scored AS (
  SELECT o_orderkey AS k, CAST(round(least(100e0, greatest(0e0, {_overall}
    + CASE WHEN calculated IS NOT NULL AND abs(calculated - shown) > 0.01 THEN 10e0 ELSE 0e0 END))) AS INTEGER) AS overall_risk
  FROM risks LEFT JOIN invoice ON invoice.k = risks.o_orderkey)
SELECT k, overall_risk, {_label('overall_risk')} AS risk_label, overall_risk >= 46 AS suspicious FROM scored"""

_weights = ", ".join(
    f"('{c}', {INDEX[n]}, {round(w * 10)})" for c, ws in dims.CHECK_WEIGHTS.items() for n, w in ws.items()
)
_names = "[" + ", ".join(f"'{n}'" for n in dims.CHECK_NAMES) + "]"
_statuses = "[" + ", ".join(f"'{n}'" for n in dims.CHECK_STATUSES) + "]"
LONG = f"""
long AS (
  SELECT o_orderkey AS k, i, {_statuses}[CAST((o_orderkey + i) % 4 AS INTEGER) + 1] AS status,
    (o_orderkey % 5) * 20 + (o_orderkey * 7 + i * 13) % 41 - 10 AS score
  FROM orders, (SELECT unnest(range({len(dims.CHECK_NAMES)})) AS i) WHERE (o_orderkey + 3 * i) % 11 <> 0)"""
_all = "(VALUES " + ", ".join(f"('{c}')" for c in dims.CATEGORY_WEIGHTS) + ")"
ORACLES["risk_long"] = f"""
WITH long AS (
  SELECT o_orderkey AS k, i, {_statuses}[CAST((o_orderkey + i) % 4 AS INTEGER) + 1] AS status, CAST({a.LONG_SCORE} AS DECIMAL(18,2)) AS score
  FROM orders, (SELECT unnest(range({len(dims.CHECK_NAMES)})) AS i) WHERE (o_orderkey + 3 * i) % 11 <> 0 AND NOT ({a.LONG_DROPPED})),
w(category, i, tenths) AS (VALUES {_weights}),
sums AS (
  SELECT k, category, sum(CASE WHEN status <> 'unknown' THEN CAST(least(100, greatest(0, score)) * 100 AS BIGINT) * tenths ELSE 0 END) AS n,
    sum(CASE WHEN status <> 'unknown' THEN tenths ELSE 0 END) AS d
  FROM long JOIN w USING (i) GROUP BY k, category),
docs AS (SELECT DISTINCT k FROM long), categories(category) AS {_all}
SELECT k, category, CAST(CASE WHEN coalesce(d, 0) = 0 THEN 0 ELSE (2 * n + 100 * d) // (200 * d) END AS INTEGER) AS risk
FROM docs CROSS JOIN categories LEFT JOIN sums USING (k, category)"""

ORACLES["check_statuses"] = f"""
WITH {LONG} SELECT {_names}[CAST(i AS INTEGER) + 1] AS "check", status, count(*) AS n, CAST(sum(score) AS BIGINT) AS total
FROM long GROUP BY 1, 2"""

_template = " + ".join(
    f"CASE WHEN NOT ({a.check_missing(INDEX[n])}) AND {a.check_status(INDEX[n])} = 'suspicious' THEN 1 ELSE 0 END"
    for n in dims.TEMPLATE_CHECKS
)
ORACLES["independent_signals"] = f"""
SELECT k, CAST(n AS INTEGER) AS n_suspicious, n >= 2 AS counts_as_signal
FROM (SELECT o_orderkey AS k, {_template} AS n FROM orders)"""

# --- banks ----------------------------------------------------------------------------------------


def _folded(name: str, drop_dot: bool = False) -> str:
    # lower-casing a capital dotted i gives i plus a combining dot
    text = f"lower(replace({name}, 'İ', concat(chr(105), chr(775))))"
    if drop_dot:
        text = f"replace({text}, chr(775), '')"
    return f"translate(regexp_replace({text}, '\\s+', '', 'g'), 'ışğüöç', 'isguoc')"


def _bank(name: str, drop_dot: bool = False) -> str:
    f = _folded(name, drop_dot)
    return f"""CASE WHEN {name} IS NULL OR {name} = '' THEN NULL WHEN {f} = 'akbank' THEN 'akbank'
    WHEN {f} IN ('enpara', 'enparafinans') THEN 'enpara' WHEN {f} LIKE '%vakifbank%' THEN 'vakifbank'
    WHEN {f} LIKE '%isbank%' THEN 'isbankasi' WHEN {f} LIKE '%ziraat%' THEN 'ziraat'
    WHEN {f} LIKE '%garanti%' THEN 'garanti' WHEN {f} LIKE '%denizbank%' THEN 'denizbank'
    WHEN {f} LIKE '%halkbank%' THEN 'halkbank' WHEN {f} LIKE '%yapikredi%' THEN 'yapikredi' END"""


_templates = " ".join(f"WHEN '{b}' THEN '{f}'" for b, f in dims.BANK_TEMPLATES.items())
_displays = " ".join(f"WHEN '{b}' THEN '{n}'" for b, n in dims.BANK_NAMES.items())

BANKS = f"""named AS (SELECT s_suppkey AS k, {pick('s_suppkey', a.BANK_SPELLINGS)} AS name,
  {pick('s_suppkey', ['pdf', 'image', 'video'])} AS type FROM supplier),
banked AS (SELECT *, {_bank('name')} AS bank, {_bank('name', True)} AS bank_fixed FROM named)"""
ORACLES["bank_canonical"] = f"""
WITH {BANKS} SELECT k, bank, CASE bank {_displays} ELSE bank END AS display, bank_fixed FROM banked"""
ORACLES["template_match"] = f"""
WITH {BANKS} SELECT k, type, bank, CASE WHEN type <> 'video' THEN CASE bank {_templates} END END AS reference FROM banked"""
_present = " ".join(f"WHEN '{b}' THEN '{f}'" for b, f in dims.BANK_TEMPLATES.items() if a.TEMPLATE_FILES.get(f))
ORACLES["template_presence"] = f"""
WITH {BANKS} SELECT k, type, bank, CASE WHEN type <> 'video' THEN CASE bank {_present} END END AS reference FROM banked"""

# --- screening ---------------------------------------------------------------------------------------

_engine = " + ".join(f"{c} * {w}e0" for c, w in dims.CATEGORY_WEIGHTS.items())
_cents = f"({a.ANSWER_DIFFERENCE_CENTS})"
_seeded = {"visualRisk": 1, "textRisk": 2, "layoutRisk": 3, "financialDataRisk": 4, "editingRisk": 5}
ORACLES["screen_answers"] = f"""
WITH {RISK},
typed AS (
  SELECT *, {a.DOC_TYPE} AS type, {a.DOC_BANK} AS name, {a.ANSWER_KIND} AS kind, {a.ANSWER_SUMMARY} AS summary,
    {a.ANSWER_EVIDENCE} AS note, coalesce(TRY_CAST({a.ANSWER_RISK.replace('string', 'VARCHAR')} AS DOUBLE), 0) AS model FROM risks),
engine AS (
  SELECT *, {_bank('name')} AS b, type IN ('image', 'pdf') AS scored,
    CAST(round(least(100e0, greatest(0e0, {_engine}
      + CASE WHEN {a.ANSWER_INCONSISTENT} AND NOT ({a.ANSWER_NO_TOTAL}) AND abs({_cents}) > 1 THEN 10e0 ELSE 0e0 END))) AS INTEGER) AS total,
    CASE WHEN type = 'document' THEN '{dims.UNSUPPORTED_TYPE}'
      WHEN kind = 11 THEN '{dims.EMPTY_ANSWER}'
      WHEN kind IN (6, 7) THEN CASE type WHEN 'statement' THEN '{dims.INVALID_ANSWER['statement']}'
        WHEN 'video' THEN '{dims.INVALID_ANSWER['video']}' ELSE '{dims.INVALID_ANSWER['receipt']}' END END AS error
  FROM typed),
final AS (SELECT *, CAST(CASE WHEN scored THEN total ELSE model END AS DOUBLE) AS risk FROM engine)
SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, type, error IS NULL AS success, error,
  CASE WHEN error IS NULL THEN b END AS bank,
  CASE WHEN error IS NULL AND scored THEN CASE b {_templates} END END AS reference,
  CASE WHEN error IS NULL THEN risk END AS overall_risk,
  CASE WHEN error IS NULL THEN CASE WHEN scored THEN {_label('risk')} ELSE 'HIGH RISK' END END AS risk_label,
  CASE WHEN error IS NULL THEN CAST(risk AS DOUBLE) END AS score,
  CASE WHEN error IS NULL THEN risk >= 46 END AS suspicious,
  {', '.join(f"CASE WHEN error IS NULL THEN CAST(CASE WHEN scored THEN {c} ELSE {v} END AS DOUBLE) END AS {c}" for c, v in _seeded.items())},
  CASE WHEN error IS NULL THEN CAST(50 + o_orderkey % 50 AS DOUBLE) END AS confidence,
  CASE WHEN error IS NULL THEN CASE WHEN type = 'statement' THEN 'satir' WHEN note <> '' THEN note
    WHEN summary <> '' THEN summary WHEN type = 'video' THEN '{dims.EVIDENCE_DEFAULT['video']}'
    ELSE '{dims.EVIDENCE_DEFAULT['receipt']}' END END AS evidence,
  CASE WHEN error IS NULL AND type <> 'statement' THEN CAST(10 AS DOUBLE) END AS total,
  CASE WHEN error IS NULL AND type <> 'statement' THEN {_cents} / 100e0 END AS difference,
  CASE WHEN error IS NULL AND type <> 'statement' THEN NOT ({a.ANSWER_INCONSISTENT}) END AS adds_up
FROM final"""

_breaks = {
    1: "value:checks.*.score", 2: "value:checks.*.score", 3: "value:checks.*.status",
    4: f"missing:checks.{dims.CHECK_NAMES[1]}", 5: "unexpected:checks.*", 6: "value:overallRisk",
    7: "value:riskLabel", 8: "missing:confidence", 9: "value:categories.editingRisk", 10: "value:limitations",
    11: "value:amountAnalysis.calculationConsistent",
}
ORACLES["response_violations"] = f"""
SELECT rule, count(*) AS n FROM (
  SELECT CASE {a.CONTRACT_BREAK} {' '.join(f"WHEN {k} THEN '{r}'" for k, r in _breaks.items())} END AS rule FROM orders
  UNION ALL SELECT 'value:checks.*.score' FROM orders
    WHERE {a.CONTRACT_BREAK} NOT IN (1, 2) AND o_orderkey % 101 > 100)
WHERE rule IS NOT NULL GROUP BY rule"""

_statement_breaks = {
    1: "value:overallRisk", 2: "value:riskLabel", 3: "missing:summary", 4: "value:categories.textRisk", 5: "unexpected:categories.*",
    6: "value:balanceAnalysis.openingBalance", 7: "missing:balanceAnalysis.difference", 8: "value:transactionAnalysis.transactionCount",
    9: "value:transactionAnalysis.transactionCount", 10: "value:transactionAnalysis.duplicateTransactions", 11: "value:evidence",
    12: "unexpected:response.*",
}
ORACLES["contract_findings"] = f"""
SELECT * FROM (
  SELECT 'receipt' AS contract, o_orderkey AS k,
    CASE {a.CONTRACT_BREAK} {' '.join(f"WHEN {k} THEN '{r}'" for k, r in _breaks.items())} END AS rule FROM orders
  UNION ALL SELECT 'statement', o_orderkey,
    CASE WHEN {a.STATEMENT_PROSE} THEN 'type:response' ELSE
      CASE o_orderkey % 13 {' '.join(f"WHEN {k} THEN '{r}'" for k, r in _statement_breaks.items())} END END FROM orders
  UNION ALL SELECT 'statement', o_orderkey, 'value:balanceAnalysis.calculationConsistent' FROM orders
    WHERE {a.STATEMENT_FLAG} AND NOT ({a.STATEMENT_PROSE}))
WHERE rule IS NOT NULL"""

ORACLES["lenient_json"] = """
SELECT event_id, event_id % 8 NOT IN (2, 5) AS ok,
  CASE WHEN event_id % 8 IN (0, 1, 3, 6, 7) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k
FROM events"""

# --- invoices: notation --------------------------------------------------------------------------------

ORACLES["amount_formats"] = f"""
WITH t AS (SELECT l_orderkey AS k, {a.AMOUNT_TEXT} AS x FROM lineitem),
s AS (SELECT k, CASE WHEN regexp_full_match(x, '[0-9]+') THEN NULL WHEN x LIKE '%,%' THEN 'comma' ELSE 'dot' END AS style FROM t)
SELECT k, CAST(count(DISTINCT style) AS INTEGER) AS n_styles, count(DISTINCT style) > 1 AS mixed FROM s GROUP BY k"""

# --- statements --------------------------------------------------------------------------------------------

HEADER = f"""header AS (
  SELECT user_id, {a.OPENING} AS opening,
    coalesce(sum({a.AMOUNT_IN}), 0) AS total_in, coalesce(sum({a.AMOUNT_OUT}), 0) AS total_out, count(*) AS n,
    count(*) FILTER (WHERE {a.AMOUNT_UNREADABLE}) = 0 AS whole
  FROM events GROUP BY user_id)"""
ORACLES["statement_totals"] = f"""
WITH {HEADER}
SELECT CAST(user_id AS VARCHAR) AS stmt_id, CASE WHEN whole THEN CAST(total_in AS DOUBLE) END AS total_in,
  CASE WHEN whole THEN CAST(total_out AS DOUBLE) END AS total_out,
  CASE WHEN whole THEN CAST(opening + total_in - total_out AS DOUBLE) END AS calculated_closing, n,
  CASE WHEN whole THEN user_id % 5 <> 0 END AS closing_matches, CASE WHEN whole THEN user_id % 7 <> 0 END AS in_matches,
  CASE WHEN whole THEN true END AS out_matches
FROM header"""

ROWS = f"""rows AS (
  SELECT user_id, event_id, {a.MOVE} AS move, {a.OPENING} AS opening,
    row_number() OVER w AS seq, sum({a.MOVE}) OVER w AS total, {a.AMOUNT_UNREADABLE} AS unread,
    count(*) FILTER (WHERE {a.AMOUNT_UNREADABLE}) OVER w = 0 AS clear,
    CASE WHEN NOT ({a.BALANCE_UNREADABLE}) THEN {a.OPENING} + sum({a.MOVE}) OVER w + {a.BALANCE_ERROR} END AS shown
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))"""
ORACLES["statement_running_balance"] = f"""
WITH {ROWS}
SELECT CAST(user_id AS VARCHAR) AS stmt_id, seq, CASE WHEN clear THEN CAST(opening + total AS DOUBLE) END AS expected,
  CAST(shown AS DOUBLE) AS shown, CASE WHEN clear THEN opening + total <> shown END AS is_break FROM rows"""
ORACLES["statement_balance_breaks"] = f"""
WITH {ROWS}, lagged AS (SELECT *, CASE WHEN NOT unread THEN lag(shown) OVER (PARTITION BY user_id ORDER BY seq) + move END AS expected FROM rows)
SELECT CAST(user_id AS VARCHAR) AS stmt_id, seq, CAST(expected AS DOUBLE) AS expected, CAST(shown AS DOUBLE) AS shown,
  coalesce(expected <> shown, false) AS is_break FROM lagged"""
ORACLES["statement_page_breaks"] = f"""
WITH {ROWS}, paged AS (SELECT *, (seq - 1) // 25 + 1 AS page_no FROM rows),
ends AS (
  SELECT user_id, page_no, max(CASE WHEN seq % 25 = 1 THEN shown - move END) AS first_balance, max(seq) AS last_seq
  FROM paged GROUP BY user_id, page_no),
pages AS (
  SELECT e.user_id, e.page_no, e.first_balance, p.shown AS last_balance
  FROM ends e JOIN paged p ON p.user_id = e.user_id AND p.seq = e.last_seq
  WHERE NOT ({a.PAGE_DROPPED.replace('event_user', 'e.user_id').replace('page_no', 'e.page_no')})),
lagged AS (
  SELECT *, lag(page_no) OVER w AS before, lag(last_balance) OVER w AS carried
  FROM pages WINDOW w AS (PARTITION BY user_id ORDER BY page_no))
SELECT CAST(user_id AS VARCHAR) AS stmt_id, CAST(page_no AS BIGINT) AS page_no,
  coalesce(before + 1 = page_no AND carried <> first_balance, false) AS is_break,
  coalesce(before + 1 <> page_no, false) AS is_gap FROM lagged"""

_step = "CAST(floor(value / 50) * 50 AS DOUBLE)"
ORACLES["statement_duplicates"] = f"""
SELECT CAST(user_id AS VARCHAR) AS stmt_id, strftime(ts, '%Y-%m-%d') AS tx_date,
  CASE WHEN event_type <> 'purchase' THEN {_step} END AS amount_in,
  CASE WHEN event_type = 'purchase' THEN {_step} END AS amount_out,
  concat(event_type, ' x') AS description, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS counterparty, count(*) AS n
FROM events GROUP BY ALL HAVING count(*) > 1"""

_tx_text = a.tx_date_text("strftime(d, '%Y-%m-%d')", "strftime(d, '%d.%m.%Y')", "strftime(d, '%d/%m/%Y')")
ORACLES["statement_dates"] = f"""
WITH dated AS (SELECT *, {a.TX_DATE} AS d FROM events),
texts AS (SELECT user_id, event_id, {_tx_text} AS x FROM dated),
days AS (
  SELECT *, CASE WHEN x LIKE '____-__-__' THEN 'iso' WHEN x LIKE '__.__.____' THEN 'dot' WHEN x LIKE '__/__/____' THEN 'slash' ELSE 'other' END AS style,
    CAST(coalesce(try_strptime(x, '%Y-%m-%d'), try_strptime(x, '%d.%m.%Y'), try_strptime(x, '%d/%m/%Y')) AS DATE) AS day
  FROM texts),
lagged AS (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM days)
SELECT CAST(user_id AS VARCHAR) AS stmt_id, count(*) FILTER (WHERE before > day) AS n_backwards,
  count(*) FILTER (WHERE day IS NULL AND style <> 'other') AS n_impossible,
  count(*) FILTER (WHERE style = 'other') AS n_unreadable,
  count(*) FILTER (WHERE day < DATE '2024-01-03' OR day > DATE '2024-01-28') AS n_out_of_period,
  CAST(count(DISTINCT style) AS INTEGER) AS n_formats
FROM lagged GROUP BY user_id"""

_fields = " UNION ALL ".join(
    f"SELECT user_id, '{name}' AS field, {a.page_field(i)} AS value FROM events" for i, name in enumerate(dims.PAGE_FIELDS)
)
ORACLES["page_conflicts"] = f"""
SELECT CAST(user_id AS VARCHAR) AS stmt_id, field, count(DISTINCT value) AS n_values, min(value) AS low, max(value) AS high
FROM (SELECT user_id, field, CASE WHEN field = 'holder' THEN lower(trim(value)) ELSE upper(trim(value)) END AS value FROM ({_fields}))
GROUP BY user_id, field HAVING count(DISTINCT value) > 1"""

# --- frames ----------------------------------------------------------------------------------------------------

ORACLES["frame_sample"] = f"""
WITH f AS (SELECT user_id AS doc_id, event_id AS frame, CAST({a.FRAME_TS} AS DOUBLE) AS ts FROM events),
slots AS (SELECT *, row_number() OVER (PARTITION BY doc_id, floor(ts * 2) ORDER BY ts, frame) AS n FROM f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts, frame) AS r FROM slots WHERE n = 1)
SELECT doc_id, frame, ts, CAST(r AS INTEGER) AS rank FROM ranked WHERE r <= 8"""

ORACLES["frame_conflicts"] = f"""
WITH r AS (SELECT user_id AS doc_id, {pick('event_id', [*dims.FRAME_FIELDS, 'wallpaper'])} AS field,
  trim(regexp_replace({a.FRAME_VALUE}, ' +', ' ', 'g')) AS value FROM events)
SELECT doc_id, field, count(DISTINCT value) AS n_values, min(value) AS low, max(value) AS high FROM r WHERE field <> 'wallpaper'
GROUP BY doc_id, field HAVING count(DISTINCT value) > 1"""

# --- chain -------------------------------------------------------------------------------------------------------

_valid = "regexp_full_match(trim(address), 'T[1-9A-HJ-NP-Za-km-z]{33}')"
REQUESTED = f"requested AS (SELECT c_custkey AS k, {a.REQUESTED_ADDRESS} AS address FROM customer)"
TOKENS = f"""tokens AS (
  SELECT *, {a.address_of(a.TOKEN_KEY)} AS token_address FROM part WHERE {a.TOKEN_FOUND})"""
ORACLES["address_valid"] = f"WITH {REQUESTED} SELECT k, {_valid} AS valid FROM requested"
ORACLES["address_class"] = f"""
WITH {REQUESTED}, {TOKENS}
SELECT k, CASE WHEN p_partkey IS NULL THEN 'WALLET' ELSE 'TOKEN_CONTRACT' END AS address_type, p_name AS token_name
FROM requested LEFT JOIN tokens ON trim(address) = token_address"""

_has = f"({a.SECURITY_PRESENT})"
_token_rules = [
    ("TOKEN_UNSAFE", 45, f"{_has} AND p_partkey % 11 <> 0 AND p_size % 6 = 4"),
    ("TOKEN_SUSPECT", 30, f"{_has} AND p_partkey % 11 <> 0 AND p_size % 6 = 3"),
    ("TOKEN_LEVEL_UNKNOWN", 10, f"{_has} AND (p_partkey % 11 = 0 OR p_size % 6 = 0)"),
    ("TOKEN_NOT_VIP", 5, f"{_has} AND p_partkey % 3 = 1"),
    ("SUPPLY_INCREASABLE", 20, f"{_has} AND p_partkey % 2 = 1"),
    ("BLACKLIST_FEATURE", 10, f"{_has} AND p_partkey % 3 = 1"),
    ("NOT_OPEN_SOURCE", 10, f"{_has} AND p_partkey % 4 = 0"),
    ("PROXY_CONTRACT", 10, f"{_has} AND p_partkey % 5 = 0"),
    ("NO_LIQUIDITY", 15, f"NOT {_has} OR p_partkey % 6 < 3"),
    ("LOW_LIQUIDITY", 10, f"{_has} AND p_partkey % 6 = 3"),
]


def _sum(rules: list[tuple[str, int, str]]) -> str:
    return "least(100, " + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for _, p, c in rules) + ")"


def _join(rules: list[tuple[str, int, str]], separator: str, text=lambda code: sql_text(code)) -> str:
    return f"concat_ws('{separator}', " + ", ".join(f"CASE WHEN {c} THEN {text(r)} END" for r, _, c in rules) + ")"


ORACLES["token_risk"] = f"""
WITH s AS (SELECT *, {_sum(_token_rules)} AS score FROM part)
SELECT p_partkey AS k, CAST(score AS INTEGER) AS score, {_label('score')} AS label, {_join(_token_rules, ',')} AS codes,
  {_join(_token_rules, '|', lambda r: sql_text(dims.TOKEN_WARNINGS[r]))} AS warnings FROM s"""

_age = "(c_custkey % 50)"
_wallet_rules = [
    ("ACCOUNT_FLAGGED", 60, "c_custkey % 5 = 0"),
    ("PUBLIC_TAG", 0, "c_custkey % 6 = 0"),
    ("VIP_ACCOUNT", 0, "c_custkey % 8 = 0"),
    ("NO_TRANSACTIONS", 10, "c_custkey % 4 = 0"),
    ("TRANSFERS_FOUND", 0, "n > 0"),
    ("NO_TRANSFERS", 0, "n = 0"),
    ("VERY_NEW", 15, f"c_custkey % 7 <> 0 AND {_age} < 7"),
    ("NEW", 5, f"c_custkey % 7 <> 0 AND {_age} >= 7 AND {_age} < 30"),
]
WALLETS = """wallets AS (
  SELECT c.*, coalesce(n, 0) AS n
  FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t ON t.o_custkey = c.c_custkey)"""


def _wallet_text(code: str) -> str:
    text = dims.WALLET_WARNINGS[code]
    if "{}" not in text:
        return sql_text(text)
    head, tail = text.split("{}")
    filler = "'Borsa'" if code == "PUBLIC_TAG" else "CAST(n AS VARCHAR)"
    return f"concat({sql_text(head)}, {filler}, {sql_text(tail)})"


ORACLES["wallet_risk"] = f"""
WITH {WALLETS}, s AS (SELECT *, {_sum(_wallet_rules)} AS score FROM wallets WHERE {a.ACCOUNT_PRESENT})
SELECT c_custkey AS k, CAST(score AS INTEGER) AS score, {_label('score')} AS label, {_join(_wallet_rules, ',')} AS codes,
  {_join(_wallet_rules, '|', _wallet_text)} AS warnings FROM s"""

ORACLES["recent_transfers"] = f"""
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders)
SELECT {a.address_of('o_custkey')} AS address, concat('tx', lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS "transactionHash",
  CASE WHEN o_orderkey % 2 = 1 THEN 'Tfrom' ELSE 'Tfrom2' END AS "from", 'Tto' AS "to",
  CASE WHEN o_orderkey % 2 = 1 THEN 'USDT' ELSE 'TRX' END AS token,
  CASE WHEN o_orderkey % 2 = 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) ELSE '1' END AS amount,
  CAST(epoch(o_orderdate) AS BIGINT) AS "timestamp", CAST(r AS INTEGER) AS rank
FROM t WHERE r <= 20"""

ORACLES["token_projection"] = f"""
WITH {TOKENS}
SELECT p_partkey AS k, p_name AS name, CASE WHEN p_partkey % 4 <> 0 THEN nullif(p_brand, '') END AS symbol,
  p_type AS "contractName", CASE WHEN p_partkey % 3 = 0 THEN 'Tcontract' ELSE token_address END AS "contractAddress",
  CAST(NULL AS VARCHAR) AS issuer, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 19 AS INTEGER) END AS decimals,
  CAST(p_size AS VARCHAR) AS "totalSupply", nullif(p_partkey % 6, 0) AS holders, nullif(p_partkey % 9 * 10, 0) AS transfers,
  CAST(NULL AS BIGINT) AS "transfers24h", nullif(p_retailprice, 0) AS "priceUsd", CAST(NULL AS DOUBLE) AS "liquidityUsd",
  nullif(p_retailprice * 2, 0) AS "marketCapUsd",
  CASE WHEN {_has} THEN CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END END AS vip,
  CASE WHEN {_has} AND p_partkey % 11 <> 0 THEN CAST(p_size % 6 AS VARCHAR) END AS "tokenLevel",
  CASE WHEN {_has} THEN CASE WHEN p_partkey % 4 = 0 THEN 'false' ELSE 'true' END END AS "openSource",
  CAST(NULL AS VARCHAR) AS "hasUrl"
FROM tokens"""

ORACLES["security_projection"] = f"""
SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS vip, CAST(p_partkey % 3 AS VARCHAR) AS blacklist,
  CAST(p_partkey % 2 AS VARCHAR) AS "canIncreaseSupply", CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size % 6 AS VARCHAR) END AS "tokenLevel",
  nullif({a.HAS_URL}, 'null') AS "hasUrl", CASE WHEN p_partkey % 7 <> 0 THEN {a.SWAP_TOKEN} END AS "swapToken",
  CASE p_partkey % 6 WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN '500' WHEN 4 THEN '5000' WHEN 5 THEN 'n/a' END AS liquidity,
  CASE WHEN p_partkey % 4 = 0 THEN 'false' ELSE 'true' END AS "openSource", CASE WHEN p_partkey % 5 = 0 THEN 'true' ELSE 'false' END AS proxy
FROM part"""
ORACLES["transfer_lists"] = f"""
SELECT {a.address_of('c_custkey')} AS address, concat(name, c_custkey) AS "transactionHash", CAST(c_custkey AS VARCHAR) AS amount
FROM customer JOIN (SELECT unnest([0, 0, 1]) AS kind, unnest(['b', 'c', 'a']) AS name) ON c_custkey % 4 = kind"""

ORACLES["wallet_projection"] = f"""
SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS "balanceTRX", CAST(c_custkey % 4 AS VARCHAR) AS transactions,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST({a.ACCOUNT_CREATED} AS VARCHAR) END AS "dateCreated",
  CASE WHEN c_custkey % 8 = 0 THEN 'true' END AS vip,
  CASE WHEN c_custkey % 5 = 0 THEN 'true' ELSE 'false' END AS risk,
  CASE WHEN c_custkey % 6 = 0 THEN 'Borsa' ELSE '' END AS "publicTag", CAST(NULL AS VARCHAR) AS "publicTagDesc",
  CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name
FROM customer WHERE {a.ACCOUNT_PRESENT}"""

ORACLES["address_scores"] = f"""
WITH {REQUESTED}, {TOKENS}, {WALLETS},
wanted AS (SELECT DISTINCT trim(address) AS address FROM requested),
token_scores AS (SELECT token_address, {_sum(_token_rules)} AS score, {_join(_token_rules, ',')} AS codes FROM tokens),
wallet_scores AS (
  SELECT {a.address_of('c_custkey')} AS wallet_address, n, {a.ACCOUNT_PRESENT} AS known,
    {_sum(_wallet_rules)} AS score, {_join(_wallet_rules, ',')} AS codes FROM wallets),
joined AS (
  SELECT address, {_valid} AS valid, t.score AS ts, t.codes AS tc, w.known, w.score AS ws, w.codes AS wc, w.n
  FROM wanted LEFT JOIN token_scores t ON address = token_address LEFT JOIN wallet_scores w ON address = wallet_address),
scored AS (
  SELECT address, CASE WHEN NOT valid THEN '{dims.INVALID_ADDRESS}' WHEN ts IS NULL AND NOT coalesce(known, false) THEN '{dims.NO_ACCOUNT}' END AS error,
    CAST(coalesce(ts, ws) AS INTEGER) AS score, coalesce(tc, wc) AS codes, ts IS NOT NULL AS is_token, n FROM joined)
SELECT address, error IS NULL AS success, error,
  CASE WHEN error IS NULL THEN CASE WHEN is_token THEN 'TOKEN_CONTRACT' ELSE 'WALLET' END END AS address_type,
  CASE WHEN error IS NULL THEN score END AS score, CASE WHEN error IS NULL THEN {_label('score')} END AS label,
  CASE WHEN error IS NULL THEN codes END AS codes,
  CASE WHEN error IS NULL AND NOT is_token THEN CAST(n AS BIGINT) END AS n_transfers,
  CASE WHEN error IS NULL AND NOT is_token AND n > 0 THEN CAST(least(n, 20) AS INTEGER) END AS n_listed
FROM scored"""

# --- files ----------------------------------------------------------------------------------------------------------


def _type(mime: str, name: str) -> str:
    m, n = f"lower(coalesce({mime}, ''))", f"lower(coalesce({name}, ''))"
    return f"""CASE WHEN {m} = 'application/pdf' OR {n} LIKE '%.pdf' THEN 'pdf'
    WHEN {m} LIKE 'image/%' OR {n} LIKE '%.jpg' OR {n} LIKE '%.jpeg' OR {n} LIKE '%.png' OR {n} LIKE '%.webp' THEN 'image'
    WHEN {m} LIKE 'video/%' OR regexp_matches({n}, '[.](mp4|mov|avi|mkv|webm)$') THEN 'video' END"""


ORACLES["document_types"] = f"""
WITH p AS (SELECT page_id, {a.FILE_MIME} AS mime, {a.FILE_NAME} AS name FROM pages)
SELECT page_id, {_type('mime', 'name')} AS type FROM p"""

RESOLVED = f"""p AS (
  SELECT page_id, {a.FILE_MIME} AS m0, CASE WHEN page_id % 13 <> 0 THEN {a.FILE_NAME} END AS original,
    {pick('page_id', a.BANK_SPELLINGS)} AS bank_name, {a.UPLOAD_FIELD} AS field,
    CASE WHEN {a.FORM_STATEMENT} = 'true' THEN 'statement' ELSE coalesce(nullif({a.FORM_TYPE}, ''), 'document') END AS type
  FROM pages),
n AS (
  SELECT *, CASE WHEN field <> 'none' THEN m0 END AS mime,
    CASE WHEN page_id % 4 = 0 THEN 'form.png' WHEN field <> 'none' AND original IS NOT NULL THEN original ELSE 'document' END AS file_name
  FROM p),
e AS (SELECT *, lower(regexp_extract(file_name, '[^/]([.][^./]*)$', 1)) AS ext FROM n),
s1 AS (
  SELECT *, CASE WHEN type IN ('image', 'statement') AND coalesce(mime NOT LIKE 'image/%', true)
    THEN CASE ext WHEN '.png' THEN 'image/png' WHEN '.webp' THEN 'image/webp' ELSE 'image/jpeg' END ELSE mime END AS m1 FROM e),
s2 AS (
  SELECT *, CASE WHEN type IN ('pdf', 'statement') AND coalesce(m1 NOT LIKE '%pdf%', true) AND ext = '.pdf'
    THEN 'application/pdf' ELSE m1 END AS m2 FROM s1),
resolved AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, type, file_name, {_bank('bank_name')} AS bank,
  CASE WHEN type = 'video' AND coalesce(m2 NOT LIKE 'video/%', true) THEN 'video/mp4' ELSE m2 END AS mime,
  CASE WHEN field = 'none' THEN '{dims.NO_UPLOAD}' WHEN type NOT IN ('image', 'pdf', 'video', 'statement') THEN '{dims.UNSUPPORTED_TYPE}' END AS error
FROM s2)"""
ORACLES["mime_repair"] = f"WITH {RESOLVED} SELECT * FROM resolved"
_template_data = " ".join(f"WHEN '{f}' THEN to_base64(encode({sql_text(c.decode())}))" for f, c in a.TEMPLATE_FILES.items())
ORACLES["model_requests"] = f"""
WITH bundles AS (
  SELECT {a.BUNDLE} AS page_id, min(url) AS url,
    concat(CAST({a.BUNDLE} AS VARCHAR), chr(10), string_agg(coalesce(html, ''), chr(10) ORDER BY page_id), chr(10)) AS content
  FROM pages GROUP BY {a.BUNDLE}),
{RESOLVED.replace('FROM pages', 'FROM bundles')},
filed AS (
  SELECT r.* REPLACE (coalesce(error, CASE WHEN page_id % 17 = 5 THEN '{dims.EMPTY_FILE}' END) AS error),
    CASE WHEN r.type NOT IN ('video', 'statement') THEN CASE r.bank {_present} END END AS reference,
    to_base64(encode(content)) AS data
  FROM resolved r JOIN bundles ON doc_id = CAST(page_id AS VARCHAR)),
told AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN type = 'video' THEN 0 WHEN type = 'pdf' AND reference IS NOT NULL THEN 2 ELSE 1 END AS n,
    type = 'pdf' OR type = 'statement' AND mime LIKE '%pdf%' AS pdf FROM filed)
SELECT doc_id, type, bank, reference, error, n AS n_parts,
  CASE WHEN error IS NULL THEN CASE WHEN type IN ('statement', 'video') THEN type ELSE 'receipt' END END AS prompt,
  CASE WHEN n = 0 THEN '' WHEN n = 2 THEN 'input_file|input_file' WHEN n = 1 AND pdf THEN 'input_file' WHEN n = 1 THEN 'input_image' END AS kinds,
  CASE WHEN n = 0 THEN '' WHEN n = 2 THEN concat(file_name, '|', reference) WHEN n = 1 AND pdf THEN file_name WHEN n = 1 THEN '-' END AS names,
  sha256(CASE WHEN n = 0 THEN '' WHEN n IS NOT NULL THEN concat('data:', CASE WHEN pdf THEN 'application/pdf' ELSE mime END, ';base64,', data,
    CASE WHEN n = 2 THEN concat('|data:application/pdf;base64,', CASE reference {_template_data} END) ELSE '' END) END) AS data_sha256
FROM told"""

# --- claims -----------------------------------------------------------------------------------------------------------

_CUR = r"(TL|TRY|₺|EUR|EURO|USD|\$)"
_NUM = r"(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
_GROUPED = r"\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?"
_BANKS = (
    r"(?i)\b(akbank|garanti(?:\s+bbva)?|garanti\s+bankası|enpara|vakıfbank|iş\s+bankası|isbankası"
    r"|ziraat(?:\s+bankası)?|denizbank|halkbank|yapı\s+kredi)\b"
)


def _first(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(t, {sql_text(pattern)}, {group}), '')"


def _is(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {sql_text(pattern)})"


_iban_line = rf"(?i)iban|(?i)\bTR\d{{2}}"
_clock, _long = r"^\d{1,2}[.:]\d{2}$", r"^\d{5,}$"
_amount_line = rf"(?i)^{_GROUPED}\s*{_CUR}$"
_packed = r"regexp_replace(x, '\s', '', 'g')"
CLAIMS = rf"""
raw AS (SELECT c_custkey AS k, trim(replace({a.CAPTION}, chr(13), ''), concat(' ', chr(10), chr(9))) AS t FROM customer),
split AS (
  SELECT k, nullif(t, '') AS t,
    [y for y in [regexp_replace(trim(x), '[\s\x{{00a0}}]+', ' ', 'g') for x in string_split(t, chr(10))] if y <> ''] AS lines FROM raw),
found AS (
  SELECT *, trim({_first(r'(?i)(?:gönderen|gonderen|sender)\s*[:\-]?\s*([^\n]+)')}) AS sender,
    trim({_first(r'(?i)(?:alıcı|alici|recipient)\s*[:\-]?\s*([^\n]+)')}) AS recipient,
    upper(regexp_replace({_first(r'(?i)\b([A-Z]{2}\s?\d{2}(?:\s?\d{4}){4,7})\b')}, '\s+', '', 'g')) AS iban,
    {_first(rf'(?i)(?:^|\s){_NUM}\s*{_CUR}(?:\s|$)', 1)} AS a1, {_first(rf'(?i)(?:^|\s){_NUM}\s*{_CUR}(?:\s|$)', 2)} AS c1,
    {_first(rf'(?i)(?:tutar|miktar|amount)\s*[:\-]?\s*([0-9][0-9.,]*)\s*{_CUR}?', 1)} AS a2,
    {_first(rf'(?i)(?:tutar|miktar|amount)\s*[:\-]?\s*([0-9][0-9.,]*)\s*{_CUR}?', 2)} AS c2,
    [x for x in lines if NOT {_is('x', _iban_line)} AND NOT {_is('x', _clock)} AND {_is('x', f'^{_NUM}$')}] AS bare,
    [x for x in lines if NOT ({_is('x', _iban_line)} OR {_is('x', _BANKS)} OR {_is('x', _clock)}
      OR {_is('x', _amount_line)} OR {_is(_packed, _long)})] AS clean,
    coalesce(list_position([{_is('x', _BANKS)} for x in lines], true), 0) AS bank_at,
    coalesce(list_position([{_is('x', _amount_line)} for x in lines], true), 0) AS amount_at
  FROM split),
guess AS (
  SELECT *, sender IS NULL AND recipient IS NULL AND len(clean) > 0 AS free,
    [x for x in lines[1:greatest(bank_at, 1) - 1] if NOT ({_is(_packed, _long)} OR {_is('x', _clock)})] AS before,
    [x for x in lines[amount_at + 1:len(lines)] if NOT ({_is('x', _iban_line)} OR {_is('x', _BANKS)} OR {_is('x', _clock)})] AS after
  FROM found)"""
ORACLES["claim_fields"] = f"""
WITH {CLAIMS}
SELECT k,
  coalesce(sender, CASE WHEN free AND bank_at > 1 AND len(before) > 0 THEN array_to_string(before, ' ') END,
    CASE WHEN len(clean) >= 2 THEN clean[1] END) AS "senderName",
  coalesce(recipient, CASE WHEN free AND amount_at > 0 AND len(after) > 0 THEN array_to_string(after, ' ') END,
    CASE WHEN len(clean) >= 2 THEN clean[len(clean)] END) AS "recipientName",
  coalesce(a2, a1, bare[1]) AS amount,
  upper(coalesce(c2, c1, CASE WHEN {_is('t', '(?i)TL|TRY|₺')} THEN 'TRY' END)) AS currency, iban
FROM guess"""
ORACLES["claim_ibans_fixed"] = f"""
SELECT c_custkey AS k, CASE WHEN c_custkey % 4 < 2 THEN 'TR400001500011122233344445' END AS iban FROM customer"""


def _name(x: str) -> str:
    return f"nullif(lower(translate(trim(regexp_replace({x}, ' +', ' ', 'g')), 'İIŞĞÜÖÇ', 'iışğüöç')), '')"


def _amount(x: str) -> str:
    return f"""coalesce(CAST(CASE WHEN regexp_full_match({x}, '[0-9]+') THEN CAST({x} AS DECIMAL(18,2))
    WHEN regexp_full_match({x}, '[0-9]{{1,3}}([.][0-9]{{3}})+(,[0-9]{{1,2}})?|[0-9]+,[0-9]{{1,2}}') THEN TRY_CAST(replace(replace({x}, '.', ''), ',', '.') AS DECIMAL(18,2))
    WHEN regexp_full_match({x}, '[0-9]{{1,3}}(,[0-9]{{3}})+([.][0-9]{{1,2}})?|[0-9]+[.][0-9]{{1,2}}') THEN TRY_CAST(replace({x}, ',', '') AS DECIMAL(18,2)) END AS VARCHAR), nullif({x}, ''))"""


def _currency(x: str) -> str:
    return f"CASE upper({x}) WHEN 'TL' THEN 'TRY' WHEN '₺' THEN 'TRY' WHEN 'EURO' THEN 'EUR' WHEN '$' THEN 'USD' ELSE nullif(upper({x}), '') END"


_shape = {
    "senderName": _name, "recipientName": _name, "amount": _amount, "currency": _currency,
    "iban": lambda x: f"nullif(upper(replace({x}, ' ', '')), '')",
}


def _verdict(field: str) -> str:
    said, seen = _shape[field](f"({a.CLAIMED[field]})"), _shape[field](f"({a.READ[field]})")
    return (
        f"CASE WHEN {said} IS NOT NULL THEN CASE WHEN c_custkey % 11 = 0 OR {seen} IS NULL THEN 'unknown' "
        f"WHEN {said} = {seen} THEN 'match' ELSE 'mismatch' END END"
    )


_flags = [(f, label) for f, label in dims.CLAIM_FIELD_LABELS.items()]
ORACLES["claim_compare"] = f"""
WITH v AS (SELECT c_custkey AS k, {', '.join(f'{_verdict(f)} AS v{i}' for i, (f, _) in enumerate(_flags))} FROM customer),
c AS (
  SELECT k, {' + '.join(f"CASE WHEN v{i} IS NOT NULL THEN 1 ELSE 0 END" for i in range(5))} AS given,
    {' + '.join(f"CASE WHEN v{i} = 'mismatch' THEN 1 ELSE 0 END" for i in range(5))} AS bad,
    {' + '.join(f"CASE WHEN v{i} = 'unknown' THEN 1 ELSE 0 END" for i in range(5))} AS open,
    concat_ws(',', {', '.join(f"CASE WHEN v{i} = 'mismatch' THEN '{label}' END" for i, (_, label) in enumerate(_flags))}) AS fields
  FROM v)
SELECT k, CASE WHEN given = 0 THEN 'none' WHEN bad = 0 AND open = 0 THEN 'consistent' WHEN bad > 0 THEN 'mismatch' ELSE 'unverified' END AS state,
  CAST(bad AS INTEGER) AS n_mismatch, CAST(open AS INTEGER) AS n_unknown, fields, given > 0 AS has_claim
FROM c"""

ORACLES["iban_bic"] = f"""
WITH b AS (SELECT s_suppkey AS k, {a.BBAN} AS bban, {a.BIC} AS bic FROM supplier)
SELECT k, CASE WHEN k % 8 = 6 THEN NULL ELSE k % 8 NOT IN (3, 5) END AS iban_ok,
  regexp_full_match(trim(bic), '[A-Z]{{6}}[A-Z0-9]{{2}}([A-Z0-9]{{3}})?') AS bic_ok FROM b"""

_digits = " UNION ALL ".join(
    f"SELECT doc_id, '{d}' AS digit, length(text) - length(replace(text, '{d}', '')) AS n FROM documents" for d in range(10)
)
ORACLES["digit_repeats"] = f"SELECT doc_id, digit, CAST(n AS INTEGER) AS n FROM ({_digits}) WHERE n >= 2"
ORACLES["digit_states"] = f"""
WITH d AS (SELECT doc_id, max(n) AS most, sum(n) AS total FROM ({_digits}) GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'no_text' WHEN total < 2 THEN 'too_few' WHEN most < 2 THEN 'no_repeats' ELSE 'ready' END AS state
FROM documents JOIN d USING (doc_id)"""

# --- updates -----------------------------------------------------------------------------------------------------------

CHAT = f"""
both_ AS (
  SELECT {a.CHAT_KEY} AS u, text AS body FROM conversations
  UNION ALL SELECT 1000000000 + event_id, props FROM events),
flat AS (SELECT u, {', '.join(f'{sql} AS {name}' for name, sql in a.CHAT.items())} FROM both_),
filed AS (
  SELECT *, CASE WHEN is_callback THEN has_menu AND has_original ELSE has_message END AS has_source,
    CASE file_kind WHEN 'photo' THEN 'image' WHEN 'photos' THEN 'image' WHEN 'video' THEN 'video' WHEN 'pdf' THEN 'pdf' WHEN 'document' THEN 'video' END AS kind
  FROM flat),
routed AS (
  SELECT *, CASE WHEN has_source THEN kind END AS file_type, CASE
    WHEN is_callback THEN CASE WHEN callback_id = '' OR NOT has_menu OR chat_id = 0 THEN 'drop'
      WHEN NOT has_original THEN 'no_original' WHEN kind IS NULL THEN 'no_file'
      WHEN starts_with(data, 'bank:') THEN 'receipt' WHEN coalesce(data, '') <> 'mode:statement' THEN 'invalid_choice'
      WHEN kind = 'video' THEN 'statement_video' ELSE 'statement' END
    WHEN NOT has_message OR chat_id = 0 THEN 'drop'
    WHEN starts_with(text, '/start') THEN 'welcome' WHEN starts_with(text, '/') THEN 'help'
    WHEN file_kind IN ('none', 'empty_photo') THEN 'ask_file' WHEN kind IS NULL THEN 'unsupported_file' ELSE 'menu' END AS route
  FROM filed)"""
_file = {
    "file_id": "CASE file_kind WHEN 'photo' THEN 'p1' WHEN 'photos' THEN 'large' WHEN 'video' THEN 'v1' WHEN 'pdf' THEN 'd1' WHEN 'document' THEN 'd3' END",
    "file_name": "CASE file_kind WHEN 'video' THEN 'telegram-video.mp4' WHEN 'pdf' THEN 'a.pdf' WHEN 'document' THEN 'telegram-document' ELSE 'telegram-photo.jpg' END",
    "mime": "CASE file_kind WHEN 'video' THEN 'video/mp4' WHEN 'pdf' THEN 'application/octet-stream' WHEN 'document' THEN 'video/webm' ELSE 'image/jpeg' END",
}
_bank_choice = "CASE WHEN is_callback AND starts_with(data, 'bank:') THEN substring(data, 6) END"
ORACLES["update_route"] = f"""
WITH {CHAT}
SELECT CAST(u AS BIGINT) AS update_id, route, CASE WHEN NOT is_callback AND NOT has_message OR is_callback AND NOT has_menu THEN NULL ELSE chat_id END AS chat_id,
  {_bank_choice} AS bank, CASE WHEN has_source THEN {_file['file_id']} END AS file_id, file_type,
  CASE WHEN NOT has_source THEN '' WHEN is_callback THEN coalesce(nullif(caption, ''), nullif(text, ''), '')
    ELSE coalesce(nullif(text, ''), nullif(caption, ''), '') END AS text
FROM routed"""
ORACLES["update_requests"] = f"""
WITH {CHAT}
SELECT CAST(u AS VARCHAR) AS doc_id, CASE route WHEN 'statement' THEN 'statement' ELSE kind END AS type,
  {_file['file_name']} AS file_name, {_file['mime']} AS mime, CASE WHEN route = 'receipt' THEN substring(data, 6) END AS bank,
  CASE WHEN route = 'statement' THEN 'true' END AS statement_mode, CAST(u AS BIGINT) AS reply_to
FROM routed WHERE route IN ('receipt', 'statement')"""
_messages = " ".join(f"WHEN '{r}' THEN {sql_text(t)}" for r, t in dims.ROUTE_MESSAGES.items())
ORACLES["update_outbox"] = f"""
WITH {CHAT}
SELECT CAST(u AS BIGINT) AS update_id, chat_id,
  CASE route {_messages} WHEN 'statement' THEN concat('Hesap özeti seçildi.', chr(10), chr(10), {_file['file_name']})
    ELSE concat(CASE substring(data, 6) {_displays} ELSE substring(data, 6) END, ' seçildi.', chr(10), chr(10), {_file['file_name']}) END AS text,
  CASE WHEN route IN ('receipt', 'statement', 'statement_video', 'menu') THEN CAST(u AS BIGINT) END AS reply_to_message_id
FROM routed WHERE route <> 'drop'"""

_started = (
    f"CASE route {_messages} WHEN 'statement' THEN concat('Hesap özeti seçildi.', chr(10), chr(10), {_file['file_name']}) "
    f"ELSE concat(CASE substring(data, 6) {_displays} ELSE substring(data, 6) END, ' seçildi.', chr(10), chr(10), {_file['file_name']}) END"
)
_claimed = """CASE WHEN caption <> '' THEN '{"senderName":null,"recipientName":null,"amount":"12","currency":"TL","iban":null}' END"""
_error_head = f"concat({sql_text(dims.PROCESS_ERROR)}, chr(10), chr(10), "
_none = {"type": "VARCHAR", "file_name": "VARCHAR", "bank": "VARCHAR", "provided_info": "VARCHAR", "text": "VARCHAR", "error": "VARCHAR", "record": "VARCHAR",
         "update_id": "BIGINT", "chat_id": "BIGINT", "reply_to": "BIGINT"}


def _flow_rows(kind: str, source: str, **columns: str) -> str:
    listed = ", ".join(f"CAST({columns.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _none.items())
    return f"SELECT '{kind}' AS kind, CAST(batch AS BIGINT) AS batch, {listed} FROM {source}"


ORACLES["chat_flow"] = f"""
WITH {CHAT},
deliveries AS (
  SELECT *, unnest(range({a.FIRST_BATCH}, CASE WHEN {a.AGAIN} THEN 3 ELSE {a.FIRST_BATCH} + 1 END)) AS batch, {a.FIRST_BATCH} AS first_batch,
    {a.TORN} AS torn, {a.MISTYPED} AS mistyped FROM routed),
unread AS (
  SELECT batch, CASE WHEN torn THEN {a.TORN_LINE} ELSE {a.MISTYPED_LINE} END AS line, CASE WHEN NOT torn THEN chat_id END AS chat FROM deliveries WHERE torn OR mistyped),
read AS (
  SELECT *, batch = first_batch OR (first_batch = 0 AND batch = 2) AS fresh, {a.RAISING.format(u="u")} AND route <> 'drop' AS raising,
    {a.NO_FILE.format(u="u")} AND route IN ('receipt', 'statement') AS no_file FROM deliveries WHERE NOT torn AND NOT mistyped),
bad AS (
  SELECT batch, u, chat_id AS chat,
    CASE WHEN no_file THEN concat('Dosya yok: ', {_file['file_id']}) ELSE concat('Belge okunamadı: ', u) END AS error
  FROM read WHERE fresh AND (no_file OR raising)),
good AS (SELECT * FROM read WHERE fresh AND NOT no_file AND NOT raising)
{_flow_rows("request", "good WHERE route IN ('receipt', 'statement')", update_id="u", chat_id="chat_id", reply_to="u",
            type="CASE route WHEN 'statement' THEN 'statement' ELSE kind END", file_name=_file['file_name'],
            bank="CASE WHEN route = 'receipt' THEN substring(data, 6) END", provided_info=_claimed)}
UNION ALL {_flow_rows("message", "good WHERE route <> 'drop'", update_id="u", chat_id="chat_id", text=_started,
                      reply_to="CASE WHEN route IN ('receipt', 'statement', 'statement_video', 'menu') THEN u END")}
UNION ALL {_flow_rows("message", "bad WHERE chat <> 0", update_id="u", chat_id="chat", text=_error_head + "error)")}
UNION ALL {_flow_rows("message", "unread WHERE chat <> 0", chat_id="chat", text=_error_head + sql_text(dims.UNREADABLE) + ")")}
UNION ALL {_flow_rows("duplicate", "read WHERE NOT fresh", update_id="u")}
UNION ALL {_flow_rows("reject", "bad", error="error")}
UNION ALL {_flow_rows("reject", "unread", error=sql_text(dims.UNREADABLE), record="line")}"""

_spoilt = " UNION ALL ".join(
    f"SELECT '{source}' AS source, CASE WHEN {a.torn(key)} OR {a.trailed(key)} THEN {a.spoilt_line(key, line)} END AS record FROM {name}"
    for source, (name, key, line) in a.SOURCE_LINES.items()
)
ORACLES["reject_ledger"] = f"""
WITH {CHAT},
deliveries AS (SELECT *, unnest(range({a.FIRST_BATCH}, CASE WHEN {a.AGAIN} THEN 3 ELSE {a.FIRST_BATCH} + 1 END)) AS batch FROM flat),
lines AS (
  SELECT 'updates' AS source, CASE WHEN {a.TORN} THEN {a.TORN_LINE} WHEN {a.MISTYPED} THEN {a.MISTYPED_LINE} END AS record FROM deliveries
  UNION ALL {_spoilt}),
numbered AS (SELECT *, count(*) OVER (PARTITION BY source) AS n_read, count(record) OVER (PARTITION BY source) AS n_rejected FROM lines)
SELECT source, record, {sql_text(dims.UNREADABLE)} AS error, n_read, n_read - n_rejected AS n_accepted, n_rejected FROM numbered WHERE record IS NOT NULL"""
ORACLES["results_rerun"] = f"""
SELECT address, address_type AS type, success, error, score, CASE WHEN success THEN CAST(CASE address_type WHEN 'WALLET' THEN 2 ELSE 1 END AS INTEGER) END AS edition
FROM ({ORACLES['address_scores']})"""

ORACLES["update_dedup_batch"] = f"""
SELECT event_id AS update_id, 0 AS copy, CAST(CASE WHEN {a.REPLAYED} THEN 3 ELSE 1 END AS BIGINT) AS n_copies FROM events
UNION ALL SELECT event_id, c.copy, CAST(1 AS BIGINT) FROM events, (SELECT 3 AS copy UNION ALL SELECT 4 AS copy) c WHERE {a.REPLAYED}"""
ORACLES["update_dedup_stream"] = "SELECT event_id AS update_id FROM events"

# --- reports -------------------------------------------------------------------------------------------------------------

_nl = "chr(10)"


def _lines(text: str) -> str:
    """SQL of a text with line breaks."""
    return "concat(" + f", {_nl}, ".join(sql_text(part) for part in text.split("\n")) + ")"


_head = _lines(f"\n\n{dims.RULE_LINE}\n{dims.CLAIM_TITLE}\n\n")
_foot = _lines(f"\n\n{dims.CLAIM_NOTE}")
_m1, _m2 = pick("o_orderkey", a.REPORT_MATCHES), pick("o_orderkey", ["match", None, "mismatch"])
ORACLES["report_text"] = f"""
WITH r AS (
  SELECT o_orderkey AS k, {pick('o_orderkey', ['pdf', 'statement', 'image', 'video'])} AS type, o_orderkey % 201 AS halves,
    {pick('o_orderkey', ['LOW RISK', '', None])} AS risk_label, o_orderkey % 101 AS confidence,
    {pick('o_orderkey', ['Özet metni.', '', None])} AS summary, {pick('o_orderkey', ['akbank', None, 'isbankasi', 'foo', ''])} AS bank,
    {_m1} AS m1, {_m2} AS m2, o_orderkey % 9 <> 0 AND o_orderkey % 4 <> 0 AS asked, o_orderkey % 7 = 0 AS warned FROM orders),
s AS (SELECT *, coalesce(m1 = 'mismatch', false) AS b1, coalesce(m2 = 'mismatch', false) AS b2, coalesce(m1 = 'unknown', false) AS u FROM r),
block AS (
  SELECT *, CASE WHEN NOT asked THEN ''
    WHEN NOT b1 AND NOT b2 AND NOT u AND NOT warned THEN concat({_head}, {sql_text(dims.CLAIM_CONSISTENT)}, {_foot})
    ELSE concat({_head}, CASE WHEN b1 OR b2 THEN {sql_text(dims.CLAIM_MISMATCH)} ELSE {sql_text(dims.CLAIM_UNVERIFIED)} END,
      CASE WHEN warned THEN concat({_nl}, {_nl}, '• bir', {_nl}, '• iki') ELSE '' END,
      CASE WHEN b1 THEN concat({_nl}, '• Gönderen adı: {dims.FIELD_MISMATCH}') ELSE '' END,
      CASE WHEN b2 THEN concat({_nl}, '• other: {dims.FIELD_MISMATCH}') ELSE '' END, {_foot}) END AS note FROM s)
SELECT k, concat(CASE WHEN type = 'statement' THEN '{dims.REPORT_TITLES['statement']}' ELSE '{dims.REPORT_TITLES['receipt']}' END, {_nl}, {_nl},
  CASE WHEN type <> 'statement' AND coalesce(bank, '') <> '' THEN concat('Banka: ', CASE bank {_displays} ELSE bank END, {_nl}) ELSE '' END,
  'Risk Skoru: ', CASE WHEN halves % 2 = 0 THEN CAST(halves // 2 AS VARCHAR) ELSE concat(CAST(halves // 2 AS VARCHAR), '.5') END, '/100', {_nl}, {_nl},
  'Risk Seviyesi:', {_nl}, coalesce(nullif(risk_label, ''), 'UNKNOWN'), {_nl}, {_nl}, 'Güven:', {_nl}, CAST(confidence AS VARCHAR), '/100', {_nl}, {_nl},
  '{dims.RULE_LINE}', {_nl}, {_nl}, coalesce(nullif(summary, ''), '{dims.SUMMARY_DEFAULT}'), note, {_nl}, {_nl}, '{dims.RULE_LINE}', {_nl}, {_nl},
  {_lines(dims.REPORT_NOTE)}) AS text,
  CASE WHEN halves >= 142 THEN 3 WHEN halves >= 92 THEN 2 WHEN halves >= 42 THEN 1 ELSE 0 END AS severity
FROM block"""
