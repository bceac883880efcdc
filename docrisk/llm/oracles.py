"""SQL twins of the queries that SQL can express, written independently of the operators."""

from docrisk.llm.fingerprint import BYTES, IDENTITY, LIKENESS, MASK

#: Lanes of the likeness part in order: for each shift, the bits at distance 8.
_BITS = [8 * f + s for s in range(8) for f in range(BYTES)]


def _lanes(table: str, name: str) -> str:
    """SQL: for each row of ``table`` (``k``, ``t``) its lanes as a list ``name``, written from the definition."""
    named = ", ".join(f"coalesce(sum(('0x' || substr(sha256(p), {8 * i + 1}, 8))::BIGINT), 0)::BIGINT" for i in range(IDENTITY))
    liked = ", ".join(f"coalesce(sum((h >> {b}) & 1), 0)::BIGINT" for b in _BITS)
    return f"""
{name}_p AS (
  SELECT k, p, row_number() OVER () AS i FROM (
    SELECT k, unnest(list_transform(string_split(t, chr(10)), lambda p : trim(p, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS p FROM {table}) WHERE p <> ''),
{name}_w AS (SELECT k, string_split_regex(p, '[\\x20\\x09-\\x0D]+') AS w FROM {name}_p),
{name}_h AS (
  SELECT k, ('0x' || substr(md5(pair), 1, {2 * BYTES}))::BIGINT AS h FROM (
    SELECT k, unnest(list_transform(w, lambda x, i : CASE WHEN i < len(w) THEN x || ' ' || w[i + 1] ELSE x END)) AS pair FROM {name}_w)),
{name}_i AS (SELECT k, [{named}] AS v FROM {name}_p GROUP BY k),
{name}_l AS (SELECT k, [count(*), {liked}] AS v FROM {name}_h GROUP BY k),
{name} AS (
  SELECT t.k, list_transform(
      list_concat(coalesce(i.v, [0 for _ in range({IDENTITY})]), coalesce(l.v, [0 for _ in range({LIKENESS + 1})])), lambda x : x % {MASK + 1}) AS v
  FROM {table} t LEFT JOIN {name}_i i USING (k) LEFT JOIN {name}_l l USING (k))"""


def _near(a: str, b: str) -> str:
    """SQL: likeness of two lists of lanes."""
    n, end = IDENTITY + 1, IDENTITY + 1 + LIKENESS
    signed = lambda v: f"list_transform({v}[{n + 1}:{end}], lambda x : (2 * x - {v}[{n}])::DOUBLE)"
    x, y = signed(a), signed(b)
    dot = lambda p, q: f"list_inner_product({p}, {q})"
    length = f"sqrt({dot(x, x)} * {dot(y, y)})"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {length} > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {dot(x, y)} / {length})) ELSE 0.0::DOUBLE END"


_SHOWN = "array_to_string(list_transform({v}, lambda x : printf('%08x', x)), '')"

ORACLES = {
    "op11_fingerprint": rf"""
WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS t FROM documents),
n AS (
  SELECT k, t, len(t) AS n, coalesce(lead(t) OVER (ORDER BY k), first(t) OVER (ORDER BY k)) AS x,
    coalesce(lead(k) OVER (ORDER BY k), first(k) OVER (ORDER BY k)) AS follower FROM d),
e AS (SELECT k, n, follower, left(t, n - n // 4) || left(x, n // 4) AS t FROM n),
{_lanes("d", "a")},
{_lanes("e", "b")}
SELECT e.k AS doc_id, e.n AS n_chars, sha256(e.t) AS edited_sha256, {_SHOWN.format(v="a.v")} AS fingerprint, {_SHOWN.format(v="b.v")} AS edited_fingerprint,
  {_near("a.v", "b.v")} AS near_edited, {_near("a.v", "c.v")} AS near_next
FROM e JOIN a ON a.k = e.k JOIN b ON b.k = e.k JOIN a AS c ON c.k = e.follower""",
    "op12_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
    ('0x' || h[17:24])::BIGINT % 100 AS r, ('0x' || h[25:32])::BIGINT % 100 AS s FROM d),
f AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r >= 50 THEN 'plain' WHEN s < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS z FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f""",
    "op13_filter_audit": r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
d AS (
  SELECT part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
    100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM w LEFT JOIN labels USING (doc_id)),
m AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END,
    CASE WHEN e THEN 'E' ELSE '' END) AS failed, count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic FROM d GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, k AS step, filter_order[k] AS f, left(filter_order, k - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS k)),
s AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(failed, f) AS hit, failed = f AS alone,
    before <> '' AND regexp_matches(failed, '[' || before || '_]') AS gone FROM steps, m),
r AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r""",
    "op8_tool_calls": r"""
WITH t AS (
  SELECT conv_id, turn, text, coalesce(role IN ('system', 'user'), false) AS is_call, role = 'user' AS speaks,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM conversations),
calls AS (
  SELECT conv_id, concat(conv_id, ':', turn) AS call_id, turn, CASE WHEN speaks THEN 'reply' ELSE 'configure' END AS name,
    concat('{"', CASE WHEN speaks THEN 'prompt' ELSE 'instructions' END, '":', CAST(to_json(text) AS VARCHAR), ',"words":', words, '}') AS arguments,
    words, len(text) AS size, speaks AND turn >= 2 AS needs
  FROM t WHERE is_call),
firsts AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id, call_id) AS n_calls,
    row_number() OVER (PARTITION BY conv_id, call_id ORDER BY name, arguments) AS r FROM calls),
call AS (SELECT * FROM firsts WHERE r = 1),
answers AS (SELECT conv_id, concat(conv_id, ':', turn - 1) AS call_id, turn, text FROM t WHERE NOT is_call),
answer AS (
  SELECT conv_id, call_id, min(turn) AS answered, min(text) AS content, count(*) AS n_results FROM answers GROUP BY conv_id, call_id)
SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, coalesce(c.turn, answered) AS turn, c.name,
  CASE WHEN c.conv_id IS NULL THEN 'orphan' WHEN a.conv_id IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
  coalesce(c.n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
  CASE WHEN c.size = 0 THEN CASE c.name WHEN 'reply' THEN 'prompt: minLength; words: minimum' ELSE 'instructions: minLength; words: minimum' END
    WHEN c.words = 0 THEN 'words: minimum' ELSE '' END AS violations,
  coalesce(c.turn, answered) AS order_turn, CAST(0 AS INTEGER) AS order_step,
  CAST(CASE WHEN c.needs AND b.conv_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_missing, false AS cyclic,
  concat('{', CASE WHEN c.conv_id IS NULL THEN '' ELSE concat('"arguments":', c.arguments, ',') END, '"id":"', coalesce(c.call_id, a.call_id), '"',
    CASE WHEN c.conv_id IS NULL THEN '' ELSE concat(',"name":"', c.name, '"') END,
    CASE WHEN a.conv_id IS NULL THEN '' ELSE concat(',"result":', CAST(to_json(content) AS VARCHAR)) END, '}') AS record
FROM call c FULL JOIN answer a ON a.conv_id = c.conv_id AND a.call_id = c.call_id
LEFT JOIN call b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2""",
    "op9_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS x FROM starts),
again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + d AS p FROM again, (SELECT unnest(range(20)) AS d)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.p) AS text, count(*) AS n
  FROM words t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.p = t.p WHERE g.p IS NULL GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
}
