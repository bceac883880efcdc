import json

from pyspark.sql import functions as F

from docrisk.llm import tool_calls as C
from docrisk.llm.queries import op8_tool_calls

SCHEMA = {
    "f": {
        "required": ["b"], "additionalProperties": False,
        "properties": {
            "b": {"type": "integer", "minimum": 0, "maximum": 5}, "a": {"type": "object"}, "s": {"type": "string", "minLength": 2, "maxLength": 3},
            "e": {"enum": ["x", 1, None]}, "n": {"type": "number"}, "l": {"type": "array"}, "t": {"type": "boolean"},
        },
    },
    "any": {},
}
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"


def linked(spark, calls, results=()):
    return C.link(spark.createDataFrame(list(calls), CALLS), spark.createDataFrame(list(results), RESULTS), SCHEMA)


def test_schema_rules(spark):
    cases = {
        '{"b": 1}': [], '{"b": 5, "s": "ab", "e": "x", "n": 1.5, "l": [], "t": true, "a": {}}': [], '{"b": 0, "e": 1, "n": 3}': [], '{"b": 1, "e": null}': [],
        "{}": ["b: required"], '{"b": 6}': ["b: maximum"], '{"b": -1}': ["b: minimum"], '{"b": 1.5}': ["b: type"], '{"b": "1"}': ["b: type"],
        '{"b": 1, "z": 1, "y": 2}': ["y: not allowed", "z: not allowed"], '{"b": 1, "s": "a"}': ["s: minLength"], '{"b": 1, "s": "éèêë"}': ["s: maxLength"],
        '{"b": 1, "e": "y"}': ["e: enum"], '{"b": 1, "l": {}, "a": [], "t": 0}': ["a: type", "l: type", "t: type"],
        "[1]": ["not a JSON object"], '{"b": 1': ["not a JSON object"], "": ["not a JSON object"], '"x"': ["not a JSON object"],
    }
    got = {r.call_id: r.violations for r in linked(spark, [(1, a, 0, "f", a, []) for a in cases]).collect()}
    assert got == cases
    other = {r.call_id: r.violations for r in linked(spark, [(1, "p", 0, "none", "{}", []), (1, "q", 0, None, "{}", None), (1, "r", 0, "any", '{"x": 1}', None), (1, "s", 0, "f", None, None)]).collect()}
    assert other == {"p": ["unknown tool"], "q": ["unknown tool"], "r": [], "s": ["not a JSON object"]}


def test_canonical_records(spark):
    rows = [(1, "c", 0, "any", '{ "b" : 1, "a": {"z": [1, 2.50, null], "é": "\\u00e9\\n"} }', [])]
    record = linked(spark, rows, [(1, "c", 1, 'say "x"')]).first().record
    assert record == '{"arguments":{"a":{"z":[1,2.5,null],"é":"é\\n"},"b":1},"id":"c","name":"any","result":"say \\"x\\""}'
    assert list(json.loads(record)) == ["arguments", "id", "name", "result"]


def test_links_repeats_and_orphans(spark):
    calls = [(1, "a", 0, "any", "{}", None), (1, "a", 2, "any", '{"x":1}', None), (1, "a", 0, "any", "{}", None), (2, "a", 0, "any", "{}", None), (None, "n", 0, "any", "{}", None), (1, None, 0, "any", "{}", None)]
    results = [(1, "a", 3, "late"), (1, "a", 1, "first"), (1, "o", 1, "orphan"), (None, "n", 1, "x"), (1, None, 1, "y")]
    got = {(r.conv_id, r.call_id, r.n_calls): (r.status, r.n_results, json.loads(r.record).get("result")) for r in linked(spark, calls, results).collect()}
    assert got == {
        (1, "a", 3): ("answered", 2, "first"), (2, "a", 1): ("unanswered", 0, None), (1, "o", 0): ("orphan", 1, "orphan"),
        (None, "n", 1): ("answered", 1, "x"), (1, None, 1): ("unidentified", 0, None), (1, None, 0): ("unidentified", 1, "y"),
    }


def test_topological_order(spark):
    after = {"a": ["b"], "b": ["c"], "c": ["d"], "d": [], "e": ["a"], "f": ["zz", "d"], "g": ["h"], "h": ["g"], "i": ["h", "d"], "j": [], "k": ["k"]}
    turn = {"a": 0, "b": 0, "c": 1, "d": 5, "e": 9, "f": 9, "g": 2, "h": 2, "i": 3, "j": 4, "k": 6}
    rows = [(7, x, turn[x], "any", "{}", after[x]) for x in after] + [(8, "b", 0, "any", "{}", ["a"])]
    got = {r.call_id: r for r in linked(spark, rows).where("conv_id = 7").collect()}
    place = {x: (r.order_turn, r.order_step, r.turn, x) for x, r in got.items()}
    cyclic = {"g", "h", "i", "k"}
    assert {x for x, r in got.items() if r.cyclic} == cyclic
    for x, needed in after.items():
        for y in needed:
            if y in after and not {x, y} & cyclic:
                assert place[y] < place[x]
    # what is in order already keeps its turn
    assert all(place[x][:2] == (turn[x], 0) for x in "defj") and {x: r.n_missing for x, r in got.items() if r.n_missing} == {"f": 1}


def test_long_chain_in_order_needs_no_round(spark):
    rows = spark.range(3000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("string").alias("call_id"), F.col("id").alias("turn"), F.lit("any").alias("name"),
        F.lit("{}").alias("arguments"), F.array((F.col("id") - 1).cast("string")).alias("after"),
    )
    got = C.link(rows, spark.createDataFrame([], RESULTS), SCHEMA)
    assert got.where("order_turn = turn and order_step = 0 and not cyclic").count() == 3000


def test_parse_messages(spark):
    call = {"tool_calls": [{"id": "a", "function": {"name": "any", "arguments": "{}"}}, {"id": "b", "function": {"name": "f", "arguments": '{"b":1}'}, "after": ["a"]}]}
    rows = [
        (1, 0, "user", "hi", 1), (1, 1, "assistant", json.dumps(call), 2), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "x"}), 3),
        (1, 3, "assistant", "plain {text", 4), (1, 4, "tool", "broken", 5), (None, None, None, None, None),
    ]
    calls, results = C.parse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name long"))
    got = {r.call_id: r.status for r in C.link(calls, results, SCHEMA).collect()}
    assert got == {"a": "answered", "b": "unanswered"}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.link(*C.parse(empty), SCHEMA).collect() == [] and C.link(*C.turns(empty), C.TURN_TOOLS).collect() == []


def test_query_covers_every_turn(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = op8_tool_calls(spark, sf_dir)
    assert got.agg(F.sum(F.col("n_calls") + F.col("n_results"))).first()[0] == turns.count()
    wrong = got.join(turns.where("role in ('system', 'user')").select("conv_id", "turn", "role", "text").distinct(), ["conv_id", "turn"]).select(
        "record", "text", "role").collect()
    for r in wrong[:300]:
        said = json.loads(r.record)
        assert said["arguments"]["prompt" if r.role == "user" else "instructions"] == r.text
        assert r.record == json.dumps(said, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_plans_hold_no_python(spark, sf_dir):
    calls, results = C.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    plan = C.link(calls, results, C.TURN_TOOLS)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
