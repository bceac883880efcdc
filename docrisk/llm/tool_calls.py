"""Linking tool calls: results to calls by identifier, calls in dependency order, arguments against
schemas, one canonical JSON record for each. DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.llm.scratch import cut

#: Compiled schemas by tool: whether other properties are allowed, and what each property must be.
#: What a rule leaves out is null and breaks nothing.
_RULES = """map<string, struct<open: boolean, rules: array<struct<
    name: string, required: boolean, type: string, enum: array<string>,
    minimum: double, maximum: double, minLength: bigint, maxLength: bigint>>>>"""
#: JSON Schema's type names by the first word of a variant's type.
_TYPES = {
    "string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "boolean": ("BOOLEAN",),
    "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",),
}


def _compiled(schemas: dict[str, dict]) -> Column:
    """The schemas of all tools as one constant map."""
    tools = {}
    for tool, schema in schemas.items():
        required = set(schema.get("required", ()))
        properties = schema.get("properties", {})
        rules = [
            {k: v for k, v in properties.get(name, {}).items() if k in ("type", "minimum", "maximum", "minLength", "maxLength")}
            | {"name": name, "required": name in required}
            | ({"enum": [json.dumps(x) for x in properties[name]["enum"]]} if "enum" in properties.get(name, {}) else {})
            for name in sorted({*properties, *required})
        ]
        tools[tool] = {"open": schema.get("additionalProperties", True) is not False, "rules": rules}
    return F.from_json(F.lit(json.dumps(tools)), _RULES)


def _violations(arguments: Column, tool: Column) -> Column:
    """Names of rules that an arguments map breaks, as ``property: rule``, sorted."""
    kinds = F.from_json(F.lit(json.dumps({k: list(v) for k, v in _TYPES.items()})), "map<string, array<string>>")

    def broken(rule: Column) -> Column:
        value = arguments[rule["name"]]
        there = F.map_contains_key(arguments, rule["name"])
        kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
        number = F.try_variant_get(value, "$", "double")
        text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
        tests = {
            "required": rule["required"] & ~there,
            "type": there & ~F.array_contains(kinds[rule["type"]], kind),
            "enum": there & ~F.array_contains(rule["enum"], F.to_json(value)),
            "minimum": is_number & (number < rule["minimum"]),
            "maximum": is_number & (number > rule["maximum"]),
            "minLength": F.length(text) < rule["minLength"],
            "maxLength": F.length(text) > rule["maxLength"],
        }
        return F.filter(F.array(*[F.when(test, F.concat(rule["name"], F.lit(f": {name}"))) for name, test in tests.items()]), lambda x: x.isNotNull())

    extra = F.when(
        ~tool["open"],
        F.transform(F.array_except(F.map_keys(arguments), F.transform(tool["rules"], lambda r: r["name"])), lambda k: F.concat(k, F.lit(": not allowed"))),
    )
    return F.array_sort(F.concat(F.flatten(F.transform(tool["rules"], broken)), F.coalesce(extra, F.array().cast("array<string>"))))


def order(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id``, ``order_turn``, ``order_step``, ``n_missing`` and ``cyclic`` of calls
    (one row for each ``conv_id`` and ``call_id``, with ``turn`` and ``after``, the ids it needs).

    Sorted by ``order_turn``, ``order_step``, ``turn`` and ``call_id``, every call of a conversation
    follows all it needs. The order of turns stands wherever it does that already, so only calls
    that need a later one are moved, behind the latest call they need in any number of steps, and
    rounds are needed for those alone. Calls in a cycle, or behind one, keep their turn and are
    marked. Ids that no call has are counted as missing.
    """
    one = calls.select("conv_id", "call_id", "turn")
    needs = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("after")).alias("needed"))
    known = one.select(F.col("conv_id").alias("c"), F.col("call_id").alias("needed_id"), F.col("turn").alias("needed_turn"), F.lit(True).alias("found"))
    edges = cut(
        needs.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("needed") == F.col("needed_id")), "left")
        .select("conv_id", "call_id", "turn", "needed", "needed_turn", F.coalesce("found", F.lit(False)).alias("found"))
    )
    missing = edges.where(~F.col("found")).groupBy("conv_id", "call_id").agg(F.count("*").alias("n_missing"))
    links = edges.where("found").drop("found")
    best = lambda k, s: F.max(F.struct(k.alias("k"), s.alias("s"))).alias("o")
    moved = cut(
        links.where(F.coalesce("needed_turn", F.lit(0)) >= F.coalesce("turn", F.lit(0)))
        .groupBy("conv_id", "call_id").agg(best(F.coalesce("needed_turn", F.lit(0)), F.lit(1)))
        .withColumn("cyclic", F.lit(False))
    )
    changed = not moved.isEmpty()
    while changed:
        at_need = moved.select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"), F.col("o").alias("need"), F.col("cyclic").alias("need_cyclic"))
        count = moved.groupBy(F.col("conv_id").alias("mc")).agg(F.count("*").alias("n_moved"))
        mine = moved.select(F.col("conv_id").alias("vc"), F.col("call_id").alias("v"), F.col("o").alias("now"))
        pushed = (
            links.join(at_need, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("needed") == F.col("n")))
            .join(mine, F.col("conv_id").eqNullSafe(F.col("vc")) & F.col("call_id").eqNullSafe(F.col("v")), "left")
            .withColumn("now", F.coalesce("now", F.struct(F.coalesce("turn", F.lit(0)).alias("k"), F.lit(0).alias("s"))))
            .where(F.col("need_cyclic") | (F.col("need") >= F.col("now")))
            .groupBy("conv_id", "call_id")
            .agg(best(F.col("need.k"), F.col("need.s") + 1), F.max("need_cyclic").alias("cyclic"))
        )
        # more steps than calls were moved: a cycle
        renewed = cut(
            moved.unionByName(pushed).groupBy("conv_id", "call_id").agg(F.max("o").alias("o"), F.max("cyclic").alias("cyclic"))
            .join(count, F.col("conv_id").eqNullSafe(F.col("mc")), "left")
            .select("conv_id", "call_id", "o", (F.col("cyclic") | (F.col("o.s") > F.coalesce("n_moved", F.lit(0)) + 1)).alias("cyclic"))
        )
        settled = F.when(F.col("cyclic"), F.lit(None)).otherwise(F.col("o"))
        same = moved.select("conv_id", "call_id", settled.alias("o"), "cyclic")
        changed = not renewed.select("conv_id", "call_id", settled.alias("o"), "cyclic").exceptAll(same).isEmpty()
        moved = renewed
    places = moved.select(
        F.col("conv_id").alias("c"), F.col("call_id").alias("v"), "cyclic",
        F.when(~F.col("cyclic"), F.col("o.k")).alias("k"), F.when(~F.col("cyclic"), F.col("o.s")).alias("s"),
    )
    lacking = missing.select(F.col("conv_id").alias("mc"), F.col("call_id").alias("mv"), "n_missing")
    return (
        one.join(places, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("call_id").eqNullSafe(F.col("v")), "left")
        .join(lacking, F.col("conv_id").eqNullSafe(F.col("mc")) & F.col("call_id").eqNullSafe(F.col("mv")), "left")
        .select(
            "conv_id", "call_id",
            F.coalesce("k", "turn").alias("order_turn"), F.coalesce("s", F.lit(0)).alias("order_step"),
            F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        )
    )


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Every call id of every conversation, linked, ordered, validated and serialised.

    ``calls``: ``conv_id``, ``call_id``, ``turn``, ``name``, ``arguments`` (JSON text) and ``after``
    (ids of calls that it needs). ``results``: ``conv_id``, ``call_id``, ``turn`` and ``content``.
    ``schemas``: a JSON Schema for each tool's arguments (type, required, properties with type, enum,
    minimum, maximum, minLength and maxLength, additionalProperties).

    One row for each ``conv_id`` and ``call_id`` (null is a value of its own, never linked):
    ``turn``, ``name``, ``status`` (answered; unanswered; orphan, a result without its call;
    unidentified, without an id), ``n_calls`` and ``n_results`` (rows with that id; the first by
    turn, then by text, counts, the others are repeats), ``violations`` (sorted; ``unknown tool``,
    ``not a JSON object``, or the rules broken), the columns of ``order``, and ``record``: canonical
    JSON, keys sorted at every level, no white space, with arguments, id, name and result. Arguments
    that are no JSON object are left out of it. Empty tables give an empty result.
    """
    first_call = calls.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "name", "arguments", F.array_sort(F.array_distinct(F.coalesce("after", F.array().cast("array<string>")))).alias("after"))).alias("call"),
        F.count("*").alias("n_calls"),
    )
    first_result = results.groupBy(F.col("conv_id").alias("result_conv"), F.col("call_id").alias("result_id")).agg(
        F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results")
    )
    ordered = order(first_call.where("call_id is not null").select("conv_id", "call_id", "call.turn", "call.after"))
    linked = (
        first_call.join(
            first_result.hint("shuffle_hash"),
            F.col("conv_id").eqNullSafe(F.col("result_conv")) & (F.col("call_id") == F.col("result_id")), "full",
        )
        .select(
            F.when(F.col("n_calls").isNull(), F.col("result_conv")).otherwise(F.col("conv_id")).alias("conv_id"),
            F.coalesce("call_id", "result_id").alias("call_id"),
            "call", "result", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        )
    )
    placed = ordered.select(F.col("conv_id").alias("c"), F.col("call_id").alias("v"), "order_turn", "order_step", "n_missing", "cyclic")
    parsed = F.try_parse_json("call.arguments")
    as_map = F.try_variant_get(F.col("parsed"), "$", "map<string, variant>")
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    tool = _compiled(schemas)[F.col("call.name")]
    violations = (
        F.when(F.col("call").isNull(), F.array().cast("array<string>"))
        .when(F.col("tool").isNull(), F.array(F.lit("unknown tool")))
        .when(~is_object, F.array(F.lit("not a JSON object")))
        .otherwise(_violations(F.col("arguments"), F.col("tool")))
    )
    status = (
        F.when(F.col("call_id").isNull(), "unidentified")
        .when(F.col("n_calls") == 0, "orphan")
        .when(F.col("n_results") == 0, "unanswered")
        .otherwise("answered")
    )
    record = F.to_json(
        F.struct(
            F.when(is_object, F.col("parsed")).alias("arguments"), F.col("call_id").alias("id"), F.col("call.name").alias("name"),
            F.col("result.content").alias("result"),
        )
    )
    return (
        linked.withColumn("parsed", parsed)
        .withColumn("arguments", F.when(is_object, as_map))
        .withColumn("tool", tool)
        .join(placed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("v")), "left")
        .select(
            "conv_id", "call_id", F.coalesce("call.turn", "result.turn").alias("turn"), F.col("call.name").alias("name"),
            status.alias("status"), "n_calls", "n_results", violations.alias("violations"),
            F.coalesce("order_turn", "call.turn", "result.turn").alias("order_turn"), F.coalesce("order_step", F.lit(0)).alias("order_step"),
            F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
            record.alias("record"),
        )
    )


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in chat messages (``conv_id``, ``turn``, ``role``, ``text``).

    An assistant's text ``{"tool_calls": [{"id", "function": {"name", "arguments"}, "after": [...]}]}``
    holds calls; a tool's text ``{"tool_call_id", "content"}`` is a result. Other texts hold neither.
    """
    call = "struct<id: string, function: struct<name: string, arguments: string>, after: array<string>>"
    calls = (
        messages.where("role = 'assistant'")
        .select("conv_id", "turn", F.explode(F.from_json("text", f"struct<tool_calls: array<{call}>>")["tool_calls"]).alias("call"))
        .select("conv_id", F.col("call.id").alias("call_id"), "turn", "call.function.name", "call.function.arguments", "call.after")
    )
    results = (
        messages.where("role = 'tool'")
        .select("conv_id", "turn", F.from_json("text", "struct<tool_call_id: string, content: string>").alias("result"))
        .where("result.tool_call_id is not null or result.content is not null")
        .select("conv_id", F.col("result.tool_call_id").alias("call_id"), "turn", F.col("result.content").alias("content"))
    )
    return calls, results


#: Tools as which the turns of plain conversations are seen.
TURN_TOOLS = {
    "configure": {
        "type": "object", "required": ["instructions"], "additionalProperties": False,
        "properties": {"instructions": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1}},
    },
    "reply": {
        "type": "object", "required": ["prompt"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1}},
    },
}


def turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that plain conversations stand for.

    A system turn is a call of ``configure`` with its text as instructions, a user turn one of
    ``reply`` with its text as the prompt; each needs the call two turns before, if that is a user's.
    Any other turn is the result of the call one turn before it. Ids are ``conversation:turn``.
    """
    id_of = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    is_call = F.coalesce(F.col("role").isin("system", "user"), F.lit(False))
    speaks = is_call & (F.col("role") == "user")
    calls = messages.where(is_call).select(
        "conv_id", id_of(F.col("turn")).alias("call_id"), "turn",
        F.when(speaks, "reply").otherwise("configure").alias("name"),
        F.when(speaks, F.to_json(F.struct(F.col("text").alias("prompt"), words.alias("words"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("instructions"), words.alias("words")))).alias("arguments"),
        F.when(speaks & (F.col("turn") >= 2), F.array(id_of(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = messages.where(~is_call).select("conv_id", id_of(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
