"""Chat formatting with tool calls: link, order, validate, serialise.

Messages are rows (conv_id, turn, role, text). A message of role ``assistant`` whose text is a JSON object with
``tool_calls`` makes calls; one of role ``tool`` whose text is a JSON object with ``tool_call_id`` is a result. Calls
and results meet in a hash join by conversation and identifier. A call whose arguments name the identifier of
another call (``{"$result": id}``) comes after that call's result. Arguments are validated against the tool's
schema. Every message leaves as canonical JSON: sorted keys, no spare blanks, UTF-8.

Every row stays a row of its own, so a conversation of any length never meets in one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allometra.llm.common import cut

# A schema for each tool, by name.
TOOLS: Mapping[str, dict] = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}},
}

_TYPES = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "null": type(None),
}


def canonical(value: object) -> str:
    """Canonical JSON. A ValueError where a number or a character cannot be written, a RecursionError where nesting is too deep."""
    out = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    out.encode("utf-8")  # half of a surrogate pair is no character
    return out


def schema_errors(value: object, schema: Mapping, path: str = "$") -> list[str]:
    """What is wrong with ``value`` by the schema: type, required, properties, additionalProperties, enum, items, minimum, maximum."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []

    def is_a(kind: str) -> bool:
        if kind in ("integer", "number"):
            return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and (kind == "number" or value.is_integer()))
        return isinstance(value, _TYPES.get(kind, object))

    if isinstance(value, dict) and set(value) == {"$result"}:
        return []
    if kinds and not any(is_a(kind) for kind in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    errors = []
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{path}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            errors.append(f"{path}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            errors.append(f"{path}: above maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        errors += [f"{path}.{name}: missing" for name in schema.get("required", []) if name not in value]
        for name in sorted(value):
            if name in known:
                errors += schema_errors(value[name], known[name], f"{path}.{name}")
            elif schema.get("additionalProperties") is False:
                errors.append(f"{path}.{name}: unknown")
    if isinstance(value, list) and "items" in schema:
        errors += [e for i, x in enumerate(value) for e in schema_errors(x, schema["items"], f"{path}[{i}]")]
    return errors


def _needs(value: object) -> set[str]:
    found, open_ = set(), [value]
    while open_:
        value = open_.pop()
        if isinstance(value, dict):
            if set(value) == {"$result"} and isinstance(value["$result"], str):
                found.add(value["$result"])
            else:
                open_ += value.values()
        elif isinstance(value, list):
            open_ += value
    return found


def _object(text: str | None) -> dict:
    if not text or not text.lstrip().startswith("{"):
        return {}
    try:
        value = json.loads(text)
        canonical(value)
    except (ValueError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def parse(role: str | None, text: str | None, tools: Mapping[str, dict]) -> list[tuple]:
    """Parts of a message: (part, kind, call_id, name, needs, errors, content); a message without calls is one part.

    JSON that cannot be written again (nested too deep, half of a surrogate pair, an infinite number) is ordinary text.
    """
    try:
        return _parse(role, text, tools)
    except (ValueError, RecursionError):
        return [(0, "message", None, None, [], [], canonical({"content": text, "role": role}))]


def _parse(role: str | None, text: str | None, tools: Mapping[str, dict]) -> list[tuple]:
    value = _object(text) if role in ("assistant", "tool") else {}
    calls = value.get("tool_calls")
    if role == "assistant" and isinstance(calls, list) and calls:
        out = []
        if value.get("content") is not None:
            out.append((0, "message", None, None, [], [], canonical({"content": value["content"], "role": role})))
        for k, call in enumerate(calls, 1):
            call = call if isinstance(call, dict) else {}
            function = call.get("function") if isinstance(call.get("function"), dict) else call
            name, arguments, errors = function.get("name"), function.get("arguments"), []
            if isinstance(arguments, str):
                try:
                    parsed = json.loads(arguments)
                    canonical({"tool_calls": [{"function": {"arguments": parsed}}]})
                    arguments = parsed
                except (ValueError, RecursionError):
                    errors.append("$: not JSON")
            name = name if isinstance(name, str) else None
            if name not in tools:
                errors.append("unknown tool")
            elif not errors:
                errors += schema_errors(arguments, tools[name])
            call_id = call.get("id") if isinstance(call.get("id"), str) else None
            said = canonical({"role": role, "tool_calls": [{"function": {"arguments": arguments, "name": name}, "id": call_id, "type": "function"}]})
            out.append((k, "call", call_id, name, sorted(_needs(arguments)), errors, said))
        return out
    if role == "tool" and isinstance(value.get("tool_call_id"), str):
        content = value.get("content")
        return [(0, "result", value["tool_call_id"], None, [], [], canonical({"content": content, "role": role, "tool_call_id": value["tool_call_id"]}))]
    return [(0, "message", None, None, [], [], canonical({"content": text, "role": role}))]


def _parts(conversations: DataFrame, tools: Mapping[str, dict]) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    tools = dict(tools)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *p) for i, (role, text) in enumerate(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)) for p in parse(role, text, tools)]
            columns = list(zip(*found, strict=True)) or [()] * 8
            own = batch.take(pa.array(columns[0], pa.int32()))
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(own.column(c) for c in ("conv_id", "turn", "role")), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))],
                ["conv_id", "turn", "role", "part", "kind", "call_id", "name", "needs", "errors", "json"],
            )

    kinds = dict(rows.dtypes)
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, part int, kind string, call_id string, name string, needs array<string>, errors array<string>, json string"
    return rows.mapInArrow(run, schema)


def format_conversations(conversations: DataFrame, tools: Mapping[str, dict] = TOOLS) -> DataFrame:
    """One row for each message without calls, for each call and for each result, with what its place needs.

    Returns conv_id, turn, role, part (of the message), kind (message, call, result), call_id, name, status, errors,
    json, and the order of the rows in their conversation: anchor, level, turn, part. Sorted by these four, each
    result follows its call and each call the results that it needs.

    anchor: the turn of the last message that the row depends on or is; level: the length of the longest chain of
    calls and results that leads to it from there. status: ok; duplicate_call and duplicate_result (all but the first
    by turn and part of an identifier in its conversation; equal first rows count alike); orphan_result (no call); no_result (a call without one);
    unmet_need (it needs a call that does not exist); cycle (calls that need each other; they keep their own turn).
    errors: how the arguments violate the tool's schema.

    Null roles and texts are messages with null content; a text that is not a JSON object of the two shapes, or cannot be
    written as JSON again, is an ordinary message. Repeated rows each give a row. A null conv_id never links. An empty table gives an
    empty result; other columns of the input are ignored.
    """
    parts = cut(_parts(conversations, tools))
    place = F.struct("turn", "part")
    linked = parts.where("call_id IS NOT NULL AND conv_id IS NOT NULL AND kind <> 'message'")
    firsts = linked.groupBy("conv_id", "call_id", "kind").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n"))
    calls = firsts.where("kind = 'call'").select("conv_id", "call_id", F.col("at").alias("call_at"))
    results = firsts.where("kind = 'result'").select("conv_id", "call_id", F.col("at").alias("result_at"))
    ends = cut(calls.join(results, ["conv_id", "call_id"], "full_outer"))

    # A call's level is two more than that of the calls whose results it needs; its anchor is no earlier than theirs.
    needs = linked.where("kind = 'call'").select("conv_id", "call_id", "turn", "part", F.explode("needs").alias("need"))
    needs = needs.join(ends.select("conv_id", "call_id", "call_at"), ["conv_id", "call_id"]).where(F.col("call_at") == place)
    needs = cut(needs.select("conv_id", "call_id", "need").distinct())
    known = ends.where("call_at IS NOT NULL")
    state = cut(known.select("conv_id", "call_id", F.col("call_at.turn").alias("anchor"), F.lit(0).alias("level")))
    met = cut(needs.join(known.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"]))
    unmet = needs.join(met, ["conv_id", "call_id", "need"], "left_anti").select("conv_id", "call_id").distinct().withColumn("unmet", F.lit(True))
    # Calls without open needs are settled round by round; what never settles waits for itself.
    open_calls = met.select("conv_id", "call_id").distinct()
    settled = cut(state.join(open_calls, ["conv_id", "call_id"], "left_anti"))
    cyclic = None
    if not met.isEmpty():
        waiting = cut(open_calls)
        while True:
            resolved = met.join(settled.select("conv_id", F.col("call_id").alias("need"), F.col("anchor").alias("_anchor"), F.col("level").alias("_level")), ["conv_id", "need"])
            blocked = met.join(settled.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti").select("conv_id", "call_id").distinct()
            ready = cut(waiting.join(blocked, ["conv_id", "call_id"], "left_anti"))
            if ready.isEmpty():
                break
            after = resolved.join(ready, ["conv_id", "call_id"]).groupBy("conv_id", "call_id").agg(F.max(F.struct("_anchor", "_level")).alias("_last"))
            new = state.join(after, ["conv_id", "call_id"]).select(
                "conv_id",
                "call_id",
                F.greatest("anchor", "_last._anchor").alias("anchor"),
                F.when(F.col("anchor") > F.col("_last._anchor"), 0).otherwise(F.col("_last._level") + 2).alias("level"),
            )
            settled = cut(settled.union(new))
            waiting = cut(waiting.join(ready, ["conv_id", "call_id"], "left_anti"))
        cyclic = waiting.withColumn("cyclic", F.lit(True))
        settled = settled.union(state.join(waiting, ["conv_id", "call_id"]))
    order = settled.join(unmet, ["conv_id", "call_id"], "left")
    order = order.join(cyclic, ["conv_id", "call_id"], "left") if cyclic is not None else order.withColumn("cyclic", F.lit(None).cast("boolean"))
    facts = ends.join(order, ["conv_id", "call_id"], "left")

    # Rows that cannot link stay out of the join, where their nulls would all meet in one task.
    names = ["conv_id", "turn", "role", "part", "kind", "call_id", "name"]
    links = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull() & (F.col("kind") != "message")
    alone = parts.where(~F.coalesce(links, F.lit(False))).select(
        *names,
        F.when(F.col("kind") == "call", "no_result").when(F.col("kind") == "result", "orphan_result").otherwise("ok").alias("status"),
        "errors",
        F.col("turn").alias("anchor"),
        F.lit(0).alias("level"),
        "json",
    )
    rows = linked.join(facts, ["conv_id", "call_id"])
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    first = F.coalesce(F.when(is_call, F.col("call_at")).otherwise(F.col("result_at")) == place, F.lit(False))
    placed = first & F.col("call_at").isNotNull()
    status = (
        F.when(~first, F.concat(F.lit("duplicate_"), F.col("kind")))
        .when(is_result, F.when(F.col("call_at").isNull(), "orphan_result").otherwise("ok"))
        .when(F.col("cyclic"), "cycle")
        .when(F.col("unmet"), "unmet_need")
        .when(F.col("result_at").isNull(), "no_result")
        .otherwise("ok")
    )
    rows = rows.select(
        *names,
        status.alias("status"),
        "errors",
        F.when(placed, F.col("anchor")).otherwise(F.col("turn")).alias("anchor"),
        F.when(placed, F.col("level") + F.when(is_result, 1).otherwise(0)).otherwise(0).alias("level"),
        "json",
    )
    return rows.unionByName(alone)
