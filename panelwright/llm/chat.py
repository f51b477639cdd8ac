"""Chat formatting: tool calls linked to their results, checked and written as canonical JSON.

Calls and results meet in a hash join on (conversation, identifier).  Calls are ordered by level, the
longest way over the calls they wait for: chains of calls that wait for one other each are shortened by
pointer doubling, so rounds grow with the logarithm of their length, and calls that wait for several are
settled in rounds over these alone; what a cycle holds back is marked and has no level.  Arguments are
checked against a schema for each tool.  Of several results for one call the first by turn counts and
the rest are marked; of several calls with one identifier likewise.  Nulls: a call without conversation
or identifier is kept and marked `unlinked`.  Every turn has a row: calls, results, and the turns that are
neither (system turns, those without a role, tool turns without an identifier, turns that hold inline
calls), which have a status of their own.  No group is gathered; an order is given by level and turn.  Canonical JSON has sorted keys, no spaces and plain characters; half a
surrogate pair, which UTF-8 can't hold, is escaped.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, per_piece, written

CALL = "conv_id long, turn long, call_id string, name string, arguments string, waits_for array<string>"
RESULT = "conv_id long, turn long, call_id string, content string"
OTHER = "conv_id long, turn long, role string, status string, content string"


#: The kinds of JSON Schema and Python's.
KINDS = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _is(value, kind: str) -> bool:
    """Whether a value is of a kind; a kind that is not known permits everything, and a truth value is no number."""
    return kind not in KINDS or isinstance(value, KINDS[kind]) and not (isinstance(value, bool) and kind in ("number", "integer"))


def valid(arguments: str | None, schema: dict | None) -> tuple[str | None, str]:
    """(canonical JSON, what is wrong) of a call's arguments; both sides follow a small part of JSON Schema."""
    try:
        value = json.loads(arguments) if arguments is not None else None
        text = canonical(value)
    except (ValueError, RecursionError):
        return None, "not JSON"
    if schema is None:
        return text, "unknown tool"
    if not isinstance(value, dict):
        return text, "not an object"
    for key in schema.get("required", []):
        if key not in value:
            return text, f"missing {key}"
    for key, v in value.items():
        rule = schema.get("properties", {}).get(key)
        if rule is None:
            if not schema.get("additionalProperties", True):
                return text, f"unknown {key}"
            continue
        kinds = rule.get("type") or []
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if kinds and not any(_is(v, k) for k in kinds):
            return text, f"{key} is not {' or '.join(kinds)}"
        if "enum" in rule and v not in rule["enum"]:
            return text, f"{key} is not permitted"
        if isinstance(v, str) and len(v) < rule.get("minLength", 0):
            return text, f"{key} is too short"
    return text, ""


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, cyclic) of the calls that wait for another or are waited for; level is null where a cycle holds a call."""
    key = ["conv_id", "call_id"]
    first = calls.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min("turn").alias("turn"), F.min_by("waits_for", "turn").alias("waits_for"))
    edges = first.select(*key, F.explode("waits_for").alias("on")).join(first.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"]).select(*key, "on").distinct()
    edges = written(edges, "waits")
    degree = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("on").alias("on"))
    # A chain's links point to the call waited for; each round doubles how far they reach, until they point to a call of no or several ones.
    chain = written(degree.where("n = 1").select(*key, F.col("on").alias("to"), F.lit(1).cast("long").alias("far")), "chain")
    open_links, before = chain.count(), -1
    while open_links and open_links != before:
        next_ = chain.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"))
        far = chain.join(next_, ["conv_id", "to"], "left").select(*key, F.coalesce("to2", "to").alias("to"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("to2").isNotNull().alias("open"))
        last, chain = chain, written(far, "chain")
        drop(last)
        before, open_links = open_links, chain.where("open").count()
    ends = chain.select("conv_id", F.col("call_id").alias("on"), F.col("to").alias("end"), "far")
    many = degree.where("n > 1").select(*key)
    known = written(edges.select("conv_id", F.col("on").alias("call_id")).distinct().join(edges, key, "left_anti").select(*key, F.lit(0).cast("long").alias("level")), "levels")
    reach = edges.join(many, key, "left_semi").join(ends, ["conv_id", "on"], "left").select(*key, F.coalesce("end", "on").alias("end"), F.coalesce("far", F.lit(0)).alias("far"))
    reach = written(reach, "reach")
    waiting = reach.select(*key).distinct()
    while not reach.isEmpty():
        # A call of several is settled once all ends of its chains are.
        got = reach.join(known.select("conv_id", F.col("call_id").alias("end"), "level"), ["conv_id", "end"], "left")
        ready = got.groupBy(*key).agg(F.count("*").alias("n"), F.count("level").alias("has"), (F.max(F.col("level") + F.col("far")) + 1).alias("level")).where("n = has").select(*key, "level")
        ready = written(ready.join(known, key, "left_anti"), "levels")
        if ready.isEmpty():
            break
        known = known.union(ready)
        reach = reach.join(ready, key, "left_anti")
    told = chain.join(known.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"], "left").select(*key, (F.col("level") + F.col("far")).alias("level"))
    every = known.union(told).union(waiting.join(known, key, "left_anti").select(*key, F.lit(None).cast("long").alias("level")))
    return every.select(*key, F.col("level").cast("int").alias("level"), F.col("level").isNull().alias("cyclic"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], others: DataFrame | None = None) -> DataFrame:
    """A row for each call, each result and each other turn: conv_id, level, turn, call_id, status, problem, json.

    A call's row holds its first result too.  That result's own row has the status `result`, a later one's
    `repeated result`; of equal results one is the first.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "waits_for")
    results = results.select("conv_id", "turn", "call_id", "content")
    key = ["conv_id", "call_id"]
    answer = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    owner = calls.where(named).groupBy(*key).agg(F.min("turn").alias("first_turn"))
    linked = calls.join(owner, key, "left").join(answer, key, "left").join(levels(calls), key, "left")
    status = F.when(~named, "unlinked").when(F.col("turn") > F.col("first_turn"), "repeated call").when(F.col("cyclic"), "cyclic").when(F.col("r").isNull(), "unanswered").when(F.col("r.turn") < F.col("turn"), "answered early").when(F.col("n_results") > 1, "answered again").otherwise("linked")
    null = lambda c: F.lit(None).cast("string").alias(c)
    rows = linked.select("conv_id", F.when(~F.coalesce("cyclic", F.lit(False)), F.coalesce("level", F.lit(0))).alias("level"), "turn", "call_id", status.alias("status"), F.lit("call").alias("kind"), null("role"), "name", "arguments", F.col("r.content").alias("content"))
    copies = results.groupBy("conv_id", "turn", "call_id", "content").count().withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    first = (F.col("nth") == 1) & F.col("turn").eqNullSafe(F.col("r.turn")) & F.col("content").eqNullSafe(F.col("r.content"))
    rank = F.when(F.col("owned").isNull(), "orphan result").when(first, "result").otherwise("repeated result")
    told = copies.join(owner.select(*key, F.lit(True).alias("owned")), key, "left").join(answer, key, "left").select("conv_id", F.lit(0).alias("level"), "turn", "call_id", rank.alias("status"), F.lit("result").alias("kind"), null("role"), null("name"), null("arguments"), "content")
    rows = rows.unionByName(told)
    if others is not None:
        rows = rows.unionByName(others.select("conv_id", F.lit(0).alias("level"), "turn", null("call_id"), "status", F.lit("turn").alias("kind"), "role", null("name"), null("arguments"), "content"))

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        problems, lines = [], []
        for r in piece.to_pylist():
            args, wrong = valid(r["arguments"], schemas.get(r["name"])) if r["kind"] == "call" else (None, "")
            entry = {"status": r["status"], "turn": r["turn"]} | ({"role": r["role"], "text": r["content"]} if r["kind"] == "turn" else {"id": r["call_id"], "result": r["content"]})
            if r["kind"] == "call":
                entry |= {"arguments": json.loads(args) if args is not None else r["arguments"], "name": r["name"]}
            problems.append(wrong)
            lines.append(canonical(entry))
        keep = ["conv_id", "level", "turn", "call_id", "status"]
        return pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(problems, pa.string()), pa.array(lines, pa.string())], [*keep, "problem", "json"])

    return per_piece(rows, work, "conv_id long, level int, turn long, call_id string, status string, problem string, json string", "content")


def _read(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `m`, what the text holds of inline calls or a result."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    made = F.from_json(F.when(F.contains("text", F.lit("tool_call")), F.col("text")), "tool_calls array<struct<id:string,name:string,arguments:string,waits_for:array<string>>>, tool_call_id string, content string")
    return t.withColumn("m", made)


def other_turns(turns: DataFrame) -> DataFrame:
    """The turns of a conversation table that from_turns() takes neither as a call nor as a result.

    A turn that holds inline calls is one, with its whole text; its calls have rows of their own.
    """
    role = F.col("role")
    status = F.when(F.col("m.tool_calls").isNotNull(), "turn with calls").when(role.isNull(), "no role").when(role == "system", "system turn").when(role == "tool", "tool turn without id").otherwise("other role")
    plain = F.coalesce(role.isin("user", "assistant"), F.lit(False)) & F.col("m.tool_calls").isNull()
    return _read(turns).where(F.col("m.tool_call_id").isNull() & ~plain).select("conv_id", "turn", "role", status.alias("status"), F.col("text").alias("content"))


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a conversation table (conv_id, turn, role, text).

    An assistant's text that is a JSON object with `tool_calls`, and a tool's with `tool_call_id`, are
    read as such.  Otherwise a user's turn is a call of the tool `reply` with its text as argument, waiting
    for the user's turn two before, and an assistant's turn answers the turn before it.
    """
    t = _read(turns)
    ident = lambda n: F.concat_ws("-", F.lit("t"), F.col("conv_id"), n)
    said = t.where((F.col("role") == "user") & F.col("m.tool_calls").isNull() & F.col("m.tool_call_id").isNull()).select("conv_id", "turn", F.when(F.col("turn").isNotNull() & F.col("conv_id").isNotNull(), ident(F.col("turn"))).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("text")).alias("arguments"), F.array(ident(F.col("turn") - 2)).alias("waits_for"))
    inline = t.where(F.col("m.tool_calls").isNotNull()).select("conv_id", "turn", F.explode("m.tool_calls").alias("c")).select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.waits_for", F.array().cast("array<string>")).alias("waits_for"))
    replies = t.where((F.col("role") == "assistant") & F.col("m.tool_calls").isNull() & F.col("m.tool_call_id").isNull()).select("conv_id", "turn", F.when(F.col("turn").isNotNull() & F.col("conv_id").isNotNull(), ident(F.col("turn") - 1)).alias("call_id"), F.col("text").alias("content"))
    tool = t.where(F.col("m.tool_call_id").isNotNull()).select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), F.coalesce("m.content", "text").alias("content"))
    return said.unionByName(inline), replies.unionByName(tool)


#: The schema that turns without own calls are checked against.
REPLY = {"reply": {"required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False}}
