"""Tool-call linking for chat data, in DataFrame functions only.

Calls and results are joined by identifier, put into topological order along their
dependencies, checked against the schema of their tool, and written as canonical JSON (keys
sorted, no white space, only the escapes that JSON requires).

Order: every call may depend on one earlier call (the one whose result it builds on). Depths are
found by pointer doubling, so a chain of n calls takes log2(n) joins on unique keys, however many
calls a single conversation holds; no conversation is ever gathered into one task.

Defined cases: a call without a result is kept with status "unanswered"; a result without a call
is "orphan"; further results of a call are "repeated" (the one of the smallest turn, then the
smallest content, answers); of calls with equal identifiers the first by turn, then by arguments,
stands, the others are "duplicate". Null identifiers link to nothing ("unidentified"). A call whose
dependency is missing is a root; calls on a cycle get the position null and status "cyclic". Null
arguments count as an empty object, a null value is the JSON null. No argument is left out:
those that the schema doesn't know, and all of an unknown tool, are written as strings. Numbers are
spelled one way each (see `number`). Empty tables give an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


@dataclass(frozen=True)
class Argument:
    """One argument of a tool: its JSON type, whether it must be there, and bounds of its value or length."""

    name: str
    kind: str = "string"  # string, integer, number or boolean
    required: bool = True
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] = ()


SCHEMAS = dict[str, tuple[Argument, ...]]
_NUMBER = {"integer": r"^-?(0|[1-9][0-9]*)$", "number": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "boolean": "^(true|false)$"}


def quoted(text: Column) -> Column:
    """A JSON string: quotation marks, backslashes and control characters escaped, nothing else."""
    out = F.regexp_replace(text, r'(["\\])', r"\\$1")
    for code, escape in ((8, "b"), (9, "t"), (10, "n"), (12, "f"), (13, "r")):
        out = F.replace(out, F.lit(chr(code)), F.lit("\\" + escape))
    rest = [c for c in range(32) if c not in (8, 9, 10, 12, 13)]
    escaped = out
    for code in rest:
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(F.rlike(out, F.lit(r"[\x00-\x1F]")), escaped).otherwise(out), F.lit('"'))


def number(text: Column) -> Column:
    """One spelling for each value of a JSON number in double precision; null where it is beyond that.

    The digits with which Java spells the double; without exponent from 1e-6 up to 1e21, else as d.ddde+XX;
    no sign before a zero.
    """
    value = text.cast("double")
    size = F.abs(value)
    plain = F.when(size < 1, value.cast("decimal(38,24)").cast("string")).otherwise(value.cast("decimal(38,16)").cast("string"))
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(value.cast("string"), r"\.0E", "E"), "E-", "e-"), "E", "e+")
    return F.when(size == 0, F.lit("0")).when((size >= 1e-6) & (size < 1e21), plain).when(size < float("inf"), power)


def canonical_object(fields: dict[str, Column]) -> Column:
    """An object of JSON values, keys in code-point order; null values are left out."""
    parts = [F.when(fields[k].isNotNull(), F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical_arguments(arguments: Column, schema: tuple[Argument, ...]) -> Column:
    """All arguments (a map of strings) as a canonical object, keys in code-point order.

    An argument that the schema gives a kind is written as such if its value fits, everything else as a string.
    """
    of_kind = {kind: [a.name for a in schema if a.kind == kind] for kind in _NUMBER}

    def entry(e: Column) -> Column:
        key, value = e["key"], e["value"]
        spelled = F.when(value.isNull(), F.lit("null"))
        for kind, names in of_kind.items():
            if names:
                plain = {"integer": F.when(value == "-0", F.lit("0")).otherwise(value), "number": F.coalesce(number(value), quoted(value)), "boolean": value}[kind]
                spelled = spelled.when(key.isin(*names) & F.rlike(value, F.lit(_NUMBER[kind])), plain)
        return F.concat(quoted(key), F.lit(":"), spelled.otherwise(quoted(value)))

    # strings are ordered by their UTF-8 bytes, which is the order of code points
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(arguments)), entry), ","), F.lit("}"))


def violations(arguments: Column, schema: tuple[Argument, ...]) -> Column:
    """Array of what is wrong with the arguments, in the schema's order, unknown names last."""
    found: list[Column] = []
    for a in schema:
        value = F.element_at(arguments, a.name)
        there = value.isNotNull()
        if a.required:
            found.append(F.when(~there, F.lit(f"{a.name}: missing")))
        size = F.length(value).cast("double") if a.kind == "string" else F.lit(None).cast("double")
        if a.kind != "string":
            fits = F.rlike(value, F.lit(_NUMBER[a.kind]))
            found.append(F.when(there & ~fits, F.lit(f"{a.name}: not {a.kind}")))
            if a.kind != "boolean":
                size = F.when(fits, value.try_cast("double"))
        if a.choices:
            found.append(F.when(there & ~value.isin(*a.choices), F.lit(f"{a.name}: not among the choices")))
        if a.least is not None:
            found.append(F.when(there & (size < a.least), F.lit(f"{a.name}: too small")))
        if a.most is not None:
            found.append(F.when(there & (size > a.most), F.lit(f"{a.name}: too large")))
    names = F.array(*[F.lit(a.name) for a in schema]) if schema else F.array().cast("array<string>")
    unknown = F.transform(F.array_sort(F.array_except(F.map_keys(arguments), names)), lambda n: F.concat(n, F.lit(": unknown")))
    return F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>"), unknown)


def by_tool(name: Column, schemas: SCHEMAS, of, otherwise: Column) -> Column:
    """of(schema) for the schema that name names."""
    out = F.when(F.lit(False), otherwise)
    for tool, schema in schemas.items():
        out = out.when(name == tool, of(schema))
    return out.otherwise(otherwise)


def positions(calls: DataFrame) -> DataFrame:
    """id, depth of calls (id, parent): a root has depth 0, on or behind a cycle it is null. ids are unique and not null.

    In each round a pointer jumps to its target's target. After as many rounds as the number of
    calls has binary digits, only cycles are left. Each round is a table in the shared folder.
    """
    known = calls.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    start = calls.join(known, "parent", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    now = materialise(start.select("id", F.when(F.col("there"), F.col("parent")).alias("to"), F.col("there").cast("long").alias("depth")), "positions")
    total, going = now.agg(F.count(F.lit(1)), F.count("to")).first()
    for _ in range(total.bit_length() + 1):
        if not going:
            break
        target = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        step = now.where("to is not null").join(target, "to").select("id", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"))
        now = materialise(step.unionByName(now.where("to is null")), "positions")
        going = now.agg(F.count("to")).first()[0]
    return now.select("id", F.when(F.col("to").isNull(), F.col("depth")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: SCHEMAS) -> DataFrame:
    """Links calls (call_id, turn, name, arguments map<string,string>, depends_on) and results (call_id, turn, content).

    One row for each distinct call and for each distinct result that answers none: call_id, turn,
    name, status, position (depth along the dependencies), violations, json.
    """
    none = F.lit(None)
    calls = calls.select(F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"), F.col("name").cast("string").alias("name"), F.coalesce("arguments", F.create_map().cast("map<string,string>")).alias("arguments"), F.col("depends_on").cast("string").alias("depends_on"))
    plain = F.array_sort(F.map_entries("arguments"))
    calls = calls.withColumn("entries", plain).drop("arguments").distinct().withColumn("arguments", F.map_from_entries("entries"))
    order = F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("name", F.lit("")).alias("name"), "entries", F.coalesce("depends_on", F.lit("")).alias("depends_on"))
    first = calls.where("call_id is not null").groupBy("call_id").agg(F.min(order).alias("first"))
    calls = materialise(calls.withColumn("order", order).join(first, "call_id", "left").withColumn("stands", F.coalesce(F.col("order") == F.col("first"), F.lit(False))).select("call_id", "turn", "name", "arguments", "depends_on", "stands"), "calls")
    results = results.select(F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content")).distinct()
    answer = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), "content")).alias("answer"))
    depth = positions(calls.where("stands").select(F.col("call_id").alias("id"), F.col("depends_on").alias("parent"))).withColumnRenamed("id", "call_id")
    standing = calls.where("stands").join(depth, "call_id", "left").join(answer, "call_id", "left")
    others = calls.where("not stands").withColumn("depth", none.cast("long")).withColumn("answer", none.cast(answer.schema["answer"].dataType))
    status = F.when(F.col("call_id").isNull(), "unidentified").when(~F.col("stands"), "duplicate").when(F.col("depth").isNull(), "cyclic").when(F.col("answer").isNull(), "unanswered").otherwise("answered")
    linked = standing.unionByName(others).withColumn("status", status)
    wrong = by_tool(F.col("name"), schemas, lambda s: violations(F.col("arguments"), s), F.array(F.lit("name: unknown tool")))
    args = by_tool(F.col("name"), schemas, lambda s: canonical_arguments(F.col("arguments"), s), canonical_arguments(F.col("arguments"), ()))
    linked = linked.withColumn("violations", wrong)
    linked = linked.select("call_id", "turn", "name", "status", F.col("depth").alias("position"), "violations", canonical_object({"arguments": args, "id": quoted(F.col("call_id")), "name": quoted(F.col("name")), "position": F.col("depth").cast("string"), "result": quoted(F.col("answer.content")), "status": quoted(F.col("status"))}).alias("json"))
    ids = calls.where("stands").select("call_id", F.lit(True).alias("called"))
    spare = results.join(ids, "call_id", "left").join(answer, "call_id", "left")
    spare = spare.where("called is null or answer.turn <> coalesce(turn, -1) or answer.content <> content")
    kind = F.when(F.col("call_id").isNull(), "unidentified").when(F.col("called").isNull(), "orphan").otherwise("repeated")
    spare = spare.withColumn("status", kind).select("call_id", "turn", none.cast("string").alias("name"), "status", none.cast("long").alias("position"), F.array().cast("array<string>").alias("violations"), canonical_object({"id": quoted(F.col("call_id")), "result": quoted(F.col("content")), "status": quoted(F.col("status"))}).alias("json"))
    return linked.unionByName(spare)


#: Turns of plain conversations seen as calls: a user asks for a reply, a system message sets one up.
TURNS: SCHEMAS = {
    "reply": (Argument("prompt", least=1), Argument("turn", "integer", least=0)),
    "configure": (Argument("instruction", least=1, most=4000), Argument("turn", "integer", least=0)),
}


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns (conv_id, turn, role, text).

    A user's turn is a call that builds on the exchange before it, two turns up; the assistant's
    next turn is its result. A system turn is a call of its own. Other roles take no part.
    """
    rows = conversations.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    name = lambda back: F.when(F.col("conv").isNotNull() & F.col("turn").isNotNull(), F.concat_ws(":", "conv", (F.col("turn") - back).cast("string")))
    turn = F.coalesce(F.col("turn").cast("string"), F.lit(""))
    user = F.col("role") == "user"
    arguments = F.when(user, F.create_map(F.lit("prompt"), F.col("text"), F.lit("turn"), turn)).otherwise(F.create_map(F.lit("instruction"), F.col("text"), F.lit("turn"), turn))
    calls = rows.where("role in ('user', 'system')").select(name(0).alias("call_id"), "turn", F.when(user, "reply").otherwise("configure").alias("name"), arguments.alias("arguments"), F.when(user, name(2)).alias("depends_on"))
    results = rows.where("role = 'assistant'").select(name(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def link_turns(conversations: DataFrame) -> DataFrame:
    return link(*from_turns(conversations), TURNS)


def oracle() -> str:
    """link_turns in DuckDB SQL, with a recursive walk for the positions."""
    return """
WITH RECURSIVE rows AS (
  SELECT conv_id::VARCHAR AS conv, turn, role, coalesce(text, '') AS text FROM conversations),
calls AS (
  SELECT DISTINCT conv || ':' || turn AS call_id, turn, CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name, text,
    CASE WHEN role = 'user' THEN conv || ':' || (turn - 2) END AS depends_on
  FROM rows WHERE role IN ('user', 'system')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY name, text) AS nth FROM calls),
standing AS (SELECT * FROM ranked WHERE nth = 1),
results AS (SELECT DISTINCT conv || ':' || (turn - 1) AS call_id, turn, text AS content FROM rows WHERE role = 'assistant'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY turn, content) AS nth FROM results),
walk AS (
  SELECT call_id, 0::BIGINT AS position FROM standing s WHERE depends_on IS NULL OR NOT EXISTS (SELECT 1 FROM standing p WHERE p.call_id = s.depends_on)
  UNION ALL
  SELECT s.call_id, w.position + 1 FROM walk w JOIN standing s ON s.depends_on = w.call_id),
linked AS (
  SELECT r.call_id, r.turn, r.name, r.text, CASE WHEN r.nth > 1 THEN 'duplicate' WHEN n.call_id IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
    CASE WHEN r.nth = 1 THEN w.position END AS position, CASE WHEN r.nth = 1 THEN n.content END AS content
  FROM ranked r LEFT JOIN walk w ON w.call_id = r.call_id LEFT JOIN numbered n ON n.call_id = r.call_id AND n.nth = 1)
SELECT call_id, turn, name, status, position,
  CASE WHEN length(text) < 1 THEN CASE WHEN name = 'reply' THEN 'prompt: too small' ELSE 'instruction: too small' END
       WHEN name = 'configure' AND length(text) > 4000 THEN 'instruction: too large' ELSE '' END AS violations,
  '{"arguments":{"' || CASE WHEN name = 'reply' THEN 'prompt' ELSE 'instruction' END || '":' || to_json(text)::VARCHAR || ',"turn":' || turn || '},"id":' || to_json(call_id)::VARCHAR
    || ',"name":"' || name || '"' || coalesce(',"position":' || position, '') || coalesce(',"result":' || to_json(content)::VARCHAR, '') || ',"status":"' || status || '"}' AS json
FROM linked
UNION ALL
SELECT n.call_id, n.turn, NULL, CASE WHEN s.call_id IS NULL THEN 'orphan' ELSE 'repeated' END, NULL, '',
  '{"id":' || to_json(n.call_id)::VARCHAR || ',"result":' || to_json(n.content)::VARCHAR || ',"status":"' || CASE WHEN s.call_id IS NULL THEN 'orphan' ELSE 'repeated' END || '"}'
FROM numbered n LEFT JOIN standing s ON s.call_id = n.call_id WHERE s.call_id IS NULL OR n.nth > 1"""
