"""Operator 4: tool-call linking for chat formatting.

Calls and results are joined by conversation and identifier. The calls of a
conversation are put in topological order of their dependencies (the smallest
position first among those that are free), their arguments are validated against
the tool's JSON schema, and the whole is serialised as canonical JSON: keys
sorted by UTF-16 code units, no white space, shortest numbers.

Defined results. Of calls or results that repeat an identifier the first by
position holds, ties by content; a result without call is counted as an orphan.
Calls on a cycle of dependencies come last, by position, with status `cycle`;
dependencies on unknown calls are ignored. The status of a call is, in this
order, `cycle`, `unknown_tool`, `bad_json`, `invalid: <path> <rule>` or `ok`; a
call without result has a null one. Null names are unknown tools, null arguments
are bad JSON, and so are those nested more than `DEPTH` deep; arguments that are bad
JSON are kept as the text they are. A lone surrogate is written as its escape. Rules
of a schema that `problem` does not know are an error before anything is read. Rows without conversation or identifier are left out. Other columns
are never read; an empty table gives an empty result.

Scale. One shuffle by conversation serves the join and the grouping; a
conversation is handled by one task. System and other turns that are neither call
nor result stand nowhere in the output; a conversation of such turns has no row.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _store

#: The tool of `from_turns`: a user's turn asks, the assistant's next turn answers.
SCHEMAS = {
    "reply": {
        "type": "object",
        "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["prompt", "turn"],
        "additionalProperties": False,
    }
}
#: Nesting of arguments; deeper ones are bad JSON.
DEPTH = 64
_LINKED = "conv_id long, n_calls int, n_linked int, n_invalid int, n_orphans int, canonical string"


def _number(x: float) -> str:
    """A double as ECMAScript prints it."""
    if x == 0:
        return "0"
    sign, x = "-" if x < 0 else "", abs(x)
    mantissa, _, exponent = f"{x!r}".partition("e") if "e" in f"{x!r}" else (f"{x!r}", "", "")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) if whole.strip("0") else int(exponent or 0) - (len(part) - len(part.lstrip("0")))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def canonical(x) -> str:
    """Canonical JSON of a value that json.loads made."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(x[k])}" for k in sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(canonical, x)) + "]"
    if isinstance(x, float):
        return _number(x) if math.isfinite(x) else "null"
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(x, ensure_ascii=False))


_SURROGATE = re.compile("[\ud800-\udfff]")


def too_deep(x, most: int = DEPTH) -> bool:
    """Whether a value is nested more than `most` deep; level by level, without recursion."""
    level = [x]
    for _ in range(most + 1):
        level = [z for y in level if isinstance(y, (dict, list)) for z in (y.values() if isinstance(y, dict) else y)]
        if not level:
            return False
    return True


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(x, kind: str) -> bool:
    if kind == "integer":
        return not isinstance(x, bool) and (isinstance(x, int) or isinstance(x, float) and x.is_integer())
    if kind == "number":
        return not isinstance(x, bool) and isinstance(x, (int, float))
    return isinstance(x, _TYPES.get(kind, object))


_KNOWN = frozenset("type enum const minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minItems maxItems uniqueItems items minProperties maxProperties properties required additionalProperties allOf anyOf oneOf not $ref $defs definitions".split())
_NOTES = frozenset("$schema $id $comment title description default examples format deprecated readOnly writeOnly".split())


def check_schema(schema, at: str = "#") -> None:
    """ValueError for a rule that `problem` would not look at."""
    if isinstance(schema, bool):
        return
    for k in sorted(schema):
        if k not in _KNOWN and k not in _NOTES:
            raise ValueError(f"{at}/{k} is no known rule")
    for k in ("properties", "$defs", "definitions"):
        for n, s in schema.get(k, {}).items():
            check_schema(s, f"{at}/{k}/{n}")
    for k in ("allOf", "anyOf", "oneOf"):
        for i, s in enumerate(schema.get(k, [])):
            check_schema(s, f"{at}/{k}/{i}")
    for k in ("items", "not", "additionalProperties"):
        if k in schema:
            check_schema(schema[k], f"{at}/{k}")


def _pointed(root: dict, ref: str):
    """What a pointer into the schema itself leads to."""
    if not ref.startswith("#"):
        raise ValueError(f"{ref} leads outside the schema")
    out = root
    for part in ref[1:].split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        out = out[int(part)] if isinstance(out, list) else out[part]
    return out


def problem(x, schema, at: str = "$", root: dict | None = None) -> str | None:
    """The first rule of a JSON schema that x breaks, depth first, as `path rule`."""
    if isinstance(schema, bool):
        return None if schema else f"{at} false"
    root = schema if root is None else root
    inner = lambda y, s, where=at: problem(y, s, where, root)
    if "$ref" in schema and (found := inner(x, _pointed(root, schema["$ref"]))):
        return found
    kinds = schema.get("type")
    if kinds is not None and not any(_is(x, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at} type"
    if "enum" in schema and canonical(x) not in {canonical(e) for e in schema["enum"]}:
        return f"{at} enum"
    if "const" in schema and canonical(x) != canonical(schema["const"]):
        return f"{at} const"
    for s in schema.get("allOf", []):
        if found := inner(x, s):
            return found
    if "anyOf" in schema and all(inner(x, s) for s in schema["anyOf"]):
        return f"{at} anyOf"
    if "oneOf" in schema and sum(not inner(x, s) for s in schema["oneOf"]) != 1:
        return f"{at} oneOf"
    if "not" in schema and not inner(x, schema["not"]):
        return f"{at} not"
    rules: list[tuple] = []
    if isinstance(x, str):
        rules = [("minLength", lambda n: len(x) < n), ("maxLength", lambda n: len(x) > n), ("pattern", lambda p: not re.search(p, x))]
    elif _is(x, "number"):
        rules = [("minimum", lambda n: x < n), ("maximum", lambda n: x > n), ("exclusiveMinimum", lambda n: x <= n), ("exclusiveMaximum", lambda n: x >= n), ("multipleOf", lambda n: not float(x / n).is_integer())]
    elif isinstance(x, list):
        rules = [("minItems", lambda n: len(x) < n), ("maxItems", lambda n: len(x) > n), ("uniqueItems", lambda on: on and len({canonical(y) for y in x}) < len(x))]
    elif isinstance(x, dict):
        rules = [("minProperties", lambda n: len(x) < n), ("maxProperties", lambda n: len(x) > n)]
    for rule, bad in rules:
        if rule in schema and bad(schema[rule]):
            return f"{at} {rule}"
    if isinstance(x, list) and "items" in schema:
        for i, y in enumerate(x):
            if found := inner(y, schema["items"], f"{at}[{i}]"):
                return found
    if isinstance(x, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in x:
                return f"{at}.{k} required"
        others = schema.get("additionalProperties", True)
        for k in sorted(x):
            if k not in known and others is False:
                return f"{at}.{k} additionalProperties"
            if found := inner(x[k], known.get(k, others), f"{at}.{k}"):
                return found
    return None


def order(ids: list[str], after: list[list[str]]) -> tuple[list[int], int]:
    """Indices in topological order, free ones by index; the last n of them, the second value, lie on or behind a cycle."""
    index = {x: i for i, x in enumerate(ids)}
    waits = [{index[a] for a in ys if a in index} for ys in after]
    then: list[list[int]] = [[] for _ in ids]
    for i, w in enumerate(waits):
        for j in w:
            then[j].append(i)
    left = [len(w) for w in waits]
    free = [i for i, n in enumerate(left) if not n]
    out = []
    while free:
        i = heapq.heappop(free)
        out.append(i)
        for j in then[i]:
            left[j] -= 1
            if not left[j]:
                heapq.heappush(free, j)
    done = set(out)
    rest = [i for i in range(len(ids)) if i not in done]
    return out + rest, len(rest)


def _unordered(x: str):
    raise ValueError(x)


def _format(schemas: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, calls, orphans in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                calls = sorted(calls, key=lambda c: (c["seq"] is not None, c["seq"] or 0, c["id"]))
                at, n_cycle = order([c["id"] for c in calls], [c["after"] or [] for c in calls])
                out, invalid = [], 0
                for n, i in enumerate(at):
                    c = calls[i]
                    args, status = c["args"], "ok"
                    try:
                        read = json.loads(args or "", parse_constant=_unordered)
                        if too_deep(read):
                            raise ValueError("depth")
                    except (ValueError, RecursionError):
                        status = "bad_json"
                    else:
                        args = read
                        broken = problem(args, schemas[c["name"]]) if c["name"] in schemas else None
                        status = f"invalid: {broken}" if broken else "ok"
                    if c["name"] not in schemas:
                        status = "unknown_tool"
                    if n >= len(at) - n_cycle:
                        status = "cycle"
                    invalid += status != "ok"
                    out.append({"arguments": args, "id": c["id"], "name": c["name"], "result": c["result"], "status": status})
                rows.append((conv, len(calls), sum(c["linked"] for c in calls), invalid, orphans, canonical(out)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["conv_id", "n_calls", "n_linked", "n_invalid", "n_orphans", "canonical"])

    return run


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """A row for each conversation that has a call or a result. calls: conv_id, seq, call_id, name, arguments, after; results: conv_id, seq, call_id, content."""
    for name, schema in schemas.items():
        check_schema(schema, name)
    c = calls.select(*[F.col(f"`{x}`").alias(f"_{x}") for x in ("conv_id", "seq", "call_id", "name", "arguments", "after")]).where("_conv_id is not null and _call_id is not null")
    c = c.groupBy("_conv_id", "_call_id").agg(F.min(F.struct(F.col("_seq").alias("seq"), F.col("_name").alias("name"), F.col("_arguments").alias("args"), F.col("_after").alias("after"))).alias("_c"))
    r = results.select(*[F.col(f"`{x}`").alias(f"_{x}") for x in ("conv_id", "seq", "call_id", "content")]).where("_conv_id is not null and _call_id is not null")
    r = r.groupBy(F.col("_conv_id").alias("_conv2"), F.col("_call_id").alias("_call2")).agg(F.min(F.struct(F.col("_seq").alias("seq"), F.col("_content").alias("content"))).alias("_r"))
    both = c.join(r, (F.col("_conv_id") == F.col("_conv2")) & (F.col("_call_id") == F.col("_call2")), "full_outer")
    call = F.struct(F.col("_c.seq").alias("seq"), F.col("_call_id").alias("id"), F.col("_c.name").alias("name"), F.col("_c.args").alias("args"), F.col("_c.after").alias("after"), F.col("_r.content").alias("result"), F.col("_r").isNotNull().alias("linked"))
    grouped = both.groupBy(F.coalesce("_conv_id", "_conv2").cast("long").alias("_conv")).agg(F.collect_list(F.when(F.col("_c").isNotNull(), call)).alias("_calls"), F.count_if(F.col("_c").isNull()).cast("int").alias("_orphans"))
    return _store.arrow(grouped, _format(schemas), _LINKED)


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of chat messages (conv_id, turn, role, text): an assistant's text that is a JSON object with tool_calls [{id, name, arguments, after}], and a tool's with tool_call_id and content. Other texts hold none."""
    m = _store.pick(messages, conv_id="conv_id", seq="turn", _role="role", _text="text")
    one = F.from_json("_text", "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>,tool_call_id:string,content:string>")
    m = m.withColumn("_m", one)
    calls = m.where("_role = 'assistant'").select("conv_id", "seq", F.posexplode("_m.tool_calls").alias("_i", "_c"))
    # positions inside a message follow those of messages
    calls = calls.select("conv_id", (F.col("seq") * 1_000_000 + F.col("_i")).alias("seq"), F.col("_c.id").alias("call_id"), F.col("_c.name").alias("name"), F.col("_c.arguments").alias("arguments"), F.col("_c.after").alias("after"))
    results = m.where("_role = 'tool' and _m.tool_call_id is not null").select("conv_id", "seq", F.col("_m.tool_call_id").alias("call_id"), F.col("_m.content").alias("content"))
    return calls, results


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, _role, _text); of rows that repeat a turn the smallest role and text hold."""
    turns = _store.pick(conversations, conv_id="conv_id", turn="turn", _role="role", _text="text").where("conv_id is not null and turn is not null")
    return turns.groupBy("conv_id", "turn").agg(F.min(F.struct("_role", "_text")).alias("_t")).select("conv_id", "turn", "_t.*")


def _name(turn: Column) -> Column:
    return F.concat(F.lit("c"), turn.cast("string"))


def as_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as a chat log with tool calls (conv_id, turn, role, text), as `from_messages` reads it: a user's turn is a message that calls `reply`, an assistant's turn the tool's answer to the turn before it; others have neither.

    The calls of every fourth conversation each follow the one before, of the next the one after (so that the last comes first), of the next the one before in a ring (a cycle), of the last the one two before (two branches)."""
    turns = _turns(conversations)
    w = Window.partitionBy("conv_id").orderBy("turn")
    way = F.pmod(F.col("conv_id"), F.lit(4))
    last = F.last("turn").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    other = F.when(way == 1, F.lead("turn").over(w)).when(way == 2, F.coalesce(F.lag("turn").over(w), last)).when(way == 3, F.lag("turn", 2).over(w)).otherwise(F.lag("turn").over(w))
    call = F.struct(_name(F.col("turn")).alias("id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("_text").alias("prompt"), "turn")).alias("arguments"), F.when(other.isNotNull(), F.array(_name(other))).alias("after"))
    calls = turns.where("_role = 'user'").select("conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    answer = F.struct(_name(F.col("turn") - 1).alias("tool_call_id"), F.col("_text").alias("content"))
    return calls.unionByName(turns.where("_role = 'assistant'").select("conv_id", "turn", F.lit("tool").alias("role"), F.to_json(answer).alias("text")))


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls of the tool `reply`: every user turn calls it, after the user turn before it; an assistant turn is the result of the turn before it. Of rows that repeat a turn the smallest role and text hold."""
    turns = _turns(conversations)
    user = turns.where("_role = 'user'")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    calls = user.select("conv_id", F.col("turn").alias("seq"), _name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("_text").alias("prompt"), "turn")).alias("arguments"), F.when(before.isNotNull(), F.array(_name(before))).alias("after"))
    results = turns.where("_role = 'assistant'").select("conv_id", F.col("turn").alias("seq"), _name(F.col("turn") - 1).alias("call_id"), F.col("_text").alias("content"))
    return calls, results


#: DuckDB: what follows the call before or two before is in the order of the turns, what follows the call after in reverse, and a ring is a cycle.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, min({'r': role, 't': text}) AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), u AS (SELECT conv_id, turn, x.t AS text FROM t WHERE x.r = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, x.t AS text FROM t WHERE x.r = 'assistant'),
j AS (
  SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, u.turn, u.text, a.turn AS answered, a.text AS result,
    CASE WHEN coalesce(u.conv_id, 0) % 4 = 2 THEN 'cycle' WHEN u.text IS NULL THEN 'invalid: $.prompt required' WHEN length(u.text) < 1 THEN 'invalid: $.prompt minLength' WHEN length(u.text) > 400 THEN 'invalid: $.prompt maxLength' WHEN u.turn < 0 THEN 'invalid: $.turn minimum' ELSE 'ok' END AS status
  FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.turn = a.turn
)
SELECT conv_id, count(turn)::INTEGER AS n_calls, count(*) FILTER (turn IS NOT NULL AND answered IS NOT NULL)::INTEGER AS n_linked, count(*) FILTER (turn IS NOT NULL AND status <> 'ok')::INTEGER AS n_invalid, count(*) FILTER (turn IS NULL)::INTEGER AS n_orphans,
  '[' || coalesce(string_agg('{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || to_json(text)::VARCHAR || ',' END || '"turn":' || turn || '},"id":"c' || turn || '","name":"reply","result":' || coalesce(to_json(result)::VARCHAR, 'null') || ',"status":"' || status || '"}', ',' ORDER BY CASE WHEN conv_id % 4 = 1 THEN -turn ELSE turn END) FILTER (turn IS NOT NULL), '') || ']' AS canonical
FROM j GROUP BY conv_id
"""
