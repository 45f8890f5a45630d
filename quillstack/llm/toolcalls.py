"""Tool-call linking for chat transcripts.

A message's text may be a JSON object that makes calls (``tool_calls``: objects with ``id``, ``name`` and
``arguments``, an object or its JSON text) or gives a result (``tool_call_id`` and ``content``); any other
text is a plain message. Every call and result becomes a row of its own beside its message's. Calls and
results meet in a hash join on conversation and identifier; a call comes after the calls whose identifiers its
arguments cite (``{"$ref": id}``); arguments are validated against the tool's schema; and every row carries
its canonical JSON (sorted keys, no spaces, shortest numbers).

Order within a conversation is by (``sort_turn``, ``level``, ``sort_rank``): a result stands right after its
call, and ``level`` is the length of the longest chain of citations below a call. These are columns, so no
conversation, however long, is gathered or numbered in one task.

With ``implied`` a transcript without explicit calls is read as calls of the tool ``reply``: a user's turn
calls it with its text, and the next turn, if an assistant's, is the result. A follow-up cites the call before
it (``after``): the user's turn two turns earlier, unless that begins with a brace and so may be JSON.

Defined results: a null text is an empty message; a null role is ``unknown``; a row without conversation or
turn is kept and never linked; of several calls or results with one identifier the smallest turn counts and
``problem`` says ``duplicate id`` on all; calls that cite each other in a circle, or an unknown call, have
level null and say so; broken JSON, or one nested deeper than ``DEPTH``, is a plain message, and as arguments it is
the text that it is; lone surrogates stay escaped; repeated rows each keep a row and count as duplicates; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize

REPLY = {"type": "object", "properties": {"text": {"type": "string", "minLength": 1}, "after": {"type": "object"}}, "required": ["text"], "additionalProperties": False}
#: Of two short identifiers each: what is left of the citations is followed on the driver once it is no more.
LOCAL_CITES = 50_000
#: Levels of nesting up to which a text counts as JSON.
DEPTH = 200
#: More than any level; in circles lengths grow without meaning.
_ENDLESS = 1 << 40

PARTS = "conv_id long, turn long, part int, role string, kind string, call_id string, tool string, cites array<string>, valid boolean, problem string, json string"
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


_SURROGATE = re.compile("[\ud800-\udfff]")


def _escaped(text: str) -> str:
    """Lone surrogates as JSON escapes; UTF-8 has no form for them."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _number(x) -> str:
    """As ECMAScript writes it: integers below 1e21 in full, and no padded exponents."""
    if isinstance(x, int) or x.is_integer() and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        return mantissa
    if int(exponent) < -6:
        return f"{mantissa}e{int(exponent)}"
    if int(exponent) > 0:
        return f"{mantissa}e+{int(exponent)}"
    return "-" * (x < 0) + "0." + "0" * (-int(exponent) - 1) + mantissa.lstrip("-").replace(".", "")


def canonical(value) -> str:
    """Sorted keys (by UTF-16 units), no spaces, shortest numbers."""
    if isinstance(value, str):
        return _escaped(json.dumps(value, ensure_ascii=False))
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value) if value is None or isinstance(value, bool) else _number(value)


def _refuse(name: str):
    raise ValueError(name)


def _loaded(text: str):
    """The value of a JSON text; ValueError where it is none, is nested too deep, or has a number that JSON has not."""
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=lambda x: y if abs(y := float(x)) < float("inf") else _refuse(x))
    except RecursionError:
        raise ValueError("nested too deep") from None
    level = [value]
    for _ in range(DEPTH):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return value
    raise ValueError("nested too deep")


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What of ``schema`` the value breaks: type, enum, required, properties, additionalProperties, items, lengths, bounds."""
    kinds = schema.get("type")
    if kinds is not None:
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        fits = lambda k: number and (k == "number" or isinstance(value, int) or value.is_integer()) if k in ("number", "integer") else isinstance(value, _KINDS[k])
        if not any(fits(k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            return [f"{at}: not {kinds}"]
    out = [] if "enum" not in schema or value in schema["enum"] else [f"{at}: not one of the values"]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list):
        for i, v in enumerate(value if "items" in schema else []):
            out += violations(v, schema["items"], f"{at}[{i}]")
    size = len(value) if isinstance(value, (str, list)) else None
    for name, amount, wrong in (("minLength", size, int.__lt__), ("maxLength", size, int.__gt__), ("minItems", size, int.__lt__), ("maxItems", size, int.__gt__)):
        if name in schema and amount is not None and wrong(amount, schema[name]):
            out.append(f"{at}: {name}")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: minimum"] * ("minimum" in schema and value < schema["minimum"]) + [f"{at}: maximum"] * ("maximum" in schema and value > schema["maximum"])
    return out


def _cited(value) -> list[str]:
    if isinstance(value, dict):
        own = [value["$ref"]] if isinstance(value.get("$ref"), str) else []
        return own + [c for v in value.values() for c in _cited(v)]
    return [c for v in value for c in _cited(v)] if isinstance(value, list) else []


def _refless(value):
    """Arguments as the schema sees them: what a citation will stand for is not known, so it is left out."""
    if isinstance(value, dict):
        return {k: _refless(v) for k, v in value.items() if not (isinstance(v, dict) and "$ref" in v)}
    return [_refless(v) for v in value] if isinstance(value, list) else value


def _call(name, arguments, schemas: dict) -> tuple[bool, str | None]:
    schema = schemas.get(name)
    if schema is None:
        return False, "unknown tool"
    pending = {k for k, v in arguments.items() if isinstance(v, dict) and "$ref" in v} if isinstance(arguments, dict) else set()
    found = [x for x in violations(_refless(arguments), schema) if x.split(": ")[-1] != "missing" or x.split(": ")[0].rpartition(".")[2] not in pending]
    return not found, "; ".join(found) or None


def parse(conv_id, turn, role, text, schemas: dict, implied: bool, follows: bool = False) -> list[dict]:
    """The rows of one message."""
    role, text = role or "unknown", text or ""
    row = lambda part, kind, body, **more: {"conv_id": conv_id, "turn": turn, "part": part, "role": role, "kind": kind, "call_id": None, "tool": None, "cites": [], "valid": None, "problem": None, "json": canonical(body)} | more
    name_of = lambda x: None if x is None else _escaped(x if isinstance(x, str) else canonical(x))
    value = None
    if text[:1] == "{":
        try:
            value = _loaded(text)
        except ValueError:
            value = None
    calls = value.get("tool_calls") if isinstance(value, dict) else None
    if isinstance(calls, list) and all(isinstance(c, dict) for c in calls):
        out = [row(0, "message", {"role": role, "content": value.get("content")})]
        for k, c in enumerate(calls):
            arguments = c.get("arguments")
            if isinstance(arguments, str):
                try:
                    arguments = _loaded(arguments)
                except ValueError:
                    pass
            name = c.get("name") if isinstance(c.get("name"), str) else None
            valid, problem = _call(name, arguments, schemas)
            key = name_of(c.get("id"))
            out.append(row(k + 1, "call", {"id": c.get("id"), "name": name, "arguments": arguments}, call_id=key, tool=name_of(name), cites=sorted({_escaped(x) for x in _cited(arguments)}), valid=valid, problem=problem if key else "no id"))
        return out
    if isinstance(value, dict) and "tool_call_id" in value:
        key = name_of(value["tool_call_id"])
        return [row(0, "result", {"role": role, "tool_call_id": value["tool_call_id"], "content": value.get("content")}, call_id=key, problem=None if key else "no id")]
    if implied and turn is not None and conv_id is not None:
        if role == "user":
            arguments = {"text": text} | ({"after": {"$ref": f"t{turn - 2}"}} if follows else {})
            valid, problem = _call("reply", arguments, schemas)
            return [row(0, "call", {"id": f"t{turn}", "name": "reply", "arguments": arguments}, call_id=f"t{turn}", tool="reply", cites=_cited(arguments), valid=valid, problem=problem)]
        if role == "assistant":
            return [row(0, "result", {"role": role, "tool_call_id": f"t{turn - 1}", "content": text}, call_id=f"t{turn - 1}")]
    return [row(0, "message", {"role": role, "content": text})]


def _chains(edges: list) -> list[tuple[int, str, int]]:
    """(conv_id, call_id, level) of the calls whose citations all resolve; an edge as in ``_levels``."""
    level, waits, citing = defaultdict(int), defaultdict(int), defaultdict(list)
    for conv, call, of, add, floor in edges:
        if of is not None:
            waits[conv, call] += 1
            citing[conv, of].append((conv, call, add))
        level[conv, call] = max(level[conv, call], floor)
    ready = [call for call in level if not waits[call]]
    for call in ready:  # grows while it is read
        for conv, name, add in citing[call]:
            above = conv, name
            level[above] = max(level[above], level[call] + add)
            waits[above] -= 1
            if not waits[above]:
                ready.append(above)
    return [(*call, level[call]) for call in ready]


def _levels(parts: DataFrame) -> DataFrame | None:
    """conv_id, call_id, level of the calls that cite or are cited; None where no call cites any.

    An edge (call, of, add, floor) says that the call's level is at least ``floor``, and ``add`` more than that of ``of``.
    Each round resolves the calls whose edges are all resolved, until a round resolves none: what is left then is a
    circle, an unknown call, or cites one. Between rounds, edges to calls that have one open edge themselves skip those,
    so that a chain of citations takes as many rounds as its length has binary digits. As soon as few edges are left,
    one pass over them ends it.
    """
    cites = parts.where("kind = 'call' and call_id is not null and conv_id is not null").select("conv_id", "call_id", F.explode("cites").alias("of")).distinct()
    if cites.isEmpty():
        return None
    cites = materialize(cites, "cites")
    calls, pair = parts.where("kind = 'call' and conv_id is not null").select("conv_id", "call_id").distinct(), ["conv_id", "call_id"]
    known = ready = materialize(calls.join(cites.select(*pair), pair, "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    edges, n = cites.withColumns({"add": F.lit(1).cast("long"), "floor": F.lit(0).cast("long")}), 0
    bounded = lambda x: F.least(x, F.lit(_ENDLESS))
    while True:
        found = ready.select("conv_id", F.col("call_id").alias("of"), F.col("level").alias("found"))
        resolved = F.greatest("floor", F.coalesce(F.col("found") + F.col("add"), F.lit(0)))
        edges = materialize(edges.join(found, ["conv_id", "of"], "left").select(*pair, F.when(F.col("found").isNull(), F.col("of")).alias("of"), "add", resolved.alias("floor")), "edges")
        if edges.limit(LOCAL_CITES + 1).count() <= LOCAL_CITES:
            return known.unionByName(parts.sparkSession.createDataFrame(_chains(edges.collect()), "conv_id long, call_id string, level long"))
        state = edges.groupBy(*pair).agg(F.count("of").alias("waits"), F.max("of").alias("next"), F.max(F.when(F.col("of").isNotNull(), F.col("add"))).alias("more"), F.max("floor").alias("least"))
        state = materialize(state, "states")
        ready = state.where("waits = 0").select(*pair, F.col("least").alias("level"))
        if ready.isEmpty():
            return known
        known, n = known.unionByName(ready), n + 1
        if n % 16 == 0:
            known = materialize(known, "levels")  # or the plan grows with the depth
        one = state.where("waits = 1").select("conv_id", F.col("call_id").alias("of"), "next", "more", "least")
        edges = edges.join(ready.select(*pair), pair, "left_anti").join(one, ["conv_id", "of"], "left")
        edges = edges.select(*pair, F.coalesce("next", "of").alias("of"), bounded(F.col("add") + F.coalesce("more", F.lit(0))).alias("add"), bounded(F.greatest("floor", F.coalesce(F.col("add") + F.col("least"), F.lit(0)))).alias("floor"))


def link(messages: DataFrame, schemas: dict | None = None, implied: bool = False) -> DataFrame:
    """conv_id, turn, part, role, kind, call_id, tool, linked, partner_turn, level, sort_turn, sort_rank, valid, problem, json."""
    bound_batches(messages.sparkSession)
    schemas = {"reply": REPLY} | (schemas or {})

    def run(batches):
        for batch in batches:
            rows = [x for *m, follows in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True) for x in parse(*m, schemas, implied, follows)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("kind", pa.string()), ("call_id", pa.string()), ("tool", pa.string()), ("cites", pa.list_(pa.string())), ("valid", pa.bool_()), ("problem", pa.string()), ("json", pa.string())])
    messages = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    if implied:
        before = messages.where("role = 'user' and not startswith(coalesce(text, ''), '{')").select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("follows")).distinct()
        messages = messages.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "text", F.coalesce("follows", F.lit(False)).alias("follows"))
    else:
        messages = messages.withColumn("follows", F.lit(False))
    parts = messages.mapInArrow(run, PARTS)
    parts = materialize(parts, "parts")

    keyed = parts.where("call_id is not null and conv_id is not null and turn is not null and kind <> 'message'")
    ids = keyed.groupBy("conv_id", "call_id").agg(
        F.min(F.when(F.col("kind") == "call", F.col("turn"))).alias("call_turn"), F.min(F.when(F.col("kind") == "result", F.col("turn"))).alias("result_turn"),
        F.count_if(F.col("kind") == "call").alias("calls"), F.count_if(F.col("kind") == "result").alias("results"),
    )
    out = parts.join(ids, ["conv_id", "call_id"], "left")
    levels = _levels(parts)
    out = out.withColumn("level", F.when(F.col("kind") == "call", F.lit(0).cast("long"))) if levels is None else out.join(levels, ["conv_id", "call_id"], "left").withColumn("level", F.when(F.col("kind") == "call", F.coalesce("level", F.when(F.size("cites") == 0, F.lit(0).cast("long")))))
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    partner = F.when(call, F.col("result_turn")).when(result, F.col("call_turn"))
    twice = F.when(call, F.col("calls") > 1).when(result, F.col("results") > 1)
    trouble = F.array_compact(
        F.array(
            F.col("problem"), F.when(twice, F.lit("duplicate id")), F.when(result & F.col("call_turn").isNull(), F.lit("no call")), F.when(call & F.col("result_turn").isNull(), F.lit("no result")),
            F.when((call | result) & (F.col("result_turn") < F.col("call_turn")), F.lit("result before call")), F.when(call & F.col("level").isNull(), F.lit("unresolved citation")),
        )
    )
    return out.select(
        "conv_id", "turn", "part", "role", "kind", "call_id", "tool", F.when(call | result, partner.isNotNull()).alias("linked"), partner.alias("partner_turn"), "level",
        F.coalesce(F.when(result, F.col("call_turn")), F.col("turn")).alias("sort_turn"), F.when(result, F.lit(2)).when(call, F.lit(1)).otherwise(0).alias("sort_rank"), "valid", F.nullif(F.array_join(trouble, "; "), F.lit("")).alias("problem"), "json",
    )
