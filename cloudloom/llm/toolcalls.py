"""Chat formatting: tool calls linked with their results, put in topological order, checked against schemas, as canonical JSON.

Calls and results meet in a hash join on conversation and identifier. One row for each conversation then holds its calls; inside
it they are ordered so that each stands after those whose results it uses (Kahn's algorithm, ties by turn, then identifier),
arguments are validated against the tool's schema, and the whole is written as JSON with sorted keys and no spaces.
A conversation's text is one value of the output, so it must fit a row there as here; nothing larger is gathered.

Calls: (conversation, id, turn, name, arguments as JSON text, uses: array of identifiers). Results: (conversation, id, turn, content).

Defined results: of several calls (or results) with one conversation and identifier the one of the smallest turn, then
smallest text, counts; the rest are repeats and ignored, and so are rows with a null conversation or identifier. A call without a result has
result null; a result without a call is an orphan, listed by identifier. Identifiers in ``uses`` that no call has are ignored.
Calls in a cycle come last, by turn and identifier, with "cyclic" true. Null, unreadable or non-object arguments and unknown tools
are invalid; what can't be read (also NaN, infinities and what is nested deeper than the interpreter's limit) stands in the JSON as the text that it is. Of equal keys
of an object the last counts. Halves of surrogate pairs are written as escapes. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HALF = re.compile("[\ud800-\udfff]")
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def parsed(arguments: str | None) -> tuple[bool, object]:
    """(whether JSON text could be read, its value, else the text itself). What JSON has no form for (NaN, infinities), and what is nested too deep to be read or written, can't be read."""
    if arguments is None:
        return False, None
    try:
        value = json.loads(arguments)
        canonical([[[[[[[[value]]]]]]]])  # deeper than a conversation's JSON holds it
    except (ValueError, RecursionError):
        return False, arguments
    return True, value


def valid(arguments: str | None, schema: dict | None) -> bool:
    """Whether JSON text is an object with the schema's required properties, no others, of the right types and lengths."""
    readable, value = parsed(arguments)
    return readable and fits(value, schema)


def fits(value: object, schema: dict | None) -> bool:
    if schema is None or not isinstance(value, dict):
        return False
    known = schema.get("properties", {})
    if set(schema.get("required", ())) - set(value) or set(value) - set(known):
        return False
    for name, x in value.items():
        rule = known[name]
        if not isinstance(x, KINDS[rule["type"]]) or (isinstance(x, bool) and rule["type"] != "boolean"):
            return False
        if "maxLength" in rule and len(x) > rule["maxLength"] or "minLength" in rule and len(x) < rule["minLength"]:
            return False
        if "minimum" in rule and x < rule["minimum"] or "enum" in rule and x not in rule["enum"]:
            return False
    return True


def canonical(value) -> str:
    """Sorted keys, no spaces, characters as they are but for halves of surrogate pairs, which UTF-8 has no form for and which are written as escapes."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def ordered(calls: list[dict]) -> tuple[list[dict], int]:
    """Calls after those that they use; and how many of the last ones are in, or behind, a cycle."""
    by_id = {c["id"]: c for c in calls}
    waits = {i: {u for u in c["uses"] or () if u in by_id} for i, c in by_id.items()}
    behind: dict[str, list[str]] = {}
    for i, needed in waits.items():
        for u in needed:
            behind.setdefault(u, []).append(i)
    rank = lambda i: (by_id[i]["turn"] is None, by_id[i]["turn"] or 0, i)
    ready = [rank(i) for i, needed in waits.items() if not needed]
    heapq.heapify(ready)
    out: list[str] = []
    while ready:
        i = heapq.heappop(ready)[-1]
        out.append(i)
        for j in behind.get(i, ()):
            waits[j].discard(i)
            if not waits[j]:
                heapq.heappush(ready, rank(j))
    rest = sorted(rank(i) for i in set(by_id) - set(out))
    return [by_id[i] for i in [*out, *(r[-1] for r in rest)]], len(rest)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conversation, n_calls, n_linked, n_orphans, n_invalid, call_order (array of identifiers), json."""
    key = ["conversation", "id"]
    one = lambda df, *columns: (
        df.where(F.col("conversation").isNotNull() & F.col("id").isNotNull()).groupBy(*key).agg(F.min(F.struct("turn", *columns)).alias("it"))
    )
    first_calls = one(calls, "name", "arguments", "uses").select(*key, F.lit(True).alias("called"), F.col("it.turn").alias("turn"), "it.name", "it.arguments", "it.uses")
    first_results = one(results, "content").select(*key, F.lit(True).alias("answered"), F.col("it.content").alias("content"))
    fields = ["id", "called", "answered", "turn", "name", "arguments", "uses", "content"]
    rows = first_calls.join(first_results, key, "full").groupBy("conversation").agg(F.collect_list(F.struct(*fields)).alias("rows"))
    kind = rows.schema["conversation"].dataType.simpleString()

    def formatted(rows: list[dict]) -> tuple:
        calls, late = ordered([r for r in rows if r["called"]])
        values = [parsed(c["arguments"]) for c in calls]
        good = [readable and fits(value, schemas.get(c["name"])) for c, (readable, value) in zip(calls, values, strict=True)]
        orphans = sorted(r["id"] for r in rows if not r["called"])
        listed = []
        for k, (c, ok, (_, value)) in enumerate(zip(calls, good, values, strict=True)):
            entry = {"arguments": value, "id": c["id"], "name": c["name"], "result": c["content"], "valid": ok}
            listed.append(entry | ({"cyclic": True} if k >= len(calls) - late else {}))
        text = canonical({"calls": listed, "orphans": orphans})
        return len(calls), sum(bool(c["answered"]) for c in calls), len(orphans), good.count(False), [c["id"] for c in calls], text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.string()]
        for batch in batches:
            found = list(zip(*map(formatted, batch.column("rows").to_pylist()), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("conversation"), *[pa.array(list(c), k) for c, k in zip(found, kinds, strict=True)]], names=["conversation", "n_calls", "n_linked", "n_orphans", "n_invalid", "call_order", "json"])

    return rows.mapInArrow(run, f"conversation {kind}, n_calls long, n_linked long, n_orphans long, n_invalid long, call_order array<string>, json string")


#: The tools of the conversations' calls.
SCHEMAS = {
    "search": {"properties": {"query": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["query", "turn"]},
    "lookup": {"properties": {"query": {"type": "string", "minLength": 1, "maxLength": 120}, "turn": {"type": "integer", "minimum": 0}}, "required": ["query", "turn"]},
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off a table of turns: a user's turn asks a tool (search on turns divisible by 4, else lookup), and uses what
    was asked two turns before; an assistant's turn answers the turn before it."""
    rows = conversations.select(F.col("conv_id").alias("conversation"), F.col("turn"), "role", "text")
    named = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    asked = rows.where("role = 'user'").select(
        "conversation", named(F.col("turn")).alias("id"), "turn", F.when(F.col("turn") % 4 == 0, "search").otherwise("lookup").alias("name"),
        F.to_json(F.struct(F.col("text").alias("query"), "turn")).alias("arguments"), F.array(named(F.col("turn") - 2)).alias("uses"),
    )
    answered = rows.where("role = 'assistant'").select("conversation", named(F.col("turn") - 1).alias("id"), "turn", F.col("text").alias("content"))
    return asked, answered
