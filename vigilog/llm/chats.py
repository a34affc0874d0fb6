"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on conversation and identifier. A call that names results of
other calls comes after them. Where turns alone give such an order nothing more is done; calls of one
turn, and conversations in which a call names one of a later turn, are ordered by taking away, round by
round, the calls that wait for nothing. Each message, call and result is a row of its own, so a
conversation of any length is never put together in one task.
"""

from __future__ import annotations

import json
import re
from math import isfinite
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.ordinals import dense_ordinal
from ..sources.shared import materialise

#: Key of an argument object that names the result of another call.
REFERENCE = "$result"
TURNS_PER_BUCKET = 65_536
#: Nesting of arguments, beyond which they are invalid.
MAX_DEPTH = 100
#: Ties of a conversation that are ordered in one call; conversations with more are ordered in rounds.
GROUPED_TIES = 50_000
#: Keywords of JSON schemas that are judged, and those that say nothing about a value. Fixed values.
KEYWORDS = frozenset(
    "type enum const required properties additionalProperties items minItems maxItems minLength maxLength pattern"
    " minimum maximum title description default examples $comment".split()
)
_KINDS = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
    "number": (int, float), "integer": int,
}


def problem(value: Any, schema: dict, at: str = "$") -> str | None:
    """What is wrong with a value under a JSON schema, None if nothing is.

    Knows ``type, enum, const, required, properties, additionalProperties, items, minItems, maxItems,
    minLength, maxLength, pattern, minimum, maximum``. An object that names a result fits every type.
    """
    if isinstance(value, dict) and set(value) == {REFERENCE}:
        return None
    kinds = schema.get("type")
    if kinds is not None:
        names = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(value, name) for name in names):
            return f"{at}: not {' or '.join(names)}"
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        return f"{at}: not an allowed value"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            return f"{at}: length {len(value)}"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"{at}: not of the pattern"
    if isinstance(value, int | float) and not isinstance(value, bool):
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value):
            return f"{at}: out of range"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return f"{at}: {len(value)} items"
        found = (problem(x, schema.get("items", {}), f"{at}[{i}]") for i, x in enumerate(value))
        return next((x for x in found if x), None)
    if isinstance(value, dict):
        missing = [k for k in schema.get("required", []) if k not in value]
        if missing:
            return f"{at}: lacks {missing[0]}"
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        for key in sorted(value):
            if key not in known and more is False:
                return f"{at}: {key} is unknown"
            found = problem(value[key], known.get(key, more if isinstance(more, dict) else {}), f"{at}.{key}")
            if found:
                return found
    return None


def _is(value: Any, name: str) -> bool:
    if isinstance(value, bool):
        return name == "boolean"
    if name == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, _KINDS.get(name, ()))


def canonical(value: Any) -> str:
    """JSON with sorted keys and no white space; equal values give equal text, so a whole number is
    written without a fraction, however it came. Not for values that ``flaw`` finds."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _plain(value: Any) -> Any:
    if isinstance(value, float):
        return int(value) if value.is_integer() else value
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def flaw(value: Any) -> str | None:
    """Why a value can't be handled: too deep, a number that isn't finite, text that isn't Unicode."""
    todo = [(value, 1)]
    while todo:
        own, depth = todo.pop()
        if depth > MAX_DEPTH:
            return f"$: deeper than {MAX_DEPTH}"
        if isinstance(own, float) and not isfinite(own):
            return "$: a number out of range"
        if isinstance(own, str) and any("\ud800" <= c <= "\udfff" for c in own):
            return "$: not Unicode"
        if isinstance(own, dict):
            todo += [(x, depth + 1) for pair in own.items() for x in pair]
        elif isinstance(own, list):
            todo += [(x, depth + 1) for x in own]
    return None


def check_schema(schema: dict) -> None:
    """Fails on a keyword that ``problem`` doesn't know, at any depth: else it would pass what it can't judge."""
    unknown = set(schema) - KEYWORDS
    if unknown:
        raise ValueError(f"schema keywords that aren't known: {sorted(unknown)}")
    for part in (*schema.get("properties", {}).values(), schema.get("items"), schema.get("additionalProperties")):
        if isinstance(part, dict):
            check_schema(part)


def _references(value: Any) -> set[str]:
    if isinstance(value, dict):
        if set(value) == {REFERENCE}:
            return {str(value[REFERENCE])}
        return set().union(*(_references(x) for x in value.values()))
    return set().union(*(_references(x) for x in value)) if isinstance(value, list) else set()


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _read_arguments(schemas: dict[str, dict]):
    """Column function: arguments as ``struct<wanted: array<string>, problem: string, written: string>``.

    What isn't JSON, or has a ``flaw``, is written as one string: the arguments as they came."""
    for schema in schemas.values():
        check_schema(schema)

    @F.arrow_udf("wanted array<string>, problem string, written string")
    def read(names: pa.Array, arguments: pa.Array) -> pa.Array:
        rows = []
        for name, text in zip(names.to_pylist(), arguments.to_pylist(), strict=True):
            try:
                value = json.loads(text or "", parse_constant=_no_constant)
                wrong = flaw(value)
            except (ValueError, RecursionError):
                wrong = "$: not JSON"
            if wrong:
                rows.append({"wanted": [], "problem": wrong, "written": canonical(text)})
                continue
            wrong = problem(value, schemas[name]) if name in schemas else f"{name}: unknown tool"
            rows.append({"wanted": sorted(_references(value)), "problem": wrong, "written": canonical(value)})
        kind = pa.struct({"wanted": pa.list_(pa.string()), "problem": pa.string(), "written": pa.string()})
        return pa.array(rows, kind)

    return read


def _first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("n", rank).filter("n = 1").drop("n")


def levels_of(turns: dict, needs: list[tuple]) -> dict:
    """``late, level`` of each call from its turn and the ties ``(call, needed)``: the turn it can be made in,
    and how many calls must go before it one after another. Calls in or after a circle are left out."""
    waits, holds = dict.fromkeys(turns, 0), {}
    for call, needed in set(needs):
        waits[call] += 1
        holds.setdefault(needed, []).append(call)
    late, level = dict(turns), dict.fromkeys(turns, 0)
    free, done = [c for c, n in waits.items() if not n], {}
    while free:
        call = free.pop()
        done[call] = (late[call], level[call])
        for other in holds.get(call, ()):
            level[other] = max(level[other], level[call] + 1)
            if late[call] is not None and (late[other] is None or late[other] < late[call]):
                late[other] = late[call]
            waits[other] -= 1
            if not waits[other]:
                free.append(other)
    return done


def _levels(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, late, level`` of ``levels_of`` for the ties ``conv_id, call_id, needs``.

    A conversation's ties are ordered in one call, up to ``GROUPED_TIES``; a larger one in rounds."""
    kind = calls.schema["conv_id"].dataType.simpleString()
    turns = calls.select("conv_id", "call_id", F.lit(None).cast("string").alias("needs"), "turn")
    size = edges.groupBy("conv_id").agg(F.count("*").alias("ties"))
    sized = materialise(edges.distinct().join(size, "conv_id"), "edges")
    small = sized.filter(F.col("ties") <= GROUPED_TIES).drop("ties")
    large = sized.filter(F.col("ties") > GROUPED_TIES).drop("ties")

    def order(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = {r["call_id"]: r["turn"] for r in rows if r["needs"] is None}
        done = levels_of(own, [(r["call_id"], r["needs"]) for r in rows if r["needs"] is not None])
        found = [{"conv_id": rows[0]["conv_id"], "call_id": c, "late": late, "level": level} for c, (late, level) in done.items()]
        return pa.Table.from_pylist(found, pa.schema([("conv_id", table.schema.field("conv_id").type), ("call_id", pa.string()), ("late", pa.int64()), ("level", pa.int32())]))

    ends = small.select("conv_id", "call_id").union(small.select("conv_id", F.col("needs").alias("call_id"))).distinct()
    nodes = turns.join(ends, ["conv_id", "call_id"], "left_semi")
    both = nodes.unionByName(small.withColumn("turn", F.lit(None).cast("bigint")))
    done = materialise(both.groupBy("conv_id").applyInArrow(order, f"conv_id {kind}, call_id string, late bigint, level int"), "levels")
    return done if large.isEmpty() else done.unionByName(_rounds(large, calls))


def _rounds(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, late, level``: the turn each call of the edges can be made in, and the
    number of calls that must go before it one after another. Calls in or after a circle get no row.

    ``edges`` has ``conv_id, call_id, needs``; a round takes away the calls that need nothing more.
    """
    ends = edges.select("conv_id", "call_id").union(edges.select("conv_id", F.col("needs").alias("call_id"))).distinct()
    open_ = materialise(ends.join(calls.select("conv_id", "call_id", "turn"), ["conv_id", "call_id"]).withColumnRenamed("turn", "late"), "calls-open")
    edges, done, level = materialise(edges.distinct(), "edges"), None, 0
    while True:
        free = materialise(
            open_.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)), "calls-free"
        )
        if free.isEmpty():
            return done if done is not None else free
        done = free if done is None else done.unionByName(free)
        met = edges.join(free.select("conv_id", F.col("call_id").alias("needs"), F.col("late").alias("at")), ["conv_id", "needs"])
        latest = met.groupBy("conv_id", "call_id").agg(F.max("at").alias("at"))
        waiting = open_.join(free, ["conv_id", "call_id"], "left_anti").join(latest, ["conv_id", "call_id"], "left")
        open_ = materialise(waiting.select("conv_id", "call_id", F.greatest("late", "at").alias("late")), "calls-open")
        left = edges.join(free.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti")
        edges, level = materialise(left.select("conv_id", "call_id", "needs"), "edges"), level + 1


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``conv_id, position, kind, call_id, status, json``, a row per message, call and result.

    ``messages``: ``conv_id, turn, role, text``; ``calls``: ``conv_id, turn, call_id, name, arguments``;
    ``results``: ``conv_id, call_id, content``; other columns are not looked at. ``schemas`` has the
    JSON schema of each tool. ``position`` counts from 0 in each conversation: by turn, a turn's message
    before its calls, a call after all whose results it names, a result right after its call.

    ``status`` of a call: ``ok``, ``invalid`` (not JSON, against the schema, or an unknown tool),
    ``no_result``, ``repeated`` (another call has its id: the earliest counts, then the least by name
    and arguments), ``no_id``, ``circular`` (it waits for itself). Of several results of a call the
    least by content counts. A result without a call, or without an id, is ``orphan`` and comes last.
    A reference to a call that isn't there is no tie. Messages are ``ok``. Rows without ``conv_id`` are
    left out; a null turn comes first, null text is written as null; repeated rows are rows.
    """
    read = _read_arguments(schemas)
    parsed = calls.filter("conv_id IS NOT NULL").select("conv_id", "turn", "call_id", "name", read("name", "arguments").alias("a"))
    parsed = materialise(parsed.select("conv_id", "turn", "call_id", "name", "a.*"), "calls")
    kept = _first(parsed.filter("call_id IS NOT NULL"), ["conv_id", "call_id"], ["turn", "name", "written"])
    kept = materialise(kept, "calls-kept")
    answers = results.filter("conv_id IS NOT NULL").select("conv_id", "call_id", "content")
    answers = materialise(_first(answers.filter("call_id IS NOT NULL"), ["conv_id", "call_id"], ["content"]).unionByName(answers.filter("call_id IS NULL")), "answers")

    ties = kept.select("conv_id", "call_id", F.col("turn").alias("own"), F.explode("wanted").alias("needs"))
    of = kept.select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("needed"))
    edges = ties.join(of, ["conv_id", "needs"]).select("conv_id", "call_id", "needs", "own", "needed")
    edges = materialise(edges, "ties")
    odd = edges.filter("coalesce(needed, -1) > coalesce(own, -1)").select("conv_id").distinct()
    hard = edges.filter("needed <=> own").unionByName(edges.join(odd, "conv_id", "left_semi"))
    hard = materialise(hard.select("conv_id", "call_id", "needs").distinct(), "ties-hard")
    level = _levels(hard, kept)
    tied = hard.select("conv_id", "call_id").union(hard.select("conv_id", F.col("needs").alias("call_id"))).distinct()

    linked = (
        kept.join(answers.filter("call_id IS NOT NULL").withColumn("answered", F.lit(True)), ["conv_id", "call_id"], "left")
        .join(level, ["conv_id", "call_id"], "left")
        .join(tied.withColumn("tied", F.lit(True)), ["conv_id", "call_id"], "left")
    )
    status = (
        F.when(F.col("tied") & F.col("level").isNull(), "circular")
        .when(F.col("problem").isNotNull(), "invalid")
        .when(F.col("answered").isNull(), "no_result")
        .otherwise("ok")
    )
    order = [F.coalesce("late", "turn").alias("late"), F.coalesce("level", F.lit(0)).alias("level")]
    linked = materialise(linked.withColumn("status", status).select("conv_id", "turn", "call_id", "name", "written", "problem", "content", "answered", "status", *order), "linked")
    spare = parsed.filter("call_id IS NULL").withColumn("status", F.lit("no_id")).unionByName(
        _later(parsed.filter("call_id IS NOT NULL")).withColumn("status", F.lit("repeated"))
    )
    spare = spare.select("conv_id", "turn", "call_id", "name", "written", "problem", F.lit(None).cast("string").alias("content"),
                         F.lit(None).cast("boolean").alias("answered"), "status", F.col("turn").alias("late"), F.lit(0).alias("level"))
    made = linked.unionByName(spare)
    orphans = answers.join(linked.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    none = F.lit(None).cast("string")
    rows = (
        messages.filter("conv_id IS NOT NULL")
        .select("conv_id", F.col("turn").alias("late"), F.lit(0).alias("step"), F.lit(0).alias("level"), none.alias("call_id"), F.lit(0).alias("part"),
                F.lit("message").alias("kind"), F.lit("ok").alias("status"), _json(role="role", text="text").alias("json"))
        .unionByName(made.select("conv_id", "late", F.lit(1).alias("step"), "level", "call_id", F.lit(0).alias("part"), F.lit("call").alias("kind"), "status",
                                 _json(raw="written", call_id="call_id", name="name", problem="problem").alias("json")))
        .unionByName(made.filter("answered").select("conv_id", "late", F.lit(1).alias("step"), "level", "call_id", F.lit(1).alias("part"), F.lit("result").alias("kind"),
                                                    F.lit("ok").alias("status"), _json(call_id="call_id", content="content").alias("json")))
        .unionByName(orphans.select("conv_id", F.lit(None).cast("bigint").alias("late"), F.lit(2).alias("step"), F.lit(0).alias("level"), "call_id", F.lit(1).alias("part"),
                                    F.lit("result").alias("kind"), F.lit("orphan").alias("status"), _json(call_id="call_id", content="content").alias("json")))
    )
    # A null turn goes first, an orphan last.
    place = F.when(F.col("step") == 2, F.lit((1 << 62))).otherwise(F.coalesce("late", F.lit(-(1 << 62))).cast("bigint"))
    bucket = F.floor(F.col("place") / TURNS_PER_BUCKET)
    ordered = dense_ordinal(rows.withColumn("place", place), ["conv_id"], bucket, ["place", "step", "level", "call_id", "part", "json"], out="position")
    return ordered.select("conv_id", F.col("position").cast("bigint").alias("position"), "kind", "call_id", "status", "json")


def _later(rows: DataFrame) -> DataFrame:
    """Rows that ``_first`` leaves out."""
    rank = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn", "name", "written"))
    return rows.withColumn("n", rank).filter("n > 1").drop("n")


def _json(raw: str | None = None, **columns: str) -> Column:
    """Canonical JSON of the columns; ``raw`` holds JSON already and becomes ``arguments``."""
    names = sorted([*columns, *(["arguments"] if raw else [])])

    @F.arrow_udf(StringType())
    def write(*arrays: pa.Array) -> pa.Array:
        out = []
        for values in zip(*(a.to_pylist() for a in arrays), strict=True):
            fields = [json.dumps(k) + ":" + (v if k == "arguments" else canonical(v)) for k, v in zip(names, values, strict=True)]
            out.append("{" + ",".join(fields) + "}")
        return pa.array(out, pa.string())

    return write(*[raw if k == "arguments" else columns[k] for k in names])
