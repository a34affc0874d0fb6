"""Chat formatting: order, status, schemas and canonical JSON."""

import json
import random

import pytest

from vigilog.llm import chats
from vigilog.llm.chats import canonical, check_schema, format_chats, problem
from vigilog.llm.queries import QUERIES

SCHEMAS = {"get": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "n": {"type": "integer", "maximum": 9}}}}
MESSAGES = "conv_id bigint, turn bigint, role string, text string"
CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments string"
RESULTS = "conv_id bigint, call_id string, content string"


@pytest.mark.parametrize(
    ("value", "schema", "fits"),
    [
        ({"a": 1}, {"type": "object", "required": ["b"]}, False),
        ({"a": 1}, {"properties": {"a": {"type": "string"}}}, False),
        ({"a": 1}, {"properties": {}, "additionalProperties": False}, False),
        ({"a": {"$result": "x"}}, {"properties": {"a": {"type": "string"}}}, True),
        ([1, 2.0, "x"], {"items": {"type": ["integer", "string"]}}, True),
        ([1, 2.5], {"items": {"type": "integer"}}, False),
        (True, {"type": "integer"}, False),
        ("abc", {"pattern": "^b"}, False),
        (5, {"enum": [1, 5], "minimum": 5}, True),
        (None, {"type": "null"}, True),
        (3, {"const": 4}, False),
    ],
)
def test_schemas(value, schema, fits):
    assert (problem(value, schema) is None) == fits


def test_canonical():
    assert canonical({"b": [1, {"z": "é", "a": None}], "a": True}) == '{"a":true,"b":[1,{"a":null,"z":"é"}]}'


def run(spark, messages, calls, results):
    df = format_chats(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)
    rows = sorted(df.collect(), key=lambda r: (r.conv_id, r.position))
    for r in rows:
        assert canonical(json.loads(r.json)) == r.json
    return rows


def get(*needs, **more):
    return json.dumps({"id": {"$result": needs[0]} if needs else "x", **{f"d{i}": {"$result": n} for i, n in enumerate(needs)}, **more})


def test_order_and_status(spark):
    calls = [
        (1, 1, "c", "get", get("b")), (1, 1, "b", "get", get("a")), (1, 1, "a", "get", get()),  # a chain in one turn
        (1, 3, "d", "get", get("e")), (1, 5, "e", "get", get("gone")),  # waits for a later turn
        (1, 7, "x", "get", get("y")), (1, 7, "y", "get", get("x")), (1, 7, "z", "get", get("x")),  # a circle, and what waits for it
        (1, 9, "bad", "get", get(n=10)), (1, 9, "what", "none", "{}"), (1, 9, "not", "get", "{"), (1, 9, None, "get", get()),
        (1, 10, "a", "get", get()), (1, 10, "a", "get", get()), (None, 1, "q", "get", get()), (2, None, "m", None, None),
    ]
    results = [(1, c, f"r{c}") for c in "abcdexyz"] + [(1, "a", "zz"), (1, "lost", "?"), (1, None, "??"), (1, "not", None), (2, "m", "ok")]
    messages = [(1, t, "assistant", None if t == 3 else f"t{t}") for t in (1, 3, 5, 7, 9, 10)] + [(2, 0, "user", "hi"), (None, 0, "user", "no")]
    rows = run(spark, messages, calls, results)
    one = [r for r in rows if r.conv_id == 1]
    assert [r.position for r in one] == list(range(len(one)))
    at = {(r.kind, r.call_id): r.position for r in one if r.call_id and r.status != "repeated"}
    for first, then in [("a", "b"), ("b", "c"), ("e", "d")]:
        assert at[("call", first)] < at[("result", first)] == at[("call", first)] + 1 <= at[("call", then)]
    status = {r.call_id: r.status for r in one if r.kind == "call" and r.status != "repeated"}
    assert status == {**dict.fromkeys("abcde", "ok"), **dict.fromkeys("xyz", "circular"), "bad": "invalid", "what": "invalid", "not": "invalid", None: "no_id"}
    assert sum(r.status == "repeated" for r in one) == 2 and [r.status for r in one[-2:]] == ["orphan", "orphan"]
    assert [json.loads(r.json)["content"] for r in one if r.kind == "result" and r.call_id == "a"] == ["ra"]
    assert [(r.kind, r.status) for r in rows if r.conv_id == 2] == [("call", "invalid"), ("result", "ok"), ("message", "ok")]
    assert {r.conv_id for r in rows} == {1, 2}


def test_empty(spark):
    assert run(spark, [], [], []) == []


def test_query(spark, sf_dir):
    rows = QUERIES["op6_chats"](spark, sf_dir).collect()
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert sum(r.kind == "message" for r in rows) == turns.count()
    at = {(r.conv_id, r.call_id): r.position for r in rows if r.kind == "call"}
    assert at and all(at[(c, "z" + i[1:])] < p for (c, i), p in at.items() if i[0] == "a")
    assert {r.status for r in rows if r.kind == "call"} <= {"ok", "invalid", "no_result"}


def test_arguments_that_json_alone_would_pass(spark):
    """Surrogates, depth, numbers out of range and constants are invalid; equal numbers are written alike."""
    deep = "[" * 1200 + "]" * 1200
    texts = ['{"id": "\\ud800"}', '{"\\udc00": 1}', deep, '{"id": ' + "[" * 150 + "]" * 150 + "}", '{"id": NaN}', '{"id": 1e400}', '{"id": -Infinity}', "[" * 100_000, '{"id": ' + "9" * 5000 + "}"]
    calls = [(1, i, f"c{i}", "get", t) for i, t in enumerate(texts)] + [(2, 0, "x", "free", '{"a": 1.0, "b": [2e0, -0.0, 1.5]}'), (2, 1, "y", "free", '{"b":[2,0,1.5],"a":1}')]
    df = format_chats(spark.createDataFrame([], MESSAGES), spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS | {"free": {}})
    rows = df.collect()
    assert {r.status for r in rows if r.conv_id == 1} == {"invalid"} and sum(r.conv_id == 1 for r in rows) == len(texts)
    written = {json.dumps(json.loads(r.json)["arguments"]) for r in rows if r.conv_id == 2}
    assert len(written) == 1 and all('"arguments":{"a":1,"b":[2,0,1.5]}' in r.json for r in rows if r.conv_id == 2)


def test_unknown_schema_keywords_fail(spark):
    for schema in ({"anyOf": []}, {"properties": {"a": {"uniqueItems": True}}}, {"items": {"items": {"$ref": "x"}}}):
        with pytest.raises(ValueError, match="keywords"):
            check_schema(schema)
    check_schema({"properties": {"anyOf": {"type": "string"}}, "additionalProperties": False, "items": {"enum": [1]}})


def plain_levels(turns, needs):
    """By repeated passes, as long as anything changes."""
    found = {}
    while True:
        new = {c: (t, 0) for c, t in turns.items() if c not in found and all(n in found for k, n in needs if k == c)}
        if not new:
            return found
        for c in new:
            mine = [found[n] for k, n in needs if k == c]
            lates = [x for x in [turns[c], *(m[0] for m in mine)] if x is not None]
            new[c] = (max(lates, default=None), max((m[1] + 1 for m in mine), default=0))
        found.update(new)


def test_order_of_random_graphs(spark, monkeypatch):
    """In one call and in rounds, as by repeated passes, circles and null turns among them."""
    rng = random.Random(2)
    calls, edges, wanted = [], [], set()
    for conv in range(30):
        names = [f"c{i}" for i in range(rng.randrange(1, 12))]
        turns = {n: rng.choice([None, 1, 2, 3]) for n in names}
        needs = {(rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(12))}
        ends = {x for pair in needs for x in pair}
        calls += [(conv, n, t) for n, t in turns.items()]
        edges += [(conv, *pair) for pair in needs]
        wanted |= {(conv, c, *v) for c, v in plain_levels({n: turns[n] for n in ends}, needs).items()}
    made = spark.createDataFrame(calls, "conv_id bigint, call_id string, turn bigint"), spark.createDataFrame(edges, "conv_id bigint, call_id string, needs string")
    for limit in (1000, 5, 0):
        monkeypatch.setattr(chats, "GROUPED_TIES", limit)
        assert {tuple(r) for r in chats._levels(made[1], made[0]).select("conv_id", "call_id", "late", "level").collect()} == wanted


def test_chain_of_a_thousand_calls_takes_few_jobs(spark):
    calls = [(1, 1, f"c{i:04}", "get", get(*([f"c{i + 1:04}"] if i < 999 else []))) for i in range(1000)]
    tracker, group = spark.sparkContext.statusTracker(), "chain"
    spark.sparkContext.setJobGroup(group, group)
    try:
        rows = run(spark, [(1, 0, "user", "go")], calls, [])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.call_id for r in rows if r.kind == "call"] == [f"c{i:04}" for i in reversed(range(1000))]
    assert len(tracker.getJobIdsForGroup(group)) < 100
