"""Mixing against its SQL and by hand."""

import re

from oracle_check import difference

from vigilog.llm.mixing import mix
from vigilog.llm.queries import ORACLES, QUERIES


def test_query_against_sql(spark, con, sf_dir):
    assert difference(spark, con, sf_dir, QUERIES["op10_mixing"], ORACLES["op10_mixing"]) is None


def words(n):
    return " ".join(["w"] * n)


def test_targets_and_odd_rows(spark):
    rows = [(i, words(10 + i % 7), f"s{i % 3}", 1) for i in range(60)] + [(100, words(30), None, 1), (101, None, "s0", 1), (None, "a b c", "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    out = mix(df, [5, 2, 1]).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        taken, target = by.get((r.source_size, r.target), (0, r.target))
        by[(r.source_size, r.target)] = (taken + r.taken, target)
    assert all(target - 1 < taken <= target for taken, target in by.values())
    assert abs(sum(t for _, t in by.values()) - 1.5 * total) < 1e-6
    assert [tuple(r) for r in mix(df.repartition(7), [5, 2, 1]).orderBy("doc_id").collect()] == sorted(
        map(tuple, out), key=lambda r: (r[0] is not None, r[0])
    )


def test_repeated_rows_share(spark):
    df = spark.createDataFrame([(1, words(10), "a")] * 40, "doc_id bigint, text string, source string")
    out = mix(df, [5, 2, 1]).collect()
    assert {r.taken for r in out} == {15}
    many = mix(df, [5, 2, 1], keep=["doc_id", "text"]).collect()
    assert {r.times for r in many} <= {1, 2} and len(many) == 40


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in mix(df, [5, 2, 1]).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mix(df.limit(0), [5, 2, 1]).collect() == []


def test_larger_budgets_are_supersets(spark):
    rows = [(i, words(5 + i % 11), f"s{i % 2}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    small = {r.doc_id for r in mix(df, [1], share=0.3, keep=["doc_id"]).collect() if r.times}
    large = {r.doc_id for r in mix(df, [1], share=0.6, keep=["doc_id"]).collect() if r.times}
    assert small < large


def test_texts_are_not_shuffled_by_source(spark):
    """The plan, a row for each source, is sent to the tasks, whatever the session's limit for it."""
    docs = spark.createDataFrame([(i, "w " * 30, f"s{i % 3}") for i in range(50)], "doc_id bigint, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mix(docs, [1, 1], keep=["doc_id", "text"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"\w+Join", plan)[0] == "BroadcastHashJoin"
        assert out.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
