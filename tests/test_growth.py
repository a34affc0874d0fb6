"""Plans that must not depend on how well a table is compressed, and what they must still give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilog.functions.text import drop_invalid_bytes, strip
from vigilog.operators import forest, line_features, line_rules, lookup, parsing
from vigilog.operators.fusion import normalise_scores
from vigilog.operators.reports import batch_verdict


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_scores_of_batches_are_never_broadcast(spark, tmp_path):
    """Repeated scores make a tiny file of many rows."""
    scores = spark.range(200_000).select(F.concat(F.lit("b"), F.col("id") % 4).alias("batch"), (-(F.col("id") % 8) / 10).alias("raw_score"))
    scores.write.parquet(str(tmp_path / "scores"))
    scored = normalise_scores(spark.read.parquet(str(tmp_path / "scores")), by=("batch",))
    assert "BuildLeft" not in plan_of(scored)
    found = {r["batch"]: (r["low"], r["high"], r["n"]) for r in scored.groupBy("batch").agg(
        F.min("anomaly_score").alias("low"), F.max("anomaly_score").alias("high"), F.count("*").alias("n")).collect()}
    assert found == {f"b{n}": (0.0, 1.0, 50_000) for n in range(4)}


def test_rows_without_a_batch_go(spark):
    scores = spark.createDataFrame([("a", -0.5), ("a", -0.25), (None, -0.9)], "batch string, raw_score double")
    assert sorted(r["anomaly_score"] for r in normalise_scores(scores, by=("batch",)).collect()) == [0.0, 1.0]


def test_verdicts_sort_no_scores(spark):
    scored = spark.createDataFrame([("a", "ssh", 0.25), ("a", "ssh", 0.75), ("b", "hdfs", 1.0)], "batch string, log_type string, anomaly_score double")
    alerts = spark.createDataFrame([("a", 0.5)], "batch string, rule_score double")
    found = {r["batch"]: r for r in batch_verdict(scored, alerts).collect()}
    assert (found["a"]["events"], found["a"]["anomaly_score"], found["a"]["rule_hits"]) == (2, 0.5, 1)
    assert (found["b"]["events"], found["b"]["anomaly_score"], found["b"]["rule_hits"]) == (1, 1.0, 0)


def test_long_projections_are_compiled(spark):
    """The JVM compiles no method of more than 8000 bytes; a session that sets nothing allows 65,535."""
    from vigilog.operators.line_features import line_features
    from vigilog.operators.parsing import parse_ssh

    name = "spark.sql.codegen.hugeMethodLimit"
    own = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        spark.conf.set(name, "65535")
        lines = parse_ssh(spark.createDataFrame([(1, "Dec 10 06:55:46 h sshd[1]: Failed password for root from 173.234.31.186 port 22 ssh2")], "line_key bigint, raw string"))
        row = line_features(lines).first()
        assert (row["is_failed_pw"], row["is_brute_signal"], row["is_root_user"]) == (1, 1, 1)
        assert spark.conf.get(name) == "8000"
        spark.conf.set(name, "4000")
        line_features(lines)
        assert spark.conf.get(name) == "4000"
    finally:
        spark.conf.set(name, own)


def made_facts(spark):
    """A frequent key, rare ones, an unknown one, rows without a key."""
    facts = spark.range(3000).select(
        F.col("id").alias("line_key"),
        F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
    )
    dim = spark.createDataFrame([("hot", 1), *[(f"k{n}", n) for n in range(30)]], "k string, v int")
    return facts, dim


@pytest.mark.parametrize("limits", [{}, {"SENT_ROWS": 3}, {"SENT_BYTES": 10}])
def test_lookup_gives_the_same_on_both_ways(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lookup, name, value)
    facts, dim = made_facts(spark)
    found = lookup.lookup(facts, dim, "k")
    assert ("SortMergeJoin" in plan_of(found)) == bool(limits)
    wanted = facts.join(dim, "k", "left").select("line_key", "k", "v")
    assert sorted(found.select("line_key", "k", "v").collect(), key=str) == sorted(wanted.collect(), key=str)


def test_facts_of_a_small_table_are_not_shuffled(spark):
    """Whatever size the planner gives to an aggregate."""
    facts, dim = made_facts(spark)
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_of(lookup.lookup(facts, dim, "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("settings", [{}, {"KNOWN_ROWS": 5}, {"KNOWN_ROWS": 1}, {"WALKED": 1}])
def test_a_task_walks_a_row_once(monkeypatch, settings):
    """Scores are those of each row alone, and rows that were seen in an earlier batch are not walked again."""
    for name, value in settings.items():
        monkeypatch.setattr(forest, name, value)
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 3, (40, 4)).astype(float)
    build = forest._tree_builder(list("abcd"), 1)
    trees = []
    for tree in range(7):
        sample = pd.DataFrame(pool[rng.integers(0, 40, 20)], columns=list("abcd"))
        trees.append(build(sample.assign(rank=range(20), fold=0, tree=tree)))
    nodes = type("Nodes", (), {"toPandas": lambda _: pd.concat(trees)})()
    alone = [forest.scorer(nodes)(0, row[None])[0] for row in pool]
    score = forest.scorer(nodes)
    for _ in range(3):
        at = rng.integers(0, 40, 100)
        assert score(0, pool[at]).tolist() == [alone[i] for i in at]
    assert score(0, pool[:0]).tolist() == []
    if not settings:
        score(0, pool)
        took = []
        monkeypatch.setattr(np, "exp2", lambda x: took.append(len(x)) or x)
        score(0, pool)
        assert not took


def test_rows_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(forest, "_row_hashes", lambda bits: np.zeros(len(bits), np.uint64))
    x = np.array([[1.0, 2.0], [2.0, 1.0], [1.0, 2.0]])
    rows, back = forest.distinct_rows(x)
    assert (rows[back] == x).all() and len(rows) == 2
    known = forest.Known()
    for _ in range(2):
        assert known.scores(rows, lambda new: new.sum(axis=1) + new[:, 0]).tolist() == (rows.sum(axis=1) + rows[:, 0]).tolist()


def test_a_line_is_taken_apart_by_one_run_of_a_pattern(spark):
    lines = spark.createDataFrame([(0, "Jun 1 10:00:00 h sshd[1]: Failed password for root from 1.2.3.4 port 1"),
                                   (1, "Jun 1 10:00:00 h sshd[1]: error: Failed password for nobody"),
                                   (2, "Failed password for a line of no form"), (3, None), (4, "")], "line_key bigint, raw string")
    found = {r["line_key"]: (r["event_type"], r["ip"]) for r in parsing.parse_ssh(lines).collect()}
    # The literal of one pattern and the form of another: the patterns are tried in order.
    assert found == {0: ("failed_password", "1.2.3.4"), 1: ("ssh_error", None), 2: ("unknown", None), 3: ("unknown", None), 4: ("unknown", None)}
    for parse in (parsing.parse_hdfs, parsing.parse_apache):
        assert "RLIKE" not in plan_of(parse(lines)).upper()


def test_lines_that_fire_no_rule_go_before_alerts_are_made(spark):
    lines = parsing.parse_apache(spark.createDataFrame([(0, '1.2.3.4 - - [t] "GET /../x HTTP/1.1" 200 1'), (1, "[t] [error] x")], "line_key bigint, raw string"))
    alerts = line_rules.evaluate_rules(lines, ["HTTP-003"])
    assert [r["first_key"] for r in alerts.collect()] == [0]
    optimized = alerts._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in optimized[optimized.index("Generate") :].split("Generate")[1]


def test_features_are_written_without_texts(spark):
    lines = parsing.parse_hdfs(spark.createDataFrame([(0, "malformed")], "line_key bigint, raw string"))
    featured = line_features.written_features(lines, ["line_key"])
    assert [tuple(r) for r in featured.select("line_key", "is_hdfs", "is_unknown", "ip_total_count").collect()] == [(0, 1, 1, 0)]
    written = spark.read.parquet(*[f for f in featured.inputFiles() if "line-features" in f]).columns
    assert set(written) == {"line_key", "ip", "event_type", *line_features.LINE_FEATURES}


def test_white_space_and_bad_bytes_are_dropped_without_patterns(spark):
    spaces = "".join(c for c in map(chr, range(0x3100)) if c.isspace() and not 0x1C <= ord(c) <= 0x1F)
    rows = spark.createDataFrame([(f"{spaces}a{spaces}b{spaces}".encode(),), (spaces.encode(),), (b"x\xff y\xef\xbf\xbd",), (b"",), (None,)], "b binary")
    text = F.col("b").cast("string")
    found = [r["t"] for r in rows.select(strip(drop_invalid_bytes(text)).alias("t")).collect()]
    assert found == [f"a{spaces}b", "", "x y", "", None]
    assert "regexp" not in plan_of(rows.select(strip(text).alias("t"))).lower()
