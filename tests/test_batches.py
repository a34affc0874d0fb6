"""Batches of raw lines of unknown format: detection, verdicts, explanations."""

import pytest
from pyspark.sql import functions as F

from queryset import logs
from queryset.derived import raw_lines
from vigilog.operators import forest
from vigilog.operators.importance import permutation_importance
from vigilog.operators.line_features import COMBINED_FEATURES, combined_features
from vigilog.plans.batch_plan import judge_batches, parse_batches
from vigilog.sources.shared import materialise, workspace

SCHEMA = "batch string, line_key bigint, raw string"


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    lines = logs.all_logs(spark, sf_dir).withColumn("label", F.lit(0))
    return forest.fit(combined_features(materialise(lines, "labelled")), COMBINED_FEATURES, ["line_key"], trees=20)


def batch_of(spark, sf_dir, kind, name, n, first):
    # A web log is known by an error line among the first ten; line 20 is one.
    lines = raw_lines(spark, sf_dir, kind).filter(f"line_key BETWEEN 15 AND {n + 14}")
    return lines.select(F.lit(name).alias("batch"), (F.col("line_key") + first).alias("line_key"), "raw")


def plain(judgement):
    verdicts = {r["batch"]: r.asDict() for r in judgement.verdicts.collect()}
    told = {(r["batch"], r["rank"]): (r["feature"], round(r["importance"], 9)) for r in judgement.importance.collect()}
    return verdicts, told, judgement.alerts.count()


def test_a_batch_is_judged_alone_in_its_own_format(spark, sf_dir, model):
    parts = [batch_of(spark, sf_dir, kind, f"{kind}!", 150, 1000 * n) for kind, n in logs.PARTS]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    with workspace(spark):
        verdicts, told, alerts = plain(judge_batches(every, model))
        assert {b: v["events"] for b, v in verdicts.items()} == {f"{kind}!": 150 for kind, _ in logs.PARTS}
        assert alerts == sum(v["rule_hits"] for v in verdicts.values())
        for batch, verdict in verdicts.items():
            assert verdict["alpha"] == (0.55 if verdict["log_type"] == "ssh" else 0.4)
            explained = {k for k in told if k[0] == batch}
            assert (verdict["top_feature"] is not None) == (verdict["threat_score"] > 0.1) == bool(explained)
            assert len(explained) in (0, 12)
    assert [verdicts[f"{kind}!"]["log_type"] for kind in ("ssh", "hdfs", "apache")] == ["ssh", "hdfs", "apache"]
    assert all(verdicts[f"{kind}!"]["rule_hits"] > 0 for kind in ("ssh", "apache"))
    for n in (0, 2):
        with workspace(spark):
            own, mine, hits = plain(judge_batches(parts[n], model))
            name = next(iter(own))
            assert own[name] == verdicts[name] and hits == own[name]["rule_hits"]
            assert mine == {k: v for k, v in told.items() if k[0] == name}


def test_odd_batches(spark, sf_dir, model):
    line = "Dec 10 06:55:46 LabSZ sshd[24200]: Invalid user webmaster from 173.234.31.186"
    rows = [("one", 1, line), ("blank", 2, ""), ("blank", 3, None), (None, 4, line), (None, 5, line), ("noise", 6, "?" * 100_000)]
    rows += [("ties", 10 + n, line) for n in range(5)]
    with workspace(spark):
        verdicts, told, _ = plain(judge_batches(spark.createDataFrame(rows, SCHEMA), model))
    # Blank lines have no verdict, lines without a batch are a batch; equal lines have no anomaly and no importance.
    assert {b: v["events"] for b, v in verdicts.items()} == {"one": 1, "": 2, "noise": 1, "ties": 5}
    assert [verdicts[b]["log_type"] for b in ("one", "", "noise", "ties")] == ["ssh", "ssh", "linux", "ssh"]
    assert {v["anomaly_score"] for v in verdicts.values()} == {0.0}
    assert verdicts["ties"]["rule_hits"] == 1 and verdicts["ties"]["threat_score"] > 0.1
    assert {v[1] for k, v in told.items() if k[0] == "ties"} == {0.0}
    assert verdicts["noise"]["verdict"] == "clean" and verdicts["noise"]["top_feature"] is None


def test_no_lines(spark, model):
    with workspace(spark):
        judgement = judge_batches(spark.createDataFrame([], SCHEMA), model)
        assert plain(judgement) == ({}, {}, 0)


def test_importance_of_each_batch(spark, sf_dir, model):
    """Cut into buckets or not, a batch has the importances it has by itself, and they add up to one."""
    lines = [batch_of(spark, sf_dir, kind, kind, 400, 1000 * n) for kind, n in logs.PARTS[::2]]
    rows = materialise(combined_features(parse_batches(lines[0].unionByName(lines[1])), by="batch"), "rows")

    def found(table, **how):
        table = permutation_importance(table, model, ["line_key"], **how)
        return {(r.asDict().get("batch"), r["feature"]): round(r["importance"], 9) for r in table.collect()}

    together = found(rows, by="batch")
    assert found(rows, by="batch", bucket_rows=64) == together
    for kind in ("ssh", "apache"):
        own = found(rows.filter(F.col("batch") == kind))
        assert own == {(None, f): v for (b, f), v in together.items() if b == kind}
        assert abs(sum(own.values()) - 1) < 1e-6
    assert len(together) == 2 * len(COMBINED_FEATURES)
