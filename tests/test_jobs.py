"""Whole jobs and streams."""

import glob

from pyspark.sql import functions as F

from queryset import QUERIES, logs
from vigilog.operators import forest
from vigilog.operators.line_features import COMBINED_FEATURES, combined_features
from vigilog.plans import line_plan, session_plan
from vigilog.sources.shared import shared_dir, workspace
from vigilog.streaming.verdict import judge_lines, read_log_stream, start_verdicts


def test_session_job(spark, sf_dir):
    found = session_plan.detect_sessions(
        session_plan.HDFS, logs.hdfs_lines(spark, sf_dir), logs.block_labels(spark, sf_dir), trees=20
    )
    rows = found.ablation.collect()
    assert [r["method"] for r in rows] == ["Rule Only", "Isolation Forest Only", "Hybrid (Rule + IF)"]
    total = found.scored.count()
    assert all(r["tp"] + r["fp"] + r["tn"] + r["fn"] == total for r in rows)
    low, high = found.scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert high == 1.0 and 0.0 <= low < 1e-6


def test_line_job(spark, sf_dir):
    found = line_plan.detect_lines(logs.all_logs(spark, sf_dir), trees=20)
    metrics = found.metrics.first()
    assert metrics["total_samples"] == found.scored.count()
    assert found.ablation.count() == 3
    alerts = found.hybrid_alerts
    assert alerts.filter("detection_method = 'Rule + AI'").count() == found.rule_alerts.count()


def test_stream_gives_the_verdicts_of_the_batch_job(spark, sf_dir, tmp_path):
    lines = logs.labelled(spark, sf_dir, "ssh")
    model = forest.fit(combined_features(lines), COMBINED_FEATURES, ["line_key"], trees=10)
    folder = tmp_path / "in"
    folder.mkdir()
    raws = [r["raw"] for r in lines.select("raw").orderBy("line_key").limit(300).collect()]
    for n in range(3):
        (folder / f"f{n}.log").write_text("\n".join(raws[n * 100:(n + 1) * 100]) + "\n")
    start_verdicts(
        read_log_stream(spark, str(folder)), "ssh", model, str(tmp_path / "out"), str(tmp_path / "state"), once=True
    ).awaitTermination()
    assert not glob.glob(f"{shared_dir(spark).removeprefix('file://')}/vigilog-stream-*")
    streamed = {r["batch"]: r for r in spark.read.parquet(str(tmp_path / "out" / "verdicts")).collect()}
    assert len(streamed) == 3
    batch = spark.createDataFrame(
        [(n, f"f{n // 100}", raw) for n, raw in enumerate(raws)], "line_key bigint, batch string, raw string"
    )
    verdicts, _ = judge_lines(batch, "ssh", model)
    for r in verdicts.collect():
        twin = next(v for k, v in streamed.items() if k.endswith(r["batch"] + ".log"))
        assert (r["events"], r["rule_hits"], r["verdict"]) == (twin["events"], twin["rule_hits"], twin["verdict"])


def test_a_batch_is_judged_by_its_own_lines(spark, sf_dir):
    lines = logs.labelled(spark, sf_dir, "ssh")
    # All lines count as normal, so the model has seen addresses with many and with few lines.
    model = forest.fit(combined_features(lines.withColumn("label", F.lit(0))), COMBINED_FEATURES, ["line_key"], trees=20)
    both = lines.select("line_key", "raw", F.concat(F.lit("b"), F.floor(F.col("line_key") / 300)).alias("batch"))
    both = both.filter("batch IN ('b0', 'b1')")
    with workspace(spark):
        together = {r["batch"]: r for r in judge_lines(both, "ssh", model)[0].collect()}
        for batch, row in together.items():
            alone = judge_lines(both.filter(F.col("batch") == batch), "ssh", model)[0].first()
            assert alone == row
    counts = combined_features(logs.parsing.parse_source(both, "ssh"), by="batch").agg(F.max("ip_total_count")).first()[0]
    assert counts <= 300


def test_queries_without_oracle_give_rows(spark, sf_dir):
    for name in ("iforest_trees", "cross_validate", "permutation_importance"):
        assert QUERIES[name](spark, sf_dir).count() > 0
