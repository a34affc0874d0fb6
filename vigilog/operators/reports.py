"""Summaries of alerts, data sets, results and pasted batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scoring import fuse_columns
from ..sources.results import metric_rows
from .sessions import rule_column


def dataset_stats(lines: DataFrame) -> DataFrame:
    """Lines, normal and attack lines per source, and over all (``source`` = 'all').

    The total is taken from the per-source rows, so the lines are read once.
    """
    per_source = lines.groupBy("source").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("label") == 0).alias("normal"),
        F.count_if(F.col("label") == 1).alias("attack"),
    )
    counted = per_source.rollup("source").agg(
        *[F.sum(c).alias(c) for c in ("total", "normal", "attack")]
    )
    percent = F.round(F.lit(100) * F.col("attack") / F.greatest("total", F.lit(1)), 2)
    return counted.select(
        F.coalesce("source", F.lit("all")).alias("source"), "total", "normal", "attack",
        percent.alias("attack_pct"),
    )


def count_by(alerts: DataFrame, column: str) -> DataFrame:
    return alerts.groupBy(column).agg(F.count("*").alias("alerts"))


def alert_feed(alerts: DataFrame, severities: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """Alerts of the chosen severities and detection methods."""
    return alerts.filter(
        F.col("severity").isin(*severities) & F.col("detection_method").isin(*methods)
    )


def first_critical(alerts: DataFrame) -> DataFrame:
    """The first critical alert, shown with its raw line."""
    return (
        alerts.filter(F.col("severity") == "CRITICAL").orderBy("rule_ord", "first_key").limit(1)
    )


def threat_histogram(alerts: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width bins between the lowest and the highest threat score: ``bin``, ``alerts``."""
    bounds = alerts.agg(F.min("threat_score").alias("__low"), F.max("threat_score").alias("__high"))
    ends = {c: bounds.select(c).scalar() for c in ("__low", "__high")}
    span = F.col("__high") - F.col("__low")
    place = F.floor((F.col("threat_score") - F.col("__low")) * bins / F.when(span > 0, span))
    number = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1))
    return (
        alerts.withColumns(ends)
        .groupBy(number.alias("bin"))
        .agg(F.count("*").alias("alerts"))
    )


def attack_types(alerts: DataFrame) -> DataFrame:
    """Events per rule name, most first."""
    return (
        alerts.groupBy("rule_name")
        .agg(F.sum("count").alias("events"))
        .orderBy(F.desc("events"), "rule_name")
    )


def distinct_blocks(lines: DataFrame) -> DataFrame:
    """Number of different blocks; lines without one don't count. Two levels, so no task holds a set."""
    return lines.select("block_id").filter("block_id IS NOT NULL").distinct().agg(F.count("*").alias("blocks"))


# --- rule diagnosis ---------------------------------------------------------------------


def first_sessions(sessions: DataFrame, per_label: int = 500) -> DataFrame:
    """The first blocks of each class in block order."""
    normal = sessions.filter("label = 0").orderBy("block_id").limit(per_label)
    anomalous = sessions.filter("label = 1").orderBy("block_id").limit(per_label)
    return normal.unionByName(anomalous)


def rule_diagnosis(sessions: DataFrame) -> DataFrame:
    """How often each rule fires in each class: ``label``, ``rule_id``, ``blocks``, ``share``."""
    totals = sessions.groupBy("label").agg(F.count("*").alias("__all"))
    fired = (
        sessions.select("label", F.explode("rules_hit").alias("rule_id"))
        .groupBy("label", "rule_id")
        .agg(F.count("*").alias("blocks"))
    )
    return fired.join(totals, "label").select(
        "label", "rule_id", "blocks", F.round(F.col("blocks") / F.col("__all") * 100, 1).alias("share")
    )


def evidence_profile(sessions: DataFrame) -> DataFrame:
    """Warnings, exceptions, error ratio and replication per class (of ``hdfs_blocks``)."""
    rules = {r.rule_id: F.col(rule_column(r)) for r in fv.HDFS_RULES if r.pattern}
    warn, io = rules["HDFS-007"], rules["HDFS-003"]
    return sessions.groupBy("label").agg(
        F.count("*").alias("blocks"),
        F.round(F.avg(warn), 2).alias("warn_mean"),
        F.max(warn).alias("warn_max"),
        F.count_if(warn >= 5).alias("warn_5"),
        F.round(F.avg(io), 2).alias("ioex_mean"),
        F.max(io).alias("ioex_max"),
        F.count_if(io >= 1).alias("ioex_1"),
        F.round(F.avg("error_ratio"), 3).alias("error_ratio_mean"),
        F.count_if(F.col("error_ratio") >= 0.5).alias("error_ratio_half"),
        F.round(F.avg("replicate_count"), 2).alias("replicate_mean"),
        F.max("replicate_count").alias("replicate_max"),
        F.count_if(F.col("replicate_count") >= 6).alias("replicate_6"),
    )


def sample_flagged(sessions: DataFrame, lines: DataFrame, n_lines: int = 5, chars: int = 120) -> DataFrame:
    """The first flagged block of each class with its first lines: one row per line.

    One block per class is chosen by an aggregation, its lines are filtered by a join with
    those few rows, and a top-k keeps the first lines of each.
    """
    chosen = (
        sessions.filter(F.col("rule_score") > 0)
        .groupBy("label")
        .agg(F.min("block_id").alias("block_id"))
    )
    mine = lines.select("block_id", "line_key", "content").join(F.broadcast(chosen), "block_id")
    parts = [
        mine.filter(F.col("label") == label).orderBy("line_key").limit(n_lines) for label in (0, 1)
    ]
    return parts[0].unionByName(parts[1]).select(
        "label", "block_id", "line_key", F.substring("content", 1, chars).alias("content")
    )


# --- results ----------------------------------------------------------------------------


def result_comparison(metrics: DataFrame) -> DataFrame:
    """One row per data set: F1 of each method, all metrics of the hybrid.

    Takes rows ``dataset``, ``total``, ``latency``, ``method``, ``precision``, ``recall``,
    ``f1``, ``fpr``. Methods are told apart by their names.
    """
    name = F.lower("method")
    rule = ~name.contains("hybrid") & name.contains("rule")
    forest, hybrid = name.contains("forest"), name.contains("hybrid")

    def of(which: Column, column: str) -> Column:
        return F.max(F.when(which, F.col(column)))

    return metrics.groupBy("dataset").agg(
        F.max("total").alias("samples"),
        of(rule, "f1").alias("rule_f1"),
        of(forest, "f1").alias("if_f1"),
        of(hybrid, "f1").alias("hybrid_f1"),
        of(hybrid, "precision").alias("hybrid_precision"),
        of(hybrid, "recall").alias("hybrid_recall"),
        of(hybrid, "fpr").alias("hybrid_fpr"),
        F.max("latency").alias("latency_ms"),
    )


def comparison_report(documents: DataFrame) -> DataFrame:
    """``result_comparison`` with the F1 of a plain baseline and cross-validation, one row per data set.

    Takes ``read_documents``. Of two documents of a kind for one data set, the later in the catalogue counts.
    ``baseline_f1`` comes from documents of a single method, and ``f1_gain`` is the hybrid's F1 over it. A data
    set that only has some of the documents keeps its row, with nulls for the others.
    """
    # A few rows per catalogue entry, whatever the logs' size.
    order = Window.partitionBy("dataset", "kind").orderBy(F.desc("entry"))
    last = documents.withColumn("place", F.row_number().over(order)).filter("place = 1")
    table = result_comparison(metric_rows(last))
    single = last.filter("kind = 'single'").select("dataset", F.col("f1").alias("baseline_f1"))
    folds = last.filter("kind = 'folds'").select(
        "dataset", *[F.col(c).alias(f"cv_{c}") for c in ("f1_mean", "f1_std", "fpr_mean", "fpr_std")]
    )
    joined = table.join(single, "dataset", "full").join(folds, "dataset", "full")
    return joined.withColumn("f1_gain", F.round(F.col("hybrid_f1") - F.col("baseline_f1"), 4))


# --- batches ----------------------------------------------------------------------------


def batch_verdict(scored: DataFrame, alerts: DataFrame, batch: str = "batch") -> DataFrame:
    """One verdict per batch of lines of one kind.

    ``scored`` has the batch, its ``log_type`` and the anomaly score of each line; ``alerts``
    come from ``evaluate_rules(by=[batch])``. Both are reduced per batch before they meet.
    """
    # Texts are keys here, as rows would be sorted for their maximum.
    kinds = scored.groupBy(batch, "log_type").agg(
        F.count("*").alias("events"), F.sum("anomaly_score").alias("sum"), F.count("anomaly_score").alias("n")
    )
    lines = kinds.groupBy(batch).agg(
        F.sum("events").alias("events"),
        (F.sum("sum") / F.sum("n")).alias("anomaly_score"),
        F.max("log_type").alias("log_type"),
    )
    rules = alerts.groupBy(batch).agg(
        F.max("rule_score").alias("rule_score"), F.count("*").alias("rule_hits")
    )
    joined = lines.join(rules, batch, "left").withColumns(
        {
            "rule_score": F.coalesce("rule_score", F.lit(0.0)),
            "rule_hits": F.coalesce("rule_hits", F.lit(0)),
            "__alpha": F.when(F.col("log_type") == "ssh", fv.LINE_ALPHA).otherwise(fv.HDFS_ALPHA),
        }
    )
    fused = fuse_columns(F.col("rule_score"), F.col("anomaly_score"), F.col("__alpha"))
    verdict = (
        F.when(F.col("rule_hits") > 0, "signatures triggered")
        .when(F.col("threat_score") >= 0.4, "structurally anomalous")
        .otherwise("clean")
    )
    return joined.select(batch, "events", "rule_hits", *fused).withColumn("verdict", verdict)
