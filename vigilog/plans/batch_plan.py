"""Verdicts over batches of raw lines whose format nobody names."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.forest import Model, score
from ..operators.fusion import normalise_scores
from ..operators.importance import permutation_importance, top_features_by
from ..operators.line_features import COMBINED_FEATURES, combined_features
from ..operators.line_rules import evaluate_rules
from ..operators.lookup import count_keys, lookup
from ..operators.parsing import parse_source
from ..operators.reports import batch_verdict
from ..sources.shared import materialise, new_path
from ..sources.text_lines import detect_log_type

SOURCES = ("ssh", "hdfs", "apache", "linux")


@dataclass(frozen=True)
class BatchJudgement:
    """``verdicts``: one row per batch. ``alerts``: all rule alerts. ``importance``: features by batch and rank."""

    verdicts: DataFrame
    alerts: DataFrame
    importance: DataFrame


def parse_batches(lines: DataFrame) -> DataFrame:
    """Lines (``batch``, ``line_key``, ``raw``) parsed in the format of their batch, kept as ``log_type``.

    A batch's format is that of its first ten lines. Typed lines are written in one folder per format, so
    each parser reads its own lines only. Blank lines are dropped after the format is known; null lines
    are blank, and lines without a batch are the batch ''.
    """
    own = lines.select(
        F.coalesce("batch", F.lit("")).alias("batch"), "line_key", F.coalesce("raw", F.lit("")).alias("raw")
    )
    stored = materialise(own, "batch-lines")
    types = detect_log_type(stored, "batch", ["line_key"]).join(count_keys(stored, "batch", "__lines"), "batch")
    typed = lookup(stored, types, "batch", weight="__lines").filter("raw <> ''").drop("__lines")
    path = new_path(lines.sparkSession, "typed-lines")
    typed.write.partitionBy("log_type").parquet(path)
    typed = lines.sparkSession.read.schema(typed.schema).parquet(path)
    return reduce(DataFrame.unionByName, [parse_source(typed.filter(F.col("log_type") == s), s) for s in SOURCES])


def judge_batches(lines: DataFrame, model: Model) -> BatchJudgement:
    """Judge every batch by its own lines: all rules, anomaly scores scaled inside the batch, their fusion.

    A batch whose threat score passes ``EXPLAIN_CUT`` is explained by the features that move its mean score
    most when they are shuffled inside the batch, as many as ``EXPLAIN_FEATURES``; others have no ``top_feature``.
    ``line_key`` is a number or a text, different for each line. A batch of blank lines has no verdict.
    """
    parsed = materialise(parse_batches(lines), "batch-parsed")
    alerts = materialise(evaluate_rules(parsed, by=["batch"]), "batch-alerts")
    raw = score(combined_features(parsed, by="batch"), model)
    raw = materialise(raw.select("batch", "log_type", "line_key", *COMBINED_FEATURES, "raw_score"), "batch-scores")
    verdicts = batch_verdict(normalise_scores(raw, by=("batch",)), alerts)
    types = raw.groupBy("batch").agg(F.first("log_type").alias("log_type"))
    verdicts = materialise(verdicts.join(types, "batch"), "batch-verdicts")
    explained = verdicts.filter(F.col("threat_score") > fv.EXPLAIN_CUT).select("batch")
    shuffled = permutation_importance(raw.join(explained, "batch", "left_semi"), model, ["line_key"], by="batch")
    importance = materialise(top_features_by(shuffled, "batch", fv.EXPLAIN_FEATURES), "batch-importance")
    first = importance.filter("rank = 1").select("batch", F.col("feature").alias("top_feature"))
    return BatchJudgement(verdicts.join(first, "batch", "left"), alerts, importance)
