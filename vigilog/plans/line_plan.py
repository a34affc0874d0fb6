"""The whole detection job over parsed, labelled lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import evaluation, forest, fusion
from ..operators.line_features import COMBINED_FEATURES, combined_features
from ..operators.line_rules import evaluate_rules
from ..sources.shared import materialise


@dataclass(frozen=True)
class LineDetection:
    """Results as tables. ``scored`` and ``rule_alerts`` are written; the rest is derived."""

    model: forest.Model
    scored: DataFrame
    rule_alerts: DataFrame
    hybrid_alerts: DataFrame
    metrics: DataFrame
    ablation: DataFrame


def score_lines(
    featured: DataFrame, trees: int = fv.LINE_TREES
) -> tuple[forest.Model, DataFrame]:
    """Fit on normal lines, score all: adds ``anomaly_score`` and ``if_pred``.

    Features are read four times and should be written. Raw scores are written out before their minimum, maximum
    and quantile are taken.
    """
    share = evaluation.line_contamination(featured).first()["contamination"]
    model = forest.fit(featured, COMBINED_FEATURES, ["line_key"], trees=trees)
    raw = materialise(forest.score(featured, model).drop(*COMBINED_FEATURES), "line-scores")
    cut = evaluation.exact_quantile(raw.filter("label = 0"), "raw_score", share)
    flagged = evaluation.flag_outliers(raw, "raw_score", cut)
    return model, fusion.normalise_scores(flagged)


def detect_lines(labelled: DataFrame, trees: int = fv.LINE_TREES) -> LineDetection:
    """Features, forest, rules, fusion and metrics for one labelled table of parsed lines.

    Lines are written once, with their features, since forest, rules and alerts all read them. Before, the activity of
    addresses is counted over ``labelled``, which is hence read twice: parsed lines should be written, as the
    sources do.
    """
    lines = materialise(combined_features(labelled), "line-features")
    model, scored = score_lines(lines, trees)
    alerts = materialise(evaluate_rules(lines.drop(*COMBINED_FEATURES)), "rule-alerts")
    predicted = fusion.rule_predictions(scored, alerts)
    return LineDetection(
        model=model,
        scored=scored,
        rule_alerts=alerts,
        hybrid_alerts=fusion.hybrid_alerts(scored, alerts),
        metrics=evaluation.confusion_metrics(scored.withColumn("pred", F.col("if_pred"))),
        ablation=evaluation.ablation_lines(predicted),
    )
