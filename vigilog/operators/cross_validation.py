"""Stratified cross-validation of the hybrid detector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..sources.shared import materialise
from .evaluation import fold_metrics, stratified_folds
from .forest import fit_nodes, fit_scaler, scale, score_column
from .fusion import normalise_scores


def cross_validate(
    sessions: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    alpha: float,
    cut: float,
    folds: int = 5,
    trees: int = fv.SESSION_TREES,
    seed: int = fv.SEED,
) -> DataFrame:
    """Metrics per fold (0-based). A fold is scored by a forest trained on the other folds.

    The forests of all folds are trained in one job and all rows are scored in one pass. The
    fold table and the scores are written out, since both are read twice.
    """
    columns = dict.fromkeys([*key, "label", "rule_score", *features])
    table = materialise(stratified_folds(sessions.select(*columns), key, folds, seed), "folds")
    others = F.filter(
        F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("__own")
    )
    training = (
        table.filter(F.col("label") == 0)
        .withColumnRenamed("fold", "__own")
        .withColumn("fold", F.explode(others))
        .drop("__own")
    )
    scaler = fit_scaler(training, features, by=["fold"])
    scaler = table.sparkSession.createDataFrame(scaler.collect(), scaler.schema)
    nodes = fit_nodes(scale(training, scaler, features), features, key, trees, seed=seed)
    scaled = scale(table, scaler, features)
    scored = scaled.withColumn("raw_score", score_column(nodes, features, F.col("fold"))).select(
        "fold", "label", "rule_score", "raw_score"
    )
    scored = materialise(scored, "fold-scores")
    return fold_metrics(normalise_scores(scored, eps=True, by=("fold",)), alpha, cut)
