"""The whole detection job over sessions: blocks of a file system, windows of a cluster log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions import fixed_values as fv
from ..operators import evaluation, forest, fusion, sessions
from ..operators.labels import label_sessions
from ..sources.shared import materialise


@dataclass(frozen=True)
class SessionKind:
    name: str
    build: Callable[[DataFrame], DataFrame]
    key: tuple[str, ...]
    features: tuple[str, ...]
    alpha: float
    cut: float


HDFS = SessionKind(
    "HDFS_v1", sessions.hdfs_sessions, ("block_id",), sessions.HDFS_FEATURES,
    fv.HDFS_ALPHA, fv.HDFS_THRESHOLD,
)
BGL = SessionKind(
    "BGL", sessions.bgl_sessions, ("node", "win_no"), sessions.BGL_FEATURES,
    fv.CLUSTER_ALPHA, fv.CLUSTER_THRESHOLD,
)
THUNDERBIRD = SessionKind(
    "Thunderbird", sessions.thunderbird_sessions, ("node", "win_no"),
    sessions.THUNDERBIRD_FEATURES, fv.CLUSTER_ALPHA, fv.CLUSTER_THRESHOLD,
)


@dataclass(frozen=True)
class SessionDetection:
    model: forest.Model
    scored: DataFrame
    ablation: DataFrame


def build_sessions(
    kind: SessionKind, lines: DataFrame, labels: DataFrame | None = None
) -> DataFrame:
    """Features, rule results and labels of all sessions, written once for all later steps."""
    table = kind.build(lines)
    if labels is not None:
        table = label_sessions(table, labels, kind.key[0])
    return materialise(table, "sessions")


def detect_sessions(
    kind: SessionKind,
    lines: DataFrame,
    labels: DataFrame | None = None,
    trees: int = fv.SESSION_TREES,
) -> SessionDetection:
    """Fit on normal sessions, score and fuse all, compare the three methods."""
    table = build_sessions(kind, lines, labels)
    model = forest.fit(table, kind.features, kind.key, trees=trees)
    raw = materialise(forest.score(table, model), "session-scores")
    scored = fusion.fuse_sessions(fusion.normalise_scores(raw, eps=True), kind.alpha)
    return SessionDetection(
        model, scored, evaluation.ablation_sessions(scored, kind.alpha, kind.cut)
    )
