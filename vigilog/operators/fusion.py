"""Score normalisation, fusion of rule and anomaly scores, alert tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scoring import fuse_columns, invert_minmax, invert_minmax_eps, severity, threat
from ..functions.text import is_blank
from ..sources.shared import materialise
from .line_rules import ALERT_COLUMNS
from .lookup import lookup

HYBRID_COLUMNS = (
    *ALERT_COLUMNS, "anomaly_score", "threat_score", "alpha", "detection_method",
)
AI_RULE_ORD = len(fv.LINE_RULES)


def normalise_scores(
    scored: DataFrame, raw: str = "raw_score", out: str = "anomaly_score", eps: bool = False,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Scale raw scores (lowest = most anomalous) to [0, 1] over the table, or over each ``by``.

    ``eps`` uses the session form, in which a constant score gives 1 instead of 0. One small
    aggregation is joined back; ``by`` must have few distinct values (folds, batches). It is written, one row
    for each, so that its size is known, and joined from the left: the scores themselves, whose file may be
    a hundredth of what they take in memory, are never the side that is broadcast. Rows without ``by`` go.
    """
    bounds = scored.groupBy(*by).agg(F.min(raw).alias("__low"), F.max(raw).alias("__high"))
    if by:
        bounds = materialise(bounds, "bounds")
        joined = scored.dropna(subset=list(by)).join(bounds, list(by), "left")
    else:
        ends = {c: bounds.select(c).scalar() for c in ("__low", "__high")}
        joined = scored.withColumns(ends)
    invert = invert_minmax_eps if eps else invert_minmax
    score = invert(F.col(raw), F.col("__low"), F.col("__high"))
    return joined.withColumn(out, score).drop("__low", "__high")


def fuse(df: DataFrame, alpha: float | Column = fv.LINE_ALPHA) -> DataFrame:
    """Round and fuse ``rule_score`` and ``anomaly_score``; replaces ``severity`` and ``alpha``."""
    fused = fuse_columns(F.col("rule_score"), F.col("anomaly_score"), alpha)
    names = {"rule_score", "anomaly_score", "threat_score", "severity", "alpha"}
    return df.select(*[c for c in df.columns if c not in names], *fused)


def fuse_sessions(sessions: DataFrame, alpha: float) -> DataFrame:
    """Add the unrounded ``threat_score`` and its ``severity`` to scored sessions."""
    fused = threat(F.col("rule_score"), F.col("anomaly_score"), alpha)
    return sessions.withColumn("threat_score", fused).withColumn(
        "severity", severity(F.col("threat_score"))
    )


def build_alerts(alerts: DataFrame, alpha: float = fv.LINE_ALPHA) -> DataFrame:
    """Rule alerts with their own ``anomaly_score``: fused, with the method that found them."""
    method = F.when(F.col("anomaly_score") > 0.3, "hybrid").otherwise("rule")
    return fuse(alerts.withColumn("detection_method", method), alpha)


def build_ai_alerts(lines: DataFrame, alpha: float = fv.LINE_ALPHA) -> DataFrame:
    """One alert per scored line, for anomalies no rule explains."""
    who = F.when(is_blank(F.col("ip")), "unknown").otherwise(F.col("ip"))
    alerts = lines.select(
        F.col("line_key").alias("first_key"),
        F.lit(fv.AI_RULE[0]).alias("rule_id"),
        F.lit(fv.AI_RULE[1]).alias("rule_name"),
        F.concat(F.lit("Isolation Forest flagged anomalous behavior from "), who).alias("description"),
        who.alias("source_ip"),
        F.lit(1).cast("bigint").alias("count"),
        F.substring("raw", 1, fv.ALERT_SAMPLE_CHARS).alias("sample_raw"),
        F.lit("isolation_forest").alias("detection_method"),
        F.lit(0.0).alias("rule_score"),
        "anomaly_score",
    )
    return fuse(alerts, alpha)


def alerted_ips(alerts: DataFrame) -> DataFrame:
    return alerts.filter(~is_blank(F.col("source_ip"))).select(F.col("source_ip").alias("ip")).distinct()


def rule_predictions(lines: DataFrame, alerts: DataFrame) -> DataFrame:
    """Add ``rule_pred``: 1 for lines whose address has an alert of any rule."""
    hits = alerted_ips(alerts).withColumn("rule_pred", F.lit(1))
    return lookup(lines, hits, "ip").withColumn("rule_pred", F.coalesce("rule_pred", F.lit(0)))


def rule_alerts_fused(alerts: DataFrame, scored: DataFrame) -> DataFrame:
    """Rule alerts fused with the mean anomaly score of all lines."""
    mean = scored.agg(F.avg("anomaly_score").alias("anomaly_score")).scalar()
    joined = alerts.withColumns(
        {"anomaly_score": mean, "detection_method": F.lit("Rule + AI")}
    )
    return fuse(joined).select(*HYBRID_COLUMNS)


def ai_only_alerts(scored: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts for lines the forest flags (``if_pred`` = 1, high score) and no rule covers.

    ``scored`` has ``if_pred`` and ``anomaly_score``. Lines without an address are kept. Lines
    are filtered before the join, so only flagged ones are matched against alerted addresses.
    """
    flagged = scored.filter((F.col("if_pred") == 1) & (F.col("anomaly_score") > fv.AI_ONLY_CUT))
    left = rule_predictions(flagged, alerts).filter(F.col("rule_pred") == 0)
    blank = is_blank(F.col("ip"))
    text = F.format_string(
        "Isolation Forest flagged %s (event=%s, score=%.3f)",
        F.when(blank, "unknown IP").otherwise(F.col("ip")),
        F.col("event_type"),
        F.col("anomaly_score"),
    )
    found = left.select(
        F.lit(AI_RULE_ORD).alias("rule_ord"),
        F.col("line_key").alias("first_key"),
        F.lit(fv.AI_RULE[0]).alias("rule_id"),
        F.lit(fv.AI_RULE[1]).alias("rule_name"),
        text.alias("description"),
        F.when(blank, "unknown").otherwise(F.col("ip")).alias("source_ip"),
        F.lit(1).cast("bigint").alias("count"),
        F.substring("raw", 1, fv.ALERT_SAMPLE_CHARS).alias("sample_raw"),
        F.lit("Isolation Forest").alias("detection_method"),
        F.lit(0.0).alias("rule_score"),
        "anomaly_score",
    )
    return fuse(found).select(*HYBRID_COLUMNS)


def hybrid_alerts(scored: DataFrame, alerts: DataFrame) -> DataFrame:
    """All alerts: those of the rules, then those of the forest alone."""
    return rule_alerts_fused(alerts, scored).unionByName(ai_only_alerts(scored, alerts))


def first_alerts(alerts: DataFrame, n: int = fv.ALERT_HEAD) -> DataFrame:
    """The first alerts in report order (a top-k: no total sort)."""
    return alerts.orderBy("rule_ord", "first_key").limit(n)
