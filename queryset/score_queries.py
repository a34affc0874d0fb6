"""Queries over scores: normalisation, fusion, alert tables, reports, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.functions import fixed_values as fv
from vigilog.functions.scoring import severity
from vigilog.operators import evaluation, forest, fusion, line_features, line_rules, reports

from . import logs
from .registry import query
from .sql import BURST, LINE_FLAGS, QUALITY_ROUNDED, cells, fused, num, sql, threat
from .sql import severity as severity_sql

HYBRID_LIST = ", ".join(fusion.HYBRID_COLUMNS)
FEED_SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM")
FEED_METHODS = ("Rule + AI", "Isolation Forest", "rule")


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query(
    "severity_bands",
    f"""SELECT event_id, value / (SELECT max(value) FROM events) AS score,
      {severity_sql("value / (SELECT max(value) FROM events)")} AS severity FROM events""",
)
def severity_bands(spark, sf_dir):
    events = _events(spark, sf_dir)
    top = events.agg(F.max("value").alias("top"))
    scored = events.crossJoin(F.broadcast(top)).withColumn("score", F.col("value") / F.col("top"))
    return scored.select("event_id", "score", severity(F.col("score")).alias("severity"))


@query(
    "minmax_norm",
    """SELECT event_id, CASE WHEN (SELECT min(value) = max(value) FROM events) THEN 0.0::DOUBLE ELSE
      1.0::DOUBLE - (value - (SELECT min(value) FROM events))
        / (SELECT max(value) - min(value) FROM events) END AS anomaly_score FROM events""",
)
def minmax_norm(spark, sf_dir):
    return fusion.normalise_scores(_events(spark, sf_dir), raw="value").select("event_id", "anomaly_score")


@query(
    "minmax_norm_eps",
    f"""SELECT event_id, 1.0::DOUBLE - (value - (SELECT min(value) FROM events))
        / (SELECT max(value) - min(value) + {num(1e-9)} FROM events) AS anomaly_score FROM events""",
)
def minmax_norm_eps(spark, sf_dir):
    return fusion.normalise_scores(_events(spark, sf_dir), raw="value", eps=True).select(
        "event_id", "anomaly_score"
    )


@query(
    "fuse_scores",
    f"""SELECT event_id, {fused("(user_id % 10) / 10", "value / (SELECT max(value) FROM events)", 0.55)}
    FROM events""",
)
def fuse_scores(spark, sf_dir):
    events = _events(spark, sf_dir)
    top = events.agg(F.max("value").alias("top"))
    scored = events.crossJoin(F.broadcast(top)).select(
        "event_id",
        (F.col("user_id") % 10 / 10).alias("rule_score"),
        (F.col("value") / F.col("top")).alias("anomaly_score"),
    )
    return fusion.fuse(scored)


_SCALES = ", ".join(
    f"round(avg({n}) FILTER (label = 0), 6) AS mean_{n}, round(CASE WHEN stddev_pop({n}) FILTER (label = 0) = 0"
    f" THEN 1.0 ELSE stddev_pop({n}) FILTER (label = 0) END, 6) AS scale_{n}"
    for n in line_features.COMBINED_FEATURES
)


@query(
    "standard_scale",
    sql(
        f"SELECT {_SCALES} FROM (SELECT label, {LINE_FLAGS}, {BURST} FROM all_logs l LEFT JOIN per_ip USING (ip))",
        "per_ip",
    ),
)
def standard_scale(spark, sf_dir):
    """All features of the normal lines of the four logs."""
    names = line_features.COMBINED_FEATURES
    lines = line_features.written_features(logs.all_logs(spark, sf_dir), ["label"])
    scaler = forest.fit_scaler(lines.filter("label = 0"), names)
    of = {n: F.col("feature") == n for n in names}
    return scaler.agg(
        *[F.round(F.max(F.when(of[n], F.col("mean"))), 6).alias(f"mean_{n}") for n in names],
        *[F.round(F.max(F.when(of[n], F.col("scale"))), 6).alias(f"scale_{n}") for n in names],
    )


@query(
    "contamination",
    sql(
        """SELECT round(least(0.5::DOUBLE, round(100 * sum(label) / count(*), 2) / 100 + 0.02::DOUBLE), 6)
        AS contamination FROM all_logs""",
        "all_logs",
    ),
)
def contamination(spark, sf_dir):
    return evaluation.line_contamination(logs.all_logs(spark, sf_dir, logs.LABEL_COLUMNS)).select(
        F.round("contamination", 6).alias("contamination")
    )


@query(
    "contamination_cut",
    """SELECT event_id, CAST(-value < (SELECT quantile_cont(-value, 0.05::DOUBLE) FROM events) AS INTEGER)
    AS if_pred FROM events""",
)
def contamination_cut(spark, sf_dir):
    scored = _events(spark, sf_dir).select("event_id", (-F.col("value")).alias("score"))
    cut = evaluation.exact_quantile(scored, "score", 0.05)
    return evaluation.flag_outliers(scored, "score", cut).select("event_id", "if_pred")


# --- alert tables -----------------------------------------------------------------------
def _scored_and_alerts(spark, sf_dir):
    lines = logs.written_logs(spark, sf_dir)
    # Alerts are read up to three times.
    return logs.stand_in_lines(lines), logs.materialise(line_rules.evaluate_rules(lines), "rule-alerts")


@query(
    "build_alerts",
    sql(
        f"""SELECT rule_ord, first_key, rule_id, rule_name, description, source_ip, count, sample_raw,
          CASE WHEN count / 1000 > 0.3::DOUBLE THEN 'hybrid' ELSE 'rule' END AS detection_method,
          {fused('rule_score', '(count / 1000)', fv.LINE_ALPHA)} FROM alerts""",
        "alerts",
    ),
)
def build_alerts(spark, sf_dir):
    alerts = line_rules.evaluate_rules(logs.written_logs(spark, sf_dir))
    return fusion.build_alerts(alerts.withColumn("anomaly_score", F.col("count") / 1000))


@query(
    "build_ai_alerts",
    sql(
        f"""SELECT line_key AS first_key, 'AI-001' AS rule_id, '{fv.AI_RULE[1]}' AS rule_name,
          'Isolation Forest flagged anomalous behavior from ' || coalesce(ip, 'unknown') AS description,
          coalesce(ip, 'unknown') AS source_ip, CAST(1 AS BIGINT) AS count,
          substring(raw, 1, 120) AS sample_raw, 'isolation_forest' AS detection_method,
          {fused(num(0.0), 'anomaly_score', fv.LINE_ALPHA)} FROM scored WHERE if_pred = 1""",
        "scored",
    ),
)
def build_ai_alerts(spark, sf_dir):
    scored = logs.stand_in_lines(logs.unlabelled_logs(spark, sf_dir))
    return fusion.build_ai_alerts(scored.filter("if_pred = 1"))


@query("rule_alerts_fused", sql(f"SELECT {HYBRID_LIST} FROM fused_alerts", "fused_alerts"))
def rule_alerts_fused(spark, sf_dir):
    scored, alerts = _scored_and_alerts(spark, sf_dir)
    return fusion.rule_alerts_fused(alerts, scored)


@query("ai_only_alerts", sql(f"SELECT {HYBRID_LIST} FROM ai_alerts", "ai_alerts"))
def ai_only_alerts(spark, sf_dir):
    scored, alerts = _scored_and_alerts(spark, sf_dir)
    return fusion.ai_only_alerts(scored, alerts)


@query("hybrid_alerts", sql(f"SELECT {HYBRID_LIST} FROM hybrid", "hybrid"))
def hybrid_alerts(spark, sf_dir):
    scored, alerts = _scored_and_alerts(spark, sf_dir)
    return fusion.hybrid_alerts(scored, alerts)


@query(
    "first_alerts",
    sql(f"SELECT {HYBRID_LIST} FROM hybrid ORDER BY rule_ord, first_key LIMIT 100", "hybrid"),
)
def first_alerts(spark, sf_dir):
    scored, alerts = _scored_and_alerts(spark, sf_dir)
    return fusion.first_alerts(fusion.hybrid_alerts(scored, alerts))


def _report(name: str, oracle: str, build) -> None:
    @query(name, sql(oracle, "hybrid"))
    def run(spark, sf_dir):
        scored, alerts = _scored_and_alerts(spark, sf_dir)
        return build(fusion.hybrid_alerts(scored, alerts))


_report(
    "alert_feed",
    f"""SELECT rule_id, first_key, source_ip, detection_method, threat_score, severity FROM hybrid
    WHERE severity IN {FEED_SEVERITIES} AND detection_method IN {FEED_METHODS}""",
    lambda a: reports.alert_feed(a, FEED_SEVERITIES, FEED_METHODS).select(
        "rule_id", "first_key", "source_ip", "detection_method", "threat_score", "severity"
    ),
)
_report(
    "first_critical",
    f"SELECT {HYBRID_LIST} FROM hybrid WHERE severity = 'CRITICAL' ORDER BY rule_ord, first_key LIMIT 1",
    reports.first_critical,
)
_report(
    "alerts_by_severity",
    "SELECT severity, count(*) AS alerts FROM hybrid GROUP BY severity",
    lambda a: reports.count_by(a, "severity"),
)
_report(
    "alerts_by_method",
    "SELECT detection_method, count(*) AS alerts FROM hybrid GROUP BY detection_method",
    lambda a: reports.count_by(a, "detection_method"),
)
_report(
    "threat_histogram",
    """SELECT CAST(least(coalesce(floor((threat_score - low) * 20 / nullif(high - low, 0)), 0), 19)
      AS BIGINT) AS bin, count(*) AS alerts FROM hybrid CROSS JOIN
      (SELECT min(threat_score) AS low, max(threat_score) AS high FROM hybrid) GROUP BY 1""",
    reports.threat_histogram,
)


@query(
    "attack_types",
    sql(
        """SELECT rule_name, CAST(sum(count) AS BIGINT) AS events FROM alerts GROUP BY rule_name
        ORDER BY events DESC, rule_name""",
        "alerts",
    ),
)
def attack_types(spark, sf_dir):
    return reports.attack_types(line_rules.evaluate_rules(logs.written_logs(spark, sf_dir)))


# --- metrics ----------------------------------------------------------------------------
@query(
    "confusion_metrics",
    sql(
        f"""SELECT precision, recall, f1 AS f1_score, round((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy,
          fpr AS false_positive_rate, round(fn / greatest(fn + tp, 1), 4) AS false_negative_rate,
          tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives,
          tp + fp + tn + fn AS total_samples, tp + fn AS attack_samples, fp + tn AS normal_samples
        FROM (SELECT *, {QUALITY_ROUNDED} FROM (SELECT {cells('label', 'if_pred')} FROM scored))""",
        "scored",
    ),
)
def confusion_metrics(spark, sf_dir):
    return evaluation.confusion_metrics(logs.stand_in_lines(logs.all_logs(spark, sf_dir, logs.LABEL_COLUMNS)), "if_pred")


@query(
    "label_quality_confusion",
    """SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS true_positives,
      count(*) FILTER (quality = 0 AND toxic = 1) AS false_positives,
      count(*) FILTER (quality = 0 AND toxic = 0) AS true_negatives,
      count(*) FILTER (quality = 1 AND toxic = 0) AS false_negatives FROM labels""",
)
def label_quality_confusion(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("quality", "label")
    return evaluation.confusion_metrics(table, "toxic").select(
        "true_positives", "false_positives", "true_negatives", "false_negatives"
    )


_MIX = threat("rule_pred", "anomaly_score", fv.LINE_ABLATION_ALPHA)


@query(
    "ablation_lines",
    sql(
        "SELECT method, precision, recall, f1, fpr FROM (" + " UNION ALL ".join(
            f"SELECT '{name}' AS method, {QUALITY_ROUNDED} FROM (SELECT {cells('label', pred)} FROM predicted)"
            for name, pred in (
                ("rule_only", "rule_pred"),
                ("isolation_forest", "if_pred"),
                ("hybrid", f"CAST({_MIX} >= {num(0.5)} AS INTEGER)"),
            )
        ) + ")",
        "predicted",
    ),
)
def ablation_lines(spark, sf_dir):
    lines, labelled = logs.ruled_logs(spark, sf_dir)
    scored = logs.stand_in_lines(labelled)
    return evaluation.ablation_lines(
        fusion.rule_predictions(scored, line_rules.evaluate_rules(lines))
    )
