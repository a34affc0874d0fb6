"""Queries over parsed lines: parsers, features, labels, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.functions import fixed_values as fv
from vigilog.functions.scoring import is_external
from vigilog.operators import fusion, labels, line_features, line_rules, parsing, reports

from . import logs
from .derived import raw_lines
from .registry import query
from .sql import ALERT_LIST, BURST, LINE_FLAGS, PARSED, PARSED_LIST, external, rule_selects, sql

PARSED_COLUMNS = ["line_key", "raw", *PARSED]


def _parser(kind: str) -> None:
    oracle = sql(f"SELECT line_key, raw, {PARSED_LIST} FROM {kind}", kind)

    @query(f"parse_{kind}", oracle)
    def run(spark, sf_dir):
        return logs.parsed(spark, sf_dir, kind).select(*PARSED_COLUMNS)


for _kind in ("ssh", "hdfs", "apache", "linux"):
    _parser(_kind)


@query("parse_ssh_fixed", sql(f"SELECT line_key, raw, {PARSED_LIST} FROM ssh_fixed", "ssh_fixed"))
def parse_ssh_fixed(spark, sf_dir):
    return parsing.parse_ssh(raw_lines(spark, sf_dir, "ssh"), fixed=True).select(*PARSED_COLUMNS)


@query(
    "all_logs",
    sql(f"SELECT line_key, raw, {PARSED_LIST}, label, dataset FROM all_logs", "all_logs"),
)
def all_logs(spark, sf_dir):
    return logs.all_logs(spark, sf_dir).select(*PARSED_COLUMNS, "label", "dataset")


@query("external_ip", sql(f"SELECT ip, {external('ip')} AS external, count(*) AS lines FROM ssh GROUP BY ip", "ssh"))
def external_ip(spark, sf_dir):
    lines = logs.parsed(spark, sf_dir, "ssh")
    return lines.groupBy("ip").agg(F.count("*").alias("lines")).select(
        "ip", is_external(F.col("ip")).alias("external"), "lines"
    )


@query("line_features", sql(f"SELECT line_key, {LINE_FLAGS} FROM all_logs", "all_logs"))
def line_features_query(spark, sf_dir):
    return line_features.line_features(logs.unlabelled_logs(spark, sf_dir)).select(
        "line_key", *line_features.LINE_FEATURES
    )


@query(
    "ip_burst",
    sql(f"SELECT line_key, l.ip, {BURST} FROM all_logs l LEFT JOIN per_ip USING (ip)", "per_ip"),
)
def ip_burst(spark, sf_dir):
    return line_features.ip_burst(logs.written_logs(spark, sf_dir, ("line_key", "ip", "event_type"))).select(
        "line_key", "ip", *line_features.BURST_FEATURES
    )


@query(
    "combined_features",
    sql(f"SELECT line_key, {LINE_FLAGS}, {BURST} FROM all_logs l LEFT JOIN per_ip USING (ip)", "per_ip"),
)
def combined_features(spark, sf_dir):
    return line_features.written_features(logs.unlabelled_logs(spark, sf_dir), ["line_key"]).select(
        "line_key", *line_features.COMBINED_FEATURES
    )


def _labels(kind: str) -> None:
    @query(f"infer_{kind}_labels", sql(f"SELECT line_key, ip, event_type, label FROM {kind}_labels", f"{kind}_labels"))
    def run(spark, sf_dir):
        return logs.labelled(spark, sf_dir, kind).select("line_key", "ip", "event_type", "label")


for _kind in ("ssh", "apache", "linux"):
    _labels(_kind)


@query("label_join", sql("SELECT line_key, block_id, label FROM hdfs_labels", "hdfs_labels"))
def label_join(spark, sf_dir):
    return logs.labelled(spark, sf_dir, "hdfs").select("line_key", "block_id", "label")


@query(
    "infer_hdfs_labels",
    sql("SELECT line_key, CAST(event_type = 'hdfs_anomaly' AS INTEGER) AS label FROM hdfs", "hdfs"),
)
def infer_hdfs_labels(spark, sf_dir):
    return labels.infer_hdfs_labels(logs.parsed(spark, sf_dir, "hdfs")).select("line_key", "label")


@query(
    "dataset_stats",
    sql(
        """SELECT coalesce(source, 'all') AS source, CAST(count(*) AS BIGINT) AS total,
          count(*) FILTER (label = 0) AS normal, count(*) FILTER (label = 1) AS attack,
          round(100 * count(*) FILTER (label = 1) / count(*), 2) AS attack_pct
        FROM all_logs GROUP BY ROLLUP (source)""",
        "all_logs",
    ),
)
def dataset_stats(spark, sf_dir):
    return reports.dataset_stats(logs.all_logs(spark, sf_dir, logs.LABEL_COLUMNS))


# --- rules ------------------------------------------------------------------------------
def _rule(rule_id: str, fixed: bool) -> None:
    kind = "ssh" if rule_id.startswith("AUTH") else "apache"
    table = f"{kind}_fixed" if fixed else kind
    name = "rule_" + rule_id.replace("-", "_").lower() + ("_fixed" if fixed else "")
    select = rule_selects(table, fixed)[rule_id]

    @query(name, sql(f"SELECT {ALERT_LIST} FROM ({select})", table))
    def run(spark, sf_dir):
        parse = {"ssh": parsing.parse_ssh, "apache": parsing.parse_apache}[kind]
        lines = parse(raw_lines(spark, sf_dir, kind), fixed=fixed)
        return line_rules.evaluate_rules(logs.materialise(lines, kind), [rule_id], fixed=fixed)


for _r in fv.LINE_RULES:
    _rule(_r.rule_id, False)
for _id in ("AUTH-003", "HTTP-001", "HTTP-002", "HTTP-004"):
    _rule(_id, True)


@query("rule_alerts", sql(f"SELECT {ALERT_LIST} FROM alerts", "alerts"))
def rule_alerts(spark, sf_dir):
    return line_rules.evaluate_rules(logs.written_logs(spark, sf_dir))


@query(
    "first_traversal_alerts",
    sql(f"SELECT {ALERT_LIST} FROM alerts WHERE rule_id = 'HTTP-003' ORDER BY first_key LIMIT 10", "alerts"),
)
def first_traversal_alerts(spark, sf_dir):
    """The ten that a report shows."""
    alerts = line_rules.evaluate_rules(logs.written_logs(spark, sf_dir), ["HTTP-003"])
    return line_rules.first_alerts_of(alerts, "HTTP-003")


@query("rule_preds", sql("SELECT line_key, ip, rule_pred FROM predicted", "predicted"))
def rule_preds(spark, sf_dir):
    lines = logs.written_logs(spark, sf_dir)
    return fusion.rule_predictions(lines, line_rules.evaluate_rules(lines)).select(
        "line_key", "ip", "rule_pred"
    )
