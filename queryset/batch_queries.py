"""Verdicts over batches of the four line logs. Their oracles detect, parse, judge and explain each batch in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.functions import fixed_values as fv
from vigilog.operators import forest
from vigilog.operators.line_features import COMBINED_FEATURES, combined_features
from vigilog.plans.batch_plan import judge_batches
from vigilog.sources.shared import materialise

from . import logs, model_queries  # noqa: F401  (model_queries has the forest of the lines in SQL)
from .derived import raw_lines
from .forest_sql import importance as importance_sql
from .forest_sql import scored as scored_sql
from .registry import query
from .sql import LINE_FLAGS, cte, detected_type, fused, num, parse_as, rule_selects, sql

#: Each log is cut into as many batches.
_BATCHES = 8

cte(
    "batch_raw",
    " UNION ALL ".join(
        f"SELECT '{kind}-' || line_key % {_BATCHES} AS batch, line_key * 4 + {n} AS line_key, value, raw FROM {kind}_raw"
        for kind, n in logs.PARTS
    ),
    *[f"{kind}_raw" for kind, _ in logs.PARTS], keep=True,
)
cte(
    "batch_types",
    f"""SELECT batch, {detected_type('t')} AS log_type FROM (SELECT batch, string_agg(raw, ' ' ORDER BY line_key) AS t FROM (
      SELECT *, row_number() OVER (PARTITION BY batch ORDER BY line_key) AS n FROM batch_raw) WHERE n <= {fv.DETECT_SAMPLE_LINES}
    GROUP BY batch)""",
    "batch_raw", keep=True,
)
for _kind, _ in logs.PARTS:
    cte(f"b_{_kind}_raw", f"SELECT * FROM batch_raw JOIN batch_types USING (batch) WHERE log_type = '{_kind}'", "batch_raw", "batch_types")
    parse_as(_kind, "b_")
cte(
    "batch_lines",
    "SELECT p.*, batch, log_type FROM ("
    + " UNION ALL ".join(f"SELECT * FROM b_{kind}" for kind, _ in logs.PARTS)
    + ") p JOIN (SELECT batch, line_key FROM batch_raw) USING (line_key) JOIN batch_types USING (batch)",
    *[f"b_{kind}" for kind, _ in logs.PARTS], keep=True,
)
cte(
    "batch_alerts",
    " UNION ALL ".join(
        f"SELECT batch, rule_id, rule_score FROM ({s})" for s in rule_selects("batch_lines", by="batch").values()
    ),
    "batch_lines", keep=True,
)
cte("batch_sizes", "SELECT batch, count(*) AS size FROM batch_lines GROUP BY batch", "batch_lines")
cte(
    "batch_ips",
    """SELECT batch, ip, count(*) AS n, count(*) FILTER (event_type IN ('failed_password', 'invalid_user')) AS f
    FROM batch_lines WHERE ip IS NOT NULL GROUP BY batch, ip""",
    "batch_lines",
)
_BURST = """coalesce(n, 0) AS ip_total_count, coalesce(f, 0) AS ip_fail_count, round(coalesce(n, 0) / size, 6) AS ip_freq_norm,
  round(coalesce(f, 0) / size, 6) AS ip_fail_norm"""
cte(
    "batch_features",
    f"""SELECT batch, log_type, line_key, CAST(line_key AS VARCHAR) AS k, [{', '.join(f'{f}::DOUBLE' for f in COMBINED_FEATURES)}] AS xs
    FROM (SELECT l.batch, l.log_type, l.line_key, {LINE_FLAGS}, {_BURST} FROM batch_lines l LEFT JOIN batch_ips USING (batch, ip)
      JOIN batch_sizes USING (batch))""",
    "batch_lines", "batch_ips", "batch_sizes", keep=True,
)
cte("batch_vectors", "SELECT 0 AS f, xs, row_number() OVER () AS id FROM (SELECT DISTINCT xs FROM batch_features)", "batch_features", keep=True)
scored_sql("lines_forest", "batch_vectors", "batch_points", fv.LINE_TREES)
cte(
    "batch_scores",
    """SELECT *, CASE WHEN low = high THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - (raw_score - low) / (high - low) END AS anomaly_score
    FROM (SELECT batch, log_type, raw_score, min(raw_score) OVER b AS low, max(raw_score) OVER b AS high
      FROM batch_features JOIN batch_vectors USING (xs) JOIN batch_points USING (id) WINDOW b AS (PARTITION BY batch))""",
    "batch_features", "batch_vectors", "batch_points",
)


def _judged(log_type: str, alpha: float) -> str:
    return f"SELECT batch, log_type, events, rule_hits, {fused('r', 'a', alpha)} FROM batch_means WHERE log_type {log_type} 'ssh'"


cte(
    "batch_means",
    """SELECT batch, log_type, events, coalesce(hits, 0) AS rule_hits, a, coalesce(r, 0.0::DOUBLE) AS r FROM (
      SELECT batch, any_value(log_type) AS log_type, count(*) AS events, avg(anomaly_score) AS a FROM batch_scores GROUP BY batch)
    LEFT JOIN (SELECT batch, count(*) AS hits, max(rule_score) AS r FROM batch_alerts GROUP BY batch) USING (batch)""",
    "batch_scores", "batch_alerts",
)
cte("batch_verdicts", f"{_judged('=', fv.LINE_ALPHA)} UNION ALL {_judged('<>', fv.HDFS_ALPHA)}", "batch_means", keep=True)
cte(
    "explained_rows",
    f"SELECT * FROM batch_features WHERE batch IN (SELECT batch FROM batch_verdicts WHERE threat_score > {num(fv.EXPLAIN_CUT)})",
    "batch_features", "batch_verdicts", keep=True,
)
importance_sql("explained", ["line_key"], COMBINED_FEATURES, fv.LINE_TREES, forest="lines_forest", by="batch")
cte(
    "batch_importance",
    f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY batch ORDER BY importance DESC, feature) AS INTEGER) AS rank
    FROM explained_importance) WHERE rank <= {fv.EXPLAIN_FEATURES}""",
    "explained_importance",
)


def _batches(spark, sf_dir) -> DataFrame:
    """Raw lines of the four logs, which nothing but their text tells apart."""
    parts = [
        raw_lines(spark, sf_dir, kind).select(
            F.concat(F.lit(f"{kind}-"), F.col("line_key") % _BATCHES).alias("batch"),
            (F.col("line_key") * 4 + n).alias("line_key"),
            "raw",
        )
        for kind, n in logs.PARTS
    ]
    return reduce(DataFrame.unionByName, parts)


def _judgement(spark, sf_dir):
    """All batches, judged by a forest of the four logs' normal lines."""
    featured = combined_features(logs.all_logs(spark, sf_dir)).select("line_key", "label", *COMBINED_FEATURES)
    model = forest.fit(materialise(featured, "features"), COMBINED_FEATURES, ["line_key"], trees=fv.LINE_TREES)
    return judge_batches(_batches(spark, sf_dir), model)


@query(
    "batch_verdict",
    sql(
        f"""SELECT v.*, CASE WHEN rule_hits > 0 THEN 'signatures triggered' WHEN threat_score >= {num(0.4)}
          THEN 'structurally anomalous' ELSE 'clean' END AS verdict, i.feature AS top_feature
        FROM batch_verdicts v LEFT JOIN (SELECT batch, feature FROM batch_importance WHERE rank = 1) i USING (batch)""",
        "batch_verdicts", "batch_importance",
    ),
)
def batch_verdict(spark, sf_dir):
    """The four logs cut into batches; each is judged on its own, by all rules and the forest."""
    return _judgement(spark, sf_dir).verdicts


@query("batch_importance", sql("SELECT batch, feature, importance, rank FROM batch_importance", "batch_importance"))
def batch_importance(spark, sf_dir):
    """What moves the scores of each batch of interest."""
    found = _judgement(spark, sf_dir).importance
    return found.select("batch", "feature", F.round("importance", 6).alias("importance"), "rank")
