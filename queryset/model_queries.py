"""Queries that train and apply the isolation forest. Their oracles grow the same forest in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.functions import fixed_values as fv
from vigilog.operators import cross_validation, evaluation, forest, importance, labels
from vigilog.operators.fusion import HYBRID_COLUMNS
from vigilog.operators.line_features import COMBINED_FEATURES
from vigilog.plans import line_plan, session_plan
from vigilog.plans.session_plan import BGL, HDFS, THUNDERBIRD
from vigilog.sources.models import load_model, save_model, table_digest
from vigilog.sources.shared import new_path

from . import logs
from .registry import query
from .forest_sql import forest as forest_sql
from .forest_sql import importance as importance_sql
from .forest_sql import order_key
from .sql import QUALITY, QUALITY_ROUNDED, cells, cte, line_ablation, num, sql, threat
from .sql import fusion as fusion_sql


def _kind_lines(spark, sf_dir, kind):
    if kind is HDFS:
        return logs.hdfs_lines(spark, sf_dir), logs.block_labels(spark, sf_dir)
    name = "bgl" if kind is BGL else "thunderbird"
    return logs.cluster_lines(spark, sf_dir, name), None


def _sessions(spark, sf_dir, kind):
    return session_plan.build_sessions(kind, *_kind_lines(spark, sf_dir, kind))


# --- the forests in SQL -----------------------------------------------------------------
_KINDS = {"hdfs": (HDFS, "hdfs_scored"), "bgl": (BGL, "bgl_scored"), "thunderbird": (THUNDERBIRD, "thunderbird_scored")}
for _name, (_kind, _table) in _KINDS.items():
    forest_sql(f"{_name}_forest", _table, _kind.key, _kind.features)
    # The stand-in score goes, the forest's comes.
    cte(
        f"{_name}_judged",
        f"""SELECT * EXCLUDE (anomaly_score), {num(1.0)} - (raw_score - min(raw_score) OVER ())
          / (max(raw_score) OVER () - min(raw_score) OVER () + {num(1e-9)}) AS anomaly_score FROM {_name}_forest_scores""",
        f"{_name}_forest_scores", keep=True,
    )


@query(
    "iforest_trees",
    sql(
        """SELECT CAST(tree AS INTEGER) AS tree, count(*) AS nodes, max(depth) AS depth, CAST(max(size) AS INTEGER) AS sample,
          CAST(sum(size) FILTER (feature IS NULL) AS BIGINT) AS rows_in_leaves FROM bgl_forest_nodes GROUP BY tree""",
        "bgl_forest_nodes",
    ),
)
def iforest_trees(spark, sf_dir):
    """Nodes per tree of a forest trained on normal windows."""
    table = _sessions(spark, sf_dir, BGL)
    nodes = forest.fit(table, BGL.features, BGL.key).nodes
    return nodes.groupBy("tree").agg(
        F.count("*").alias("nodes"),
        F.max("depth").alias("depth"),
        F.max("size").alias("sample"),
        F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("rows_in_leaves"),
    )


@query(
    "iforest_scores",
    sql("SELECT node, win_no, label, round(raw_score, 9) AS raw_score FROM bgl_forest_scores", "bgl_forest_scores"),
)
def iforest_scores(spark, sf_dir):
    table = _sessions(spark, sf_dir, BGL)
    model = forest.fit(table, BGL.features, BGL.key)
    return forest.score(table, model).select("node", "win_no", "label", F.round("raw_score", 9).alias("raw_score"))


@query(
    "model_roundtrip",
    sql(
        """SELECT node, win_no, round(raw_score, 9) AS raw_score, round(raw_score, 9) AS reloaded_score
        FROM thunderbird_forest_scores""",
        "thunderbird_forest_scores",
    ),
)
def model_roundtrip(spark, sf_dir):
    """Scores of a saved and reloaded model next to those of the original."""
    table = _sessions(spark, sf_dir, THUNDERBIRD)
    model = forest.fit(table, THUNDERBIRD.features, THUNDERBIRD.key)
    path = new_path(spark, "model")
    trained_on = table_digest(table.filter("label = 0"), [*THUNDERBIRD.key, *THUNDERBIRD.features])
    version = save_model(model, path, trained_on)
    loaded = load_model(spark, path, version, THUNDERBIRD.features, trained_on)
    both = forest.score(forest.score(table, model), loaded, "reloaded_score")
    return both.select("node", "win_no", *[F.round(c, 9).alias(c) for c in ("raw_score", "reloaded_score")])


def _detection(name: str, kind, table: str) -> None:
    mix = threat("rule_score", "anomaly_score", kind.alpha)
    preds = (
        ("Rule Only", "CAST(rule_score > 0 AS INTEGER)"),
        ("Isolation Forest Only", f"CAST(anomaly_score >= {num(kind.cut)} AS INTEGER)"),
        ("Hybrid (Rule + IF)", f"CAST({mix} >= {num(kind.cut)} AS INTEGER)"),
    )
    oracle = " UNION ALL ".join(
        f"SELECT '{m}' AS method, tp, fp, tn, fn, {QUALITY_ROUNDED} FROM (SELECT {cells('label', p)} FROM {table})"
        for m, p in preds
    )

    @query(name, sql(oracle, table))
    def run(spark, sf_dir):
        return session_plan.detect_sessions(kind, *_kind_lines(spark, sf_dir, kind)).ablation


_detection("detect_hdfs", HDFS, "hdfs_judged")
_detection("detect_bgl", BGL, "bgl_judged")
_detection("detect_thunderbird", THUNDERBIRD, "thunderbird_judged")


forest_sql("lines_forest", "line_table", ["line_key"], COMBINED_FEATURES, trees=fv.LINE_TREES)
# The cut lies between two neighbours in the order of the normal lines' scores, at the share of anomalous lines and a margin.
cte(
    "lines_cut",
    """SELECT min(raw_score) FILTER (i = floor(place)) + (min(raw_score) FILTER (i = least(floor(place) + 1, n - 1))
        - min(raw_score) FILTER (i = floor(place))) * (any_value(place) - floor(any_value(place))) AS cut
    FROM (SELECT *, share * (n - 1) AS place FROM (
      SELECT raw_score, row_number() OVER (ORDER BY raw_score) - 1 AS i, count(*) OVER () AS n FROM lines_forest_scores WHERE label = 0),
      (SELECT least(0.5::DOUBLE, round(100 * sum(label) / count(*), 2) / 100 + 0.02::DOUBLE) AS share FROM all_logs))""",
    "lines_forest_scores", "all_logs", keep=True,
)
cte(
    "lines_judged",
    """SELECT *, CASE WHEN low = high THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - (raw_score - low) / (high - low) END AS anomaly_score,
      CAST(raw_score < (SELECT cut FROM lines_cut) AS INTEGER) AS if_pred
    FROM (SELECT *, min(raw_score) OVER () AS low, max(raw_score) OVER () AS high FROM lines_forest_scores)""",
    "lines_forest_scores", "lines_cut", keep=True,
)
fusion_sql("lines_", "lines_judged")


@query("detect_lines", sql(f"SELECT {', '.join(HYBRID_COLUMNS)} FROM lines_hybrid", "lines_hybrid"))
def detect_lines(spark, sf_dir):
    """The whole line job; its alerts."""
    return line_plan.detect_lines(logs.all_logs(spark, sf_dir)).hybrid_alerts


@query("detect_lines_ablation", sql(line_ablation("lines_predicted"), "lines_predicted"))
def detect_lines_ablation(spark, sf_dir):
    return line_plan.detect_lines(logs.all_logs(spark, sf_dir)).ablation


cte(
    "bgl_folds",
    f"""SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY {order_key(str(fv.SEED), 'node', 'win_no')}, node, win_no) - 1)
      % 5 AS INTEGER) AS fold FROM bgl_scored""",
    "bgl_scored", keep=True,
)
forest_sql("folds_forest", "bgl_folds", BGL.key, BGL.features, folds=5)


@query(
    "fold_of_session",
    sql("SELECT node, win_no, label, fold FROM bgl_folds", "bgl_folds"),
)
def fold_of_session(spark, sf_dir):
    """The fold of every window."""
    table = _sessions(spark, sf_dir, BGL).select("node", "win_no", "label")
    return evaluation.stratified_folds(table, BGL.key)


_FOLD_MIX = threat("rule_score", "score", BGL.alpha)


@query(
    "cross_validate",
    sql(
        f"""SELECT count(*) AS folds, round(avg(f1), 4) AS f1_mean, round(stddev_samp(f1), 4) AS f1_std,
          round(avg(precision), 4) AS p_mean, round(stddev_samp(precision), 4) AS p_std,
          round(avg(recall), 4) AS r_mean, round(stddev_samp(recall), 4) AS r_std,
          round(avg(fpr), 4) AS fpr_mean, round(stddev_samp(fpr), 4) AS fpr_std
        FROM (SELECT {QUALITY} FROM (SELECT fold, {cells('label', f"CAST({_FOLD_MIX} >= {num(BGL.cut)} AS INTEGER)")}
          FROM (SELECT fold, label, rule_score, {num(1.0)} - (raw_score - min(raw_score) OVER f)
              / (max(raw_score) OVER f - min(raw_score) OVER f + {num(1e-9)}) AS score
            FROM folds_forest_scores WINDOW f AS (PARTITION BY fold)) GROUP BY fold))""",
        "folds_forest_scores",
    ),
)
def cross_validate(spark, sf_dir):
    table = _sessions(spark, sf_dir, BGL)
    folds = cross_validation.cross_validate(table, BGL.features, BGL.key, BGL.alpha, BGL.cut)
    return evaluation.cv_summary(folds)


importance_sql("hdfs_forest", HDFS.key, HDFS.features)
importance_sql("bgl_forest", BGL.key, BGL.features)


def _importance(spark, sf_dir, kind):
    table = _sessions(spark, sf_dir, kind)
    model = forest.fit(table, kind.features, kind.key)
    return importance.permutation_importance(table, model, kind.key)


@query("permutation_importance", sql("SELECT * FROM hdfs_forest_importance", "hdfs_forest_importance"))
def permutation_importance(spark, sf_dir):
    return _importance(spark, sf_dir, HDFS).select("feature", F.round("importance", 6).alias("importance"))


@query(
    "top_features",
    sql("SELECT * FROM bgl_forest_importance ORDER BY importance DESC, feature LIMIT 15", "bgl_forest_importance"),
)
def top_features(spark, sf_dir):
    return importance.top_features(_importance(spark, sf_dir, BGL)).select("feature", F.round("importance", 6).alias("importance"))


@query(
    "session_contamination",
    sql(
        """SELECT round(greatest(0.001::DOUBLE, least(avg(label), 0.499::DOUBLE)), 6) AS contamination
        FROM bgl_features""",
        "bgl_features",
    ),
)
def session_contamination(spark, sf_dir):
    from vigilog.operators.windows import sliding_windows

    table = sliding_windows(logs.cluster_lines(spark, sf_dir, "bgl"))
    return evaluation.contamination(table, 0.001, 0.499).select(
        F.round("contamination", 6).alias("contamination")
    )


@query(
    "block_contamination",
    sql(
        """SELECT round(avg(coalesce(label, 0)), 6) AS contamination FROM hdfs_features
        LEFT JOIN block_labels USING (block_id)""",
        "hdfs_features", "block_labels",
    ),
)
def block_contamination(spark, sf_dir):
    blocks = logs.hdfs_lines(spark, sf_dir).filter("block_id IS NOT NULL").select("block_id").distinct()
    labelled = labels.label_sessions(blocks, logs.block_labels(spark, sf_dir))
    return evaluation.contamination(labelled).select(F.round("contamination", 6).alias("contamination"))
