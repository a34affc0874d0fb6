"""Queries over sessions: blocks, windows, rules, sweeps, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.functions import fixed_values as fv
from vigilog.operators import evaluation, fusion, labels, ngram, reports, sessions, windows
from vigilog.plans.session_plan import BGL, HDFS, THUNDERBIRD
from vigilog.sources.shared import materialise

from . import logs
from .registry import query
from .sql import QUALITY, QUALITY_ROUNDED, cells, num, session_rule_columns, severity, sql, threat


@query(
    "parse_hdfs_sessions",
    sql("SELECT line_key, date, time, pid, level, component, content, block_id, raw FROM hdfs_lines", "hdfs_lines"),
)
def parse_hdfs_sessions(spark, sf_dir):
    return logs.hdfs_lines(spark, sf_dir).select(
        "line_key", "date", "time", "pid", "level", "component", "content", "block_id", "raw"
    )


@query("parse_bgl", sql("SELECT line_key, label, node, level, content, raw_label FROM bgl_lines", "bgl_lines"))
def parse_bgl(spark, sf_dir):
    return logs.cluster_lines(spark, sf_dir, "bgl").select(
        "line_key", "label", "node", "level", "content", "raw_label"
    )


@query(
    "parse_thunderbird",
    sql("SELECT line_key, label, node, content, raw_label FROM thunderbird_lines", "thunderbird_lines"),
)
def parse_thunderbird(spark, sf_dir):
    return logs.cluster_lines(spark, sf_dir, "thunderbird").select(
        "line_key", "label", "node", "content", "raw_label"
    )


# --- windows ----------------------------------------------------------------------------
@query("node_ordinal", sql("SELECT line_key, node, ordinal, node_lines FROM bgl_ordinals", "bgl_ordinals"))
def node_ordinal(spark, sf_dir):
    return windows.node_ordinals(logs.cluster_lines(spark, sf_dir, "bgl")).select(
        "line_key", "node", "ordinal", "node_lines"
    )


@query(
    "sliding_windows",
    sql(
        "SELECT node, win_no, max(label) AS label, count(*) AS n_lines FROM bgl_in_windows GROUP BY node, win_no",
        "bgl_in_windows",
    ),
)
def sliding_windows(spark, sf_dir):
    return windows.sliding_windows(logs.cluster_lines(spark, sf_dir, "bgl"))


@query(
    "sliding_windows_general",
    sql(
        """SELECT o.node, w.win_no, max(label) AS label, count(*) AS n_lines FROM bgl_ordinals o,
          LATERAL (SELECT unnest(range(0, o.ordinal // 4 + 1)) AS win_no) w
        WHERE w.win_no * 4 <= o.ordinal AND o.ordinal < w.win_no * 4 + 15 AND w.win_no * 4 + 15 <= o.node_lines
        GROUP BY o.node, w.win_no""",
        "bgl_ordinals",
    ),
)
def sliding_windows_general(spark, sf_dir):
    """A size that is no multiple of the step."""
    return windows.sliding_windows(logs.cluster_lines(spark, sf_dir, "bgl"), size=15, step=4)


@query(
    "window_ids",
    sql(
        """SELECT node, win_no, label, n_lines, 'win_' || (row_number() OVER (ORDER BY node, win_no) - 1) AS win_id
        FROM (SELECT node, win_no, max(label) AS label, count(*) AS n_lines FROM bgl_in_windows
          GROUP BY node, win_no)""",
        "bgl_in_windows",
    ),
)
def window_ids(spark, sf_dir):
    return windows.window_ids(windows.sliding_windows(logs.cluster_lines(spark, sf_dir, "bgl")))


@query(
    "bgl_window_features",
    sql(f"SELECT node, win_no, label, {', '.join(sessions.BGL_FEATURES)} FROM bgl_features", "bgl_features"),
)
def bgl_window_features(spark, sf_dir):
    table = sessions.bgl_windows(logs.cluster_lines(spark, sf_dir, "bgl"))
    return table.select("node", "win_no", "label", *sessions.BGL_FEATURES)


@query(
    "tb_window_features",
    sql(
        f"SELECT node, win_no, label, {', '.join(sessions.THUNDERBIRD_FEATURES)} FROM thunderbird_features",
        "thunderbird_features",
    ),
)
def tb_window_features(spark, sf_dir):
    table = sessions.thunderbird_windows(logs.cluster_lines(spark, sf_dir, "thunderbird"))
    return table.select("node", "win_no", "label", *sessions.THUNDERBIRD_FEATURES)


@query(
    "hdfs_block_features",
    sql(
        f"""SELECT block_id, coalesce(label, 0) AS label, {', '.join(sessions.HDFS_FEATURES)}
        FROM hdfs_features LEFT JOIN block_labels USING (block_id)""",
        "hdfs_features", "block_labels",
    ),
)
def hdfs_block_features(spark, sf_dir):
    table = sessions.hdfs_blocks(logs.hdfs_lines(spark, sf_dir))
    labelled = labels.label_sessions(table, logs.block_labels(spark, sf_dir))
    return labelled.select("block_id", "label", *sessions.HDFS_FEATURES)


# --- session rules ----------------------------------------------------------------------
@query(
    "hdfs_rules",
    sql(f"SELECT block_id, {session_rule_columns(fv.HDFS_RULES)} FROM hdfs_features", "hdfs_features"),
)
def hdfs_rules(spark, sf_dir):
    table = sessions.hdfs_sessions(logs.hdfs_lines(spark, sf_dir))
    return logs.joined_lists(table).select("block_id", "rule_score", "rules_hit", "rule_names", "top_severity")


def _cluster_rules(name: str, kind: str, rules, build) -> None:
    @query(name, sql(f"SELECT node, win_no, {session_rule_columns(rules)} FROM {kind}_features", f"{kind}_features"))
    def run(spark, sf_dir):
        table = build(logs.cluster_lines(spark, sf_dir, kind))
        return logs.joined_lists(table).select(
            "node", "win_no", "rule_score", "rules_hit", "rule_names", "top_severity"
        )


_cluster_rules("bgl_rules", "bgl", fv.BGL_RULES, sessions.bgl_sessions)
_cluster_rules("tb_rules", "thunderbird", fv.THUNDERBIRD_RULES, sessions.thunderbird_sessions)


# --- evaluation on a stand-in score -----------------------------------------------------
def _ablation(name: str, table: str, kind, load) -> None:
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
        return evaluation.ablation_sessions(load(spark, sf_dir), kind.alpha, kind.cut)


_ablation("ablation_sessions", "hdfs_scored", HDFS, logs.hdfs_scored)
_ablation("ablation_bgl", "bgl_scored", BGL, lambda s, d: logs.cluster_scored(s, d, "bgl"))
_ablation(
    "ablation_tb", "thunderbird_scored", THUNDERBIRD, lambda s, d: logs.cluster_scored(s, d, "thunderbird")
)


@query(
    "fuse_sessions",
    sql(
        f"""SELECT block_id, {threat('rule_score', 'anomaly_score', HDFS.alpha)} AS threat_score,
          {severity(threat('rule_score', 'anomaly_score', HDFS.alpha))} AS severity FROM hdfs_scored""",
        "hdfs_scored",
    ),
)
def fuse_sessions(spark, sf_dir):
    return fusion.fuse_sessions(logs.hdfs_scored(spark, sf_dir), HDFS.alpha).select(
        "block_id", "threat_score", "severity"
    )


def _grid(table: str, alphas, cuts) -> str:
    weights = ", ".join(f"({num(a)}, {num(1 - a)})" for a in alphas)
    limits = ", ".join(f"({num(c)})" for c in cuts)
    pred = "CAST(a.alpha * rule_score + a.rest * anomaly_score >= c.threshold AS INTEGER)"
    return (
        f"SELECT *, {QUALITY} FROM (SELECT alpha, threshold, {cells('label', pred)} FROM {table}"
        f" CROSS JOIN (VALUES {weights}) a(alpha, rest) CROSS JOIN (VALUES {limits}) c(threshold)"
        " GROUP BY alpha, threshold)"
    )


@query(
    "alpha_sweep",
    sql(
        f"SELECT 'BGL' AS dataset, alpha, round(f1, 4) AS f1, round(fpr, 4) AS fpr FROM"
        f" ({_grid('bgl_scored', fv.SWEEP_ALPHAS, [BGL.cut])}) UNION ALL"
        f" SELECT 'HDFS' AS dataset, alpha, round(f1, 4) AS f1, round(fpr, 4) AS fpr FROM"
        f" ({_grid('hdfs_scored', fv.SWEEP_ALPHAS, [HDFS.cut])})",
        "bgl_scored", "hdfs_scored",
    ),
)
def alpha_sweep(spark, sf_dir):
    bgl = evaluation.alpha_sweep(logs.cluster_scored(spark, sf_dir, "bgl"), BGL.cut)
    hdfs = evaluation.alpha_sweep(logs.hdfs_scored(spark, sf_dir), HDFS.cut)
    return bgl.select(F.lit("BGL").alias("dataset"), "*").unionByName(
        hdfs.select(F.lit("HDFS").alias("dataset"), "*")
    )


@query(
    "grid_tune",
    sql(
        "SELECT alpha AS best_alpha, threshold AS best_threshold, round(f1, 4) AS best_f1,"
        " round(precision, 4) AS best_precision, round(recall, 4) AS best_recall, round(fpr, 4) AS best_fpr,"
        " CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn"
        f" FROM ({_grid('hdfs_scored', fv.TUNE_ALPHAS, fv.TUNE_THRESHOLDS)}) WHERE f1 > 0"
        " ORDER BY f1 DESC, alpha, threshold LIMIT 1",
        "hdfs_scored",
    ),
)
def grid_tune(spark, sf_dir):
    return evaluation.grid_tune(logs.hdfs_scored(spark, sf_dir))


_FOLD_MIX = threat("rule_score", "score", BGL.alpha)


CV_SUMMARY = f"""SELECT count(*) AS folds, round(avg(f1), 4) AS f1_mean, round(stddev_samp(f1), 4) AS f1_std,
          round(avg(precision), 4) AS p_mean, round(stddev_samp(precision), 4) AS p_std,
          round(avg(recall), 4) AS r_mean, round(stddev_samp(recall), 4) AS r_std,
          round(avg(fpr), 4) AS fpr_mean, round(stddev_samp(fpr), 4) AS fpr_std
        FROM (SELECT {QUALITY} FROM (SELECT fold, {cells('label', f"CAST({_FOLD_MIX} >= {num(BGL.cut)} AS INTEGER)")}
          FROM (SELECT fold, label, rule_score, {num(1.0)} - (raw - min(raw) OVER f)
              / (max(raw) OVER f - min(raw) OVER f + {num(1e-9)}) AS score
            FROM (SELECT *, win_no % 5 AS fold, -unique_ratio AS raw FROM bgl_scored)
            WINDOW f AS (PARTITION BY fold)) GROUP BY fold))"""


@query("cv_summary", sql(CV_SUMMARY, "bgl_scored"))
def cv_summary(spark, sf_dir):
    """Folds and raw scores are stand-ins; bounds, fusion and metrics are per fold."""
    table = logs.cluster_scored(spark, sf_dir, "bgl").select(
        (F.col("win_no") % 5).alias("fold"), "label", "rule_score", (-F.col("unique_ratio")).alias("raw_score")
    )
    scored = fusion.normalise_scores(table, eps=True, by=("fold",))
    return evaluation.cv_summary(evaluation.fold_metrics(scored, BGL.alpha, BGL.cut))


@query(
    "stratified_folds",
    sql(
        """SELECT label, CAST(fold AS INTEGER) AS fold, n // 5 + CAST(fold < n % 5 AS BIGINT) AS sessions FROM
          (SELECT label, count(*) AS n FROM bgl_features GROUP BY label), (SELECT unnest(range(5)) AS fold)
        WHERE n // 5 + CAST(fold < n % 5 AS BIGINT) > 0""",
        "bgl_features",
    ),
)
def stratified_folds(spark, sf_dir):
    table = windows.sliding_windows(logs.cluster_lines(spark, sf_dir, "bgl"))
    return (
        evaluation.stratified_folds(table, ["node", "win_no"])
        .groupBy("label", "fold")
        .agg(F.count("*").alias("sessions"))
    )


# --- diagnosis --------------------------------------------------------------------------
_FIRST = """first_blocks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY block_id)
  AS place FROM hdfs_scored) WHERE place <= 500)"""


@query(
    "rule_diagnosis",
    sql(
        """SELECT label, rule_id, blocks, round(blocks / n * 100, 1) AS share FROM (SELECT label, rule_id,
          count(*) AS blocks FROM (SELECT label, unnest(string_split(rules_hit, ',')) AS rule_id FROM hdfs_scored
            WHERE rules_hit <> '') GROUP BY label, rule_id)
        JOIN (SELECT label, count(*) AS n FROM hdfs_scored GROUP BY label) USING (label)""",
        "hdfs_scored",
    ),
)
def rule_diagnosis(spark, sf_dir):
    """All blocks; scored once, read twice."""
    return reports.rule_diagnosis(logs.materialise(logs.hdfs_scored(spark, sf_dir), "scored"))


@query(
    "first_blocks",
    sql("", "hdfs_scored").rstrip() + f", {_FIRST} SELECT label, block_id, rule_score FROM first_blocks",
)
def first_blocks(spark, sf_dir):
    """The first 500 blocks of each class."""
    scored = logs.materialise(logs.hdfs_scored(spark, sf_dir), "scored")
    return reports.first_sessions(scored).select("label", "block_id", "rule_score")


@query("distinct_blocks", sql("SELECT count(DISTINCT block_id) AS blocks FROM hdfs_lines", "hdfs_lines"))
def distinct_blocks(spark, sf_dir):
    return reports.distinct_blocks(logs.hdfs_lines(spark, sf_dir))


@query(
    "evidence_profile",
    sql(
        """SELECT coalesce(label, 0) AS label, count(*) AS blocks, round(avg("r_HDFS-007"), 2) AS warn_mean,
          max("r_HDFS-007") AS warn_max, count(*) FILTER ("r_HDFS-007" >= 5) AS warn_5,
          round(avg("r_HDFS-003"), 2) AS ioex_mean, max("r_HDFS-003") AS ioex_max,
          count(*) FILTER ("r_HDFS-003" >= 1) AS ioex_1, round(avg(error_ratio), 3) AS error_ratio_mean,
          count(*) FILTER (error_ratio >= 0.5) AS error_ratio_half,
          round(avg(replicate_count), 2) AS replicate_mean, max(replicate_count) AS replicate_max,
          count(*) FILTER (replicate_count >= 6) AS replicate_6
        FROM hdfs_features LEFT JOIN block_labels USING (block_id) GROUP BY coalesce(label, 0)""",
        "hdfs_features", "block_labels",
    ),
)
def evidence_profile(spark, sf_dir):
    blocks = sessions.hdfs_blocks(logs.hdfs_lines(spark, sf_dir))
    return reports.evidence_profile(labels.label_sessions(blocks, logs.block_labels(spark, sf_dir)))


@query(
    "sample_flagged",
    sql(
        """SELECT label, block_id, line_key, substring(content, 1, 120) AS content FROM (
          SELECT s.label, l.block_id, l.line_key, l.content,
            row_number() OVER (PARTITION BY s.label ORDER BY l.line_key) AS place
          FROM hdfs_lines l JOIN (SELECT label, min(block_id) AS block_id FROM hdfs_scored
            WHERE rule_score > 0 GROUP BY label) s USING (block_id)) WHERE place <= 5""",
        "hdfs_scored", "hdfs_lines",
    ),
)
def sample_flagged(spark, sf_dir):
    scored = logs.materialise(logs.hdfs_scored(spark, sf_dir), "scored")
    return reports.sample_flagged(scored, logs.hdfs_lines(spark, sf_dir))


# --- sequences --------------------------------------------------------------------------
def _keyed(spark, sf_dir):
    """Lines with the numbers of their texts, written once: steps and windows both read them."""
    lines = materialise(
        logs.cluster_lines(spark, sf_dir, "bgl").select("node", "line_key", "label", "content"), "bgl"
    )
    return materialise(ngram.log_keys(lines, ngram.log_vocabulary(lines)).drop("content"), "keyed")


def _sequences(spark, sf_dir):
    """Key sequences, written once: training and detection both read them."""
    return materialise(ngram.key_sequences(_keyed(spark, sf_dir)), "sequences")


@query("log_vocab", sql("SELECT content, n, CAST(key AS INTEGER) AS key FROM vocab", "vocab"))
def log_vocab(spark, sf_dir):
    return ngram.log_vocabulary(logs.cluster_lines(spark, sf_dir, "bgl"))


@query(
    "log_vocab_100",
    sql("SELECT content, n, CAST(key AS INTEGER) AS key FROM vocab WHERE key <= 100", "vocab"),
)
def log_vocab_100(spark, sf_dir):
    """The small vocabulary: the hundred most frequent texts."""
    return ngram.log_vocabulary(logs.cluster_lines(spark, sf_dir, "bgl"), words=100)


@query(
    "log_keys",
    sql(
        "SELECT line_key, node, CAST(coalesce(key, 0) AS INTEGER) AS key FROM bgl_lines LEFT JOIN vocab USING (content)",
        "bgl_lines", "vocab",
    ),
)
def log_keys(spark, sf_dir):
    lines = logs.cluster_lines(spark, sf_dir, "bgl")
    return ngram.log_keys(lines, ngram.log_vocabulary(lines)).select("line_key", "node", "key")


@query(
    "ngrams",
    sql("SELECT node, win_no, label, CAST(start AS INTEGER) AS start, ctx, CAST(nxt AS INTEGER) AS nxt FROM grams", "grams"),
)
def ngrams(spark, sf_dir):
    return ngram.ngrams(_sequences(spark, sf_dir))


@query(
    "ngram_transitions",
    sql("SELECT ctx, CAST(nxt AS INTEGER) AS nxt, n, first.node AS first_node,"
        " first.win_no AS first_window, CAST(first.start AS INTEGER) AS first_start FROM transitions",
        "transitions"),
)
def ngram_transitions(spark, sf_dir):
    normal = _sequences(spark, sf_dir).filter("label = 0")
    return ngram.transitions(ngram.ngrams(normal)).select(
        "ctx", "nxt", "n", F.col("first.node").alias("first_node"),
        F.col("first.__place.win_no").alias("first_window"), F.col("first.__place.start").alias("first_start"),
    )


@query(
    "ngram_topk",
    sql("SELECT ctx, CAST(nxt AS INTEGER) AS nxt, n, CAST(rank AS INTEGER) AS rank FROM top_next", "top_next"),
)
def ngram_topk(spark, sf_dir):
    normal = _sequences(spark, sf_dir).filter("label = 0")
    return ngram.top_next(ngram.transitions(ngram.ngrams(normal))).select("ctx", "nxt", "n", "rank")


@query("ngram_detect", sql("SELECT node, win_no, label, pred FROM detected", "detected"))
def ngram_detect(spark, sf_dir):
    return ngram.detect_windows(_keyed(spark, sf_dir))


@query(
    "ngram_metrics",
    sql(
        f"SELECT 'ngram' AS method, tp, fp, tn, fn, {QUALITY_ROUNDED} FROM (SELECT {cells('label', 'pred')} FROM detected)",
        "detected",
    ),
)
def ngram_metrics(spark, sf_dir):
    found = ngram.detect_windows(_keyed(spark, sf_dir))
    return evaluation.compare_methods(found, {"ngram": F.col("pred")})
