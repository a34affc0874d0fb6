"""Queries over files: text logs, label and result files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.operators import fusion, line_rules, reports
from vigilog.operators.evaluation import ablation_lines, ablation_sessions
from vigilog.plans.session_plan import BGL, HDFS, THUNDERBIRD
from vigilog.sources import discovery, labels, results, text_lines
from vigilog.sources.shared import new_path

from . import logs
from .derived import raw_lines
from .registry import QUERIES, query
from .session_queries import CV_SUMMARY
from .sql import QUALITY_ROUNDED, cells, detected_type, line_ablation, num, sql, threat

# Blank lines and white space around lines, to be dropped by the scan.
_PADDED = "CASE WHEN line_key % 13 = 0 THEN '   ' ELSE concat('  ', raw, '\t ') END"
_PADDED_SQL = "CASE WHEN line_key % 13 = 0 THEN '' ELSE trim(raw) END"


def _write_text(spark, sf_dir: str, kind: str, padded: bool = False) -> str:
    """Write a derived log as text files whose names follow the order of the lines."""
    path = new_path(spark, f"{kind}-text")
    lines = raw_lines(spark, sf_dir, kind)
    value = F.expr(_PADDED) if padded else F.col("raw")
    lines.select("line_key", value.alias("value")).repartitionByRange(4, "line_key").sortWithinPartitions(
        "line_key"
    ).select("value").write.text(path)
    return path


@query(
    "scan_lines",
    sql(
        f"""SELECT raw, row_number() OVER (ORDER BY line_key) AS place FROM (SELECT line_key, {_PADDED_SQL} AS raw
        FROM ssh_raw) WHERE raw <> ''""",
        "ssh_raw",
    ),
)
def scan_lines(spark, sf_dir):
    """Lines in input order; the place is the rank of the dense line number among kept lines."""
    from vigilog.operators.ordinals import dense_ordinal, key_buckets

    path = _write_text(spark, sf_dir, "ssh", padded=True)
    lines = text_lines.number_lines(text_lines.scan_all_lines(spark, path)).filter("raw <> ''")
    lines = lines.withColumn("one", F.lit(0))
    placed = dense_ordinal(lines, ["one"], key_buckets(lines, "line_key"), ["line_key"])
    return placed.select("raw", (F.col("ordinal") + 1).alias("place"))


@query(
    "head_lines",
    sql(
        f"""SELECT line_no AS line_key, raw FROM (SELECT row_number() OVER (ORDER BY line_key) - 1 AS line_no,
        {_PADDED_SQL} AS raw FROM ssh_raw) WHERE line_no < 500 AND raw <> ''""",
        "ssh_raw",
    ),
)
def head_lines(spark, sf_dir):
    path = _write_text(spark, sf_dir, "ssh", padded=True)
    return text_lines.head_lines(text_lines.scan_all_lines(spark, path), 500).select("line_key", "raw")


@query(
    "parse_scanned",
    sql("SELECT raw, source, event_type, ip, \"user\", count(*) AS lines FROM ssh GROUP BY ALL", "ssh"),
)
def parse_scanned(spark, sf_dir):
    path = _write_text(spark, sf_dir, "ssh")
    parsed = text_lines.parse_files(spark, path, "ssh")
    return parsed.groupBy("raw", "source", "event_type", "ip", "user").agg(F.count("*").alias("lines"))


_FILES = 4


def _detected(kind: str) -> str:
    joined = (
        f"(SELECT part, string_agg(raw, ' ' ORDER BY line_key) AS t FROM (SELECT *,"
        f" row_number() OVER (PARTITION BY part ORDER BY line_key) AS n FROM (SELECT line_key, trim(raw) AS raw,"
        f" CAST(line_key * {_FILES} // (SELECT max(line_key) + 1 FROM {kind}_raw) AS INTEGER) AS part"
        f" FROM {kind}_raw)) WHERE n <= 10 GROUP BY part)"
    )
    return (
        f"SELECT '{kind}' AS written, part, {detected_type('t')} AS log_type FROM {joined}"
    )


_KINDS = ("ssh", "hdfs", "apache", "linux")


@query(
    "detect_log_type",
    sql(" UNION ALL ".join(_detected(k) for k in _KINDS), *[f"{k}_raw" for k in _KINDS]),
)
def detect_log_type(spark, sf_dir):
    """Every file of the derived logs, each log being written as four."""
    paths = []
    for kind in _KINDS:
        lines = raw_lines(spark, sf_dir, kind).select("line_key", "raw")
        top = lines.agg(F.max("line_key") + 1).scalar()
        part = F.floor(F.col("line_key") * _FILES / top).cast("int")
        paths.append(new_path(spark, f"{kind}-text"))
        lines.withColumn("part", part).repartition("part").sortWithinPartitions("part", "line_key").select(
            "part", "raw"
        ).write.partitionBy("part").text(paths[-1])
    found = text_lines.detect_log_type(text_lines.scan_all_lines(spark, [f"{p}/*" for p in paths]))
    return found.select(
        F.regexp_extract("file", r"vigilog-(\w+)-text", 1).alias("written"),
        F.regexp_extract("file", r"part=(\d+)/", 1).cast("int").alias("part"),
        "log_type",
    )


@query(
    "load_labels",
    sql("SELECT replace(block_id, 'blk_', '') AS block_id, CAST(label AS INTEGER) AS label FROM block_labels", "block_labels"),
)
def load_labels(spark, sf_dir):
    rows = labels.read_label_rows(spark, _write_labels(spark, sf_dir))
    numbers = labels.block_number_labels(rows)
    return numbers.select("block_id", "label")


@query("load_block_labels", sql("SELECT block_id, CAST(label AS INTEGER) AS label FROM block_labels", "block_labels"))
def load_block_labels(spark, sf_dir):
    return labels.block_labels(labels.read_label_rows(spark, _write_labels(spark, sf_dir)))


def _write_labels(spark, sf_dir: str) -> str:
    path = new_path(spark, "labels")
    logs.block_labels(spark, sf_dir).select(
        F.col("block_id").alias("BlockId"),
        F.when(F.col("label") == 1, "Anomaly").otherwise("Normal").alias("Label"),
    ).write.option("header", True).csv(path)
    return path


@query(
    "source_discovery",
    sql(
        """SELECT dataset, count(*) AS lines, CAST(sum(label) AS BIGINT) AS attacks FROM (
          SELECT dataset, label FROM all_logs) GROUP BY dataset""",
        "all_logs",
    ),
)
def source_discovery(spark, sf_dir):
    """A folder with the four sources and the label table."""
    folder = new_path(spark, "sources")
    for kind, name in (("ssh", "SSH.log"), ("hdfs", "HDFS.log"), ("apache", "Apache_2k.log"), ("linux", "Linux.log")):
        raw_lines(spark, sf_dir, kind).select("raw").write.text(f"{folder}/{name}")
    logs.block_labels(spark, sf_dir).select(
        F.col("block_id").alias("BlockId"),
        F.when(F.col("label") == 1, "Anomaly").otherwise("Normal").alias("Label"),
    ).write.option("header", True).csv(f"{folder}/anomaly_label.csv")
    lines = discovery.load_sources(spark, folder, columns=[])
    return lines.groupBy("dataset").agg(
        F.count("*").alias("lines"), F.sum("label").alias("attacks")
    )


# --- result files -----------------------------------------------------------------------
def _methods(table: str, kind) -> str:
    mix = threat("rule_score", "anomaly_score", kind.alpha)
    return " UNION ALL ".join(
        f"SELECT '{kind.name}' AS dataset, '{m}' AS method, tp, fp, tn, fn, {QUALITY_ROUNDED}"
        f" FROM (SELECT {cells('label', p)} FROM {table})"
        for m, p in (
            ("Rule Only", "CAST(rule_score > 0 AS INTEGER)"),
            ("Isolation Forest Only", f"CAST(anomaly_score >= {num(kind.cut)} AS INTEGER)"),
            ("Hybrid (Rule + IF)", f"CAST({mix} >= {num(kind.cut)} AS INTEGER)"),
        )
    )


def _ablations(spark, sf_dir):
    hdfs = ablation_sessions(logs.hdfs_scored(spark, sf_dir), HDFS.alpha, HDFS.cut)
    bgl = ablation_sessions(logs.cluster_scored(spark, sf_dir, "bgl"), BGL.alpha, BGL.cut)
    return {HDFS: hdfs, BGL: bgl}


_METRICS = ["dataset", "method", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "fpr"]


@query(
    "json_results_sink",
    sql(
        f"SELECT {', '.join(_METRICS)} FROM ({_methods('hdfs_scored', HDFS)} UNION ALL {_methods('bgl_scored', BGL)})",
        "hdfs_scored", "bgl_scored",
    ),
)
def json_results_sink(spark, sf_dir):
    """Result documents written as JSON and read back as metric rows."""
    paths = []
    for kind, metrics in _ablations(spark, sf_dir).items():
        document = results.result_document(
            metrics, {"dataset": kind.name, "alpha": kind.alpha, "threshold": kind.cut}
        )
        paths.append(new_path(spark, "results"))
        results.write_json(document, paths[-1])
    return results.read_results(spark, paths).select(*_METRICS)


def _write_report(spark, sf_dir) -> dict[str, str]:
    """The documents that the jobs leave: four ablations in two shapes, a baseline, folds; a job that never ran."""
    lines, labelled = logs.ruled_logs(spark, sf_dir)
    predicted = fusion.rule_predictions(logs.stand_in_lines(labelled), line_rules.evaluate_rules(lines))
    tables = logs.cluster_scored(spark, sf_dir, "thunderbird")
    sessions = _ablations(spark, sf_dir) | {THUNDERBIRD: ablation_sessions(tables, THUNDERBIRD.alpha, THUNDERBIRD.cut)}
    documents = {
        "Lines": results.result_document(ablation_lines(predicted), {"total": lines.count()}, by_name=True),
        **{k.name: results.result_document(m, {"dataset": k.name, "alpha": k.alpha}) for k, m in sessions.items()},
        "baseline": QUERIES["ngram_metrics"](spark, sf_dir).withColumn("dataset", F.lit(BGL.name)),
        "folds": QUERIES["cv_summary"](spark, sf_dir).withColumn("dataset", F.lit(BGL.name)),
    }
    catalogue = {"Never run": new_path(spark, "results")}
    for name, document in documents.items():
        catalogue[name] = new_path(spark, "results")
        results.write_json(document, catalogue[name])
    return catalogue


@query(
    "report_comparison",
    sql(
        f"""SELECT c.*, n.f1 AS baseline_f1, f1_mean AS cv_f1_mean, f1_std AS cv_f1_std, fpr_mean AS cv_fpr_mean,
          fpr_std AS cv_fpr_std, round(hybrid_f1 - n.f1, 4) AS f1_gain
        FROM (SELECT dataset, max(total) AS samples,
          max(f1) FILTER (method IN ('Rule Only', 'rule_only')) AS rule_f1,
          max(f1) FILTER (method IN ('Isolation Forest Only', 'isolation_forest')) AS if_f1,
          max(f1) FILTER (method ILIKE '%hybrid%') AS hybrid_f1,
          max(precision) FILTER (method ILIKE '%hybrid%') AS hybrid_precision,
          max(recall) FILTER (method ILIKE '%hybrid%') AS hybrid_recall,
          max(fpr) FILTER (method ILIKE '%hybrid%') AS hybrid_fpr,
          CAST(NULL AS DOUBLE) AS latency_ms
        FROM (SELECT dataset, tp + fp + tn + fn AS total, method, precision, recall, f1, fpr FROM ({_methods('hdfs_scored', HDFS)}
            UNION ALL {_methods('bgl_scored', BGL)} UNION ALL {_methods('thunderbird_scored', THUNDERBIRD)})
          UNION ALL SELECT 'Lines', (SELECT count(*) FROM all_logs), method, precision, recall, f1, fpr FROM ({line_ablation("predicted")}))
        GROUP BY dataset) c
        LEFT JOIN (SELECT '{BGL.name}' AS dataset, {QUALITY_ROUNDED} FROM (SELECT {cells('label', 'pred')} FROM detected)) n USING (dataset)
        LEFT JOIN (SELECT '{BGL.name}' AS dataset, * FROM ({CV_SUMMARY})) f USING (dataset)""",
        "hdfs_scored", "bgl_scored", "thunderbird_scored", "predicted", "detected",
    ),
)
def report_comparison(spark, sf_dir):
    """One row per data set, from the result documents of all jobs."""
    return reports.comparison_report(results.read_documents(spark, _write_report(spark, sf_dir)))


@query(
    "csv_sink",
    sql(
        "SELECT node, win_no, label, seq_len, error_ratio FROM bgl_features",
        "bgl_features",
    ),
)
def csv_sink(spark, sf_dir):
    """A feature table written as CSV with a header and read back."""
    table = logs.cluster_scored(spark, sf_dir, "bgl").select(
        "node", "win_no", "label", "seq_len", "error_ratio"
    )
    path = new_path(spark, "csv")
    results.write_csv(table, path)
    return spark.read.schema(table.schema).option("header", True).csv(path)
