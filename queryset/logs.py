"""Parsed and labelled logs, and stand-in scores, for the queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.operators import labels, parsing, sessions
from vigilog.sources.shared import materialise

from .derived import BLOCK_ANOMALY_VALUE, block_values, raw_lines

PARTS = (("ssh", 0), ("hdfs", 1), ("apache", 2), ("linux", 3))


def parsed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return parsing.parse_source(raw_lines(spark, sf_dir, kind), kind)


# Columns that rules, alerts and inferred labels read, and the block by which HDFS lines are labelled.
RULE_COLUMNS = ("line_key", "value", "raw", "source", "event_type", "ip", "user", "path", "status_code", "user_agent", "command")
LABEL_COLUMNS = (*RULE_COLUMNS, "block_id")


def stored(spark: SparkSession, sf_dir: str, kind: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Parsed lines written once, for work that reads them more than once; all ``columns`` by default."""
    lines = parsed(spark, sf_dir, kind)
    return materialise(lines.select(*columns) if columns else lines, kind)


def block_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_values(spark, sf_dir).select(
        "block_id", F.when(F.col("top_value") > BLOCK_ANOMALY_VALUE, 1).otherwise(0).alias("label")
    )


def labelled(spark: SparkSession, sf_dir: str, kind: str, columns: tuple[str, ...] = ()) -> DataFrame:
    return with_labels(spark, sf_dir, kind, stored(spark, sf_dir, kind, columns))


def with_labels(spark: SparkSession, sf_dir: str, kind: str, lines: DataFrame) -> DataFrame:
    """Written lines with their labels, which read the lines more than once."""
    if kind == "hdfs":
        numbers = block_labels(spark, sf_dir).withColumn(
            "block_id", F.regexp_replace("block_id", "blk_", "")
        )
        return labels.join_labels(lines, numbers)
    infer = {
        "ssh": labels.infer_ssh_labels,
        "apache": labels.infer_apache_labels,
        "linux": labels.infer_linux_labels,
    }[kind]
    return infer(lines)


def all_logs(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The four line logs as one labelled table; ``columns``, all by default, must hold those that labels need."""
    parts = [
        labelled(spark, sf_dir, kind, columns)
        .withColumn("line_key", F.col("line_key") * 4 + n)
        .withColumn("dataset", F.lit(kind))
        for kind, n in PARTS
    ]
    return reduce(DataFrame.unionByName, parts)


def ruled_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The four line logs, each written once, as one table for rules; and ``line_key, value, ip, label`` of them, written."""
    kinds = [(kind, n, stored(spark, sf_dir, kind, LABEL_COLUMNS)) for kind, n in PARTS]
    own_key = {n: F.col("line_key") * 4 + n for _, n in PARTS}
    lines = [part.withColumn("line_key", own_key[n]) for _, n, part in kinds]
    labels_ = [
        with_labels(spark, sf_dir, kind, part).select(own_key[n].alias("line_key"), "value", "ip", "label")
        for kind, n, part in kinds
    ]
    return reduce(DataFrame.unionByName, lines), materialise(reduce(DataFrame.unionByName, labels_), "labelled")


def unlabelled_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four line logs as one table, for work that needs no labels."""
    parts = [
        parsed(spark, sf_dir, kind).withColumn("line_key", F.col("line_key") * 4 + n)
        for kind, n in PARTS
    ]
    return reduce(DataFrame.unionByName, parts)


def written_logs(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = RULE_COLUMNS) -> DataFrame:
    """``unlabelled_logs`` written once, for jobs that read the lines several times: the columns that they need."""
    return materialise(unlabelled_logs(spark, sf_dir).select(*columns), "logs")


def stand_in_lines(lines: DataFrame) -> DataFrame:
    """A stand-in for the forest on lines: value over the highest value, flagged above 60."""
    top = lines.agg(F.max("value").alias("__top"))
    return lines.crossJoin(F.broadcast(top)).withColumns(
        {
            "anomaly_score": F.col("value") / F.col("__top"),
            "if_pred": F.when(F.col("value") > 60, 1).otherwise(0),
        }
    ).drop("__top")


def cluster_lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    parse = {"bgl": parsing.parse_bgl, "thunderbird": parsing.parse_thunderbird}[kind]
    return parse(raw_lines(spark, sf_dir, kind))


def hdfs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_hdfs_sessions(raw_lines(spark, sf_dir, "hdfs"))


def hdfs_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled block sessions with rules and a stand-in score taken from two features."""
    table = sessions.hdfs_sessions(hdfs_lines(spark, sf_dir))
    score = F.col("error_ratio") * F.lit(0.5) + (F.lit(1.0) - F.col("unique_event_ratio")) * F.lit(0.5)
    return labels.label_sessions(table, block_labels(spark, sf_dir)).withColumn("anomaly_score", score)


def cluster_scored(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Window sessions with rules and a stand-in score, the share of distinct texts."""
    build = {"bgl": sessions.bgl_sessions, "thunderbird": sessions.thunderbird_sessions}[kind]
    return build(cluster_lines(spark, sf_dir, kind)).withColumn("anomaly_score", F.col("unique_ratio"))


def joined_lists(df: DataFrame) -> DataFrame:
    """Rule lists as comma-joined text, for comparison with the oracle."""
    return df.withColumns({c: F.array_join(c, ",") for c in ("rules_hit", "rule_names")})
