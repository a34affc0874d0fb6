"""Ground truth: labels joined from a table, or inferred from the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scoring import is_external
from ..functions.text import contains_any, flag
from .lookup import lookup


def join_labels(lines: DataFrame, labels: DataFrame, key: str = "block_id") -> DataFrame:
    """Label of each line by its block; a line without a known block gets 0."""
    joined = lookup(lines.drop("label"), labels.select(key, "label"), key)
    return joined.withColumn("label", F.coalesce("label", F.lit(0)))


def label_sessions(sessions: DataFrame, labels: DataFrame, key: str = "block_id") -> DataFrame:
    """Label of each session (one row per key, so no key is hot); unknown ones get 0."""
    return sessions.join(labels.select(key, "label"), key, "left").withColumn(
        "label", F.coalesce("label", F.lit(0))
    )


def infer_ssh_labels(parsed: DataFrame) -> DataFrame:
    """Attack lines of an OpenSSH log: all lines of an attacking address, and some events."""
    event = F.col("event_type")
    per_ip = (
        parsed.filter(F.col("ip").isNotNull() & (F.col("ip") != ""))
        .groupBy("ip")
        .agg(
            F.count("*").alias("__lines"),
            F.sum(flag(event == "failed_password")).alias("__failed"),
            F.sum(flag(event == "invalid_user")).alias("__invalid"),
        )
    )
    attacker = (F.col("__failed") >= fv.LABEL_FAILED_PASSWORDS) | (
        F.col("__invalid") >= fv.LABEL_INVALID_USERS
    )
    per_ip = per_ip.select("ip", "__lines", attacker.alias("__attacker"))
    external = is_external(F.col("ip"))
    attack = (
        F.coalesce("__attacker", F.lit(False))
        | (event == "break_in_attempt")
        | ((event == "no_identification") & external)
        | ((event == "accepted_login") & (F.col("user") == "root") & external)
        | ((event == "ssh_error") & external)
    )
    return (
        lookup(parsed, per_ip, "ip", weight="__lines")
        .withColumn("label", flag(attack))
        .drop("__lines", "__attacker")
    )


def infer_apache_labels(parsed: DataFrame) -> DataFrame:
    """Attack lines of a web log: attack text in path or agent, or a flooding address."""
    per_ip = (
        parsed.filter(F.col("ip").isNotNull() & (F.col("ip") != ""))
        .groupBy("ip")
        .agg(F.count("*").alias("__lines"))
    )
    path_words = fv.LABEL_SQLI_WORDS + fv.LABEL_XSS_WORDS + fv.LABEL_PATH_WORDS
    attack = (
        contains_any(F.col("path"), path_words)
        | contains_any(F.lower("user_agent"), fv.LABEL_SCANNER_WORDS)
        | F.coalesce(F.col("__lines") >= fv.LABEL_FLOOD_REQUESTS, F.lit(False))
    )
    return (
        lookup(parsed, per_ip, "ip", weight="__lines")
        .withColumn("label", flag(attack))
        .drop("__lines")
    )


def infer_linux_labels(parsed: DataFrame) -> DataFrame:
    attack = F.col("event_type").isin(*fv.LABEL_LINUX_EVENTS) | contains_any(
        F.lower("raw"), fv.LABEL_LINUX_WORDS
    )
    return parsed.withColumn("label", flag(attack))


def infer_hdfs_labels(parsed: DataFrame) -> DataFrame:
    """Labels of HDFS lines when there is no label table."""
    return parsed.withColumn("label", flag(F.col("event_type") == "hdfs_anomaly"))
