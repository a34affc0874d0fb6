"""Per-line features: 26 from the line itself, 4 from the activity of its address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scoring import is_external
from ..functions.text import contains_any, flag
from ..sources.shared import materialise, small_methods
from .lookup import count_keys, lookup

LINE_FEATURES = (
    "is_ssh", "is_hdfs", "is_apache", "is_linux",
    "is_failed_pw", "is_invalid_user", "is_accepted", "is_sudo",
    "is_session", "is_break_in", "is_no_ident", "is_ssh_error",
    "is_root_user", "is_external_ip", "is_susp_sudo",
    "is_hdfs_anomaly", "is_hdfs_error", "hdfs_kw_hit",
    "is_4xx", "is_5xx", "is_sqli", "is_xss", "is_susp_path", "is_scanner_ua",
    "is_brute_signal", "is_unknown",
)
BURST_FEATURES = ("ip_total_count", "ip_fail_count", "ip_freq_norm", "ip_fail_norm")
COMBINED_FEATURES = LINE_FEATURES + BURST_FEATURES


def line_features(parsed: DataFrame) -> DataFrame:
    """Add the 26 columns of ``LINE_FEATURES``; no shuffle.

    Texts that are searched for several words are lower-cased once, in a projection before."""
    small_methods(parsed.sparkSession)
    lowered = parsed.withColumns({"__raw": F.lower("raw"), "__agent": F.lower("user_agent")})
    source, event = F.col("source"), F.col("event_type")
    raw = F.col("__raw")
    path, agent, status = F.col("path"), F.col("__agent"), F.col("status_code")
    tests = {
        "is_ssh": source == "ssh",
        "is_hdfs": source == "hdfs",
        "is_apache": source == "apache",
        "is_linux": source == "linux",
        "is_failed_pw": event == "failed_password",
        "is_invalid_user": event == "invalid_user",
        "is_accepted": event == "accepted_login",
        "is_sudo": event == "sudo_command",
        "is_session": event == "session_event",
        "is_break_in": event == "break_in_attempt",
        "is_no_ident": event == "no_identification",
        "is_ssh_error": event == "ssh_error",
        "is_root_user": F.col("user").isin(*fv.ROOT_USERS),
        "is_external_ip": is_external(F.col("ip")),
        "is_susp_sudo": (event == "sudo_command")
        & contains_any(F.lower("command"), fv.FEATURE_SUDO_WORDS),
        "is_hdfs_anomaly": event == "hdfs_anomaly",
        "is_hdfs_error": F.col("log_level").isin("ERROR", "WARN"),
        "hdfs_kw_hit": (source == "hdfs") & contains_any(raw, fv.FEATURE_HDFS_WORDS),
        "is_4xx": (status >= 400) & (status < 500),
        "is_5xx": status >= 500,
        "is_sqli": contains_any(path, fv.FEATURE_SQLI_WORDS),
        "is_xss": contains_any(path, fv.FEATURE_XSS_WORDS),
        "is_susp_path": contains_any(path, fv.FEATURE_PATH_WORDS),
        "is_scanner_ua": contains_any(agent, fv.FEATURE_SCANNER_WORDS),
        "is_brute_signal": contains_any(raw, fv.FEATURE_BRUTE_WORDS),
        "is_unknown": event == "unknown",
    }
    return lowered.withColumns({name: flag(test) for name, test in tests.items()}).drop("__raw", "__agent")


def ip_burst(parsed: DataFrame, by: str | None = None) -> DataFrame:
    """Add how many lines, and failed tries, the address of a line has in the whole table.

    ``by`` names a string column that cuts the table into batches; each then counts for itself.
    The table is reduced to one row per address and joined back by ``lookup``, so an address
    with a large share of the lines, and the lines without one, are no burden.
    """
    failed = F.col("event_type").isin("failed_password", "invalid_user")
    known = F.col("ip").isNotNull() & (F.col("ip") != "")
    key = "ip" if by is None else "__by_ip"
    keyed = parsed if by is None else parsed.withColumn(key, F.when(known, F.concat(by, F.lit("\x00"), "ip")))
    per_ip = (
        keyed.filter(known)
        .groupBy(key)
        .agg(
            F.count("*").alias("ip_total_count"),
            F.sum(flag(failed)).cast("bigint").alias("ip_fail_count"),
        )
    )
    joined = lookup(keyed, per_ip, key, weight="ip_total_count")
    if by is None:
        lines = parsed.agg(F.greatest(F.count("*"), F.lit(1)).alias("__lines")).scalar()
        joined = joined.withColumn("__lines", lines)
    else:
        joined = lookup(joined, count_keys(parsed, by, "__lines"), by, weight="__lines").drop(key)
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("ip_total_count", "ip_fail_count")}
    return (
        joined.withColumns(counts)
        .withColumns(
            {
                "ip_freq_norm": F.round(F.col("ip_total_count") / F.col("__lines"), 6),
                "ip_fail_norm": F.round(F.col("ip_fail_count") / F.col("__lines"), 6),
            }
        )
        .drop("__lines")
    )


def combined_features(parsed: DataFrame, by: str | None = None) -> DataFrame:
    """All 30 features. The activity of an address counts the lines of every source (of its batch)."""
    return line_features(ip_burst(parsed, by))


def written_features(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """All 30 features of lines that were not written, with the columns to ``keep``.

    The features of the line itself are found in the pass that parses, and only they are written, with the address
    and the event; the lines are read once."""
    own = line_features(parsed).select(*keep, "ip", "event_type", *LINE_FEATURES)
    return ip_burst(materialise(own, "line-features")).drop("ip", "event_type")
