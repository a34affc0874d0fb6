"""Failed logins per address over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import is_ssh_source


def with_event_time(parsed: DataFrame, year: int) -> DataFrame:
    """Add ``event_time`` from the time of an OpenSSH line, which has no year."""
    text = F.concat(
        F.lit(f"{year} "), F.regexp_replace(F.initcap("timestamp"), r"\s+", " ")
    )
    return parsed.withColumn("event_time", F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss")))


def brute_force_windows(
    parsed: DataFrame,
    length: str = "10 minutes",
    slide: str | None = None,
    late: str = "10 minutes",
    min_failures: int = 10,
) -> DataFrame:
    """Addresses with many failed passwords in a time window.

    Works on a table and on a stream; on a stream, lines later than ``late`` are dropped and
    the state of closed windows is freed.
    """
    failed = is_ssh_source(F.col("source")) & (F.col("event_type") == "failed_password")
    timed = parsed.filter(failed & F.col("event_time").isNotNull())
    if parsed.isStreaming:
        timed = timed.withWatermark("event_time", late)
    span = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    return (
        timed.groupBy(span.alias("span"), "ip")
        .agg(F.count("*").alias("failures"))
        .filter(F.col("failures") >= min_failures)
        .select(
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "ip",
            "failures",
        )
    )
