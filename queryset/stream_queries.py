"""Streaming queries, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.functions import fixed_values as fv
from vigilog.operators import forest
from vigilog.operators.line_features import COMBINED_FEATURES, combined_features
from vigilog.sources.shared import new_path
from vigilog.streaming.bursts import brute_force_windows, with_event_time
from vigilog.streaming.verdict import read_log_stream, start_verdicts

from . import logs
from .derived import raw_lines
from .registry import query
from .sql import sql


@query("stream_verdict")
def stream_verdict(spark, sf_dir):
    """The SSH log arrives as files; each file is parsed, scored and judged."""
    folder, out = new_path(spark, "arriving"), new_path(spark, "verdicts")
    raw_lines(spark, sf_dir, "ssh").select("line_key", "raw").repartitionByRange(4, "line_key").select(
        "raw"
    ).write.text(folder)
    train = combined_features(logs.labelled(spark, sf_dir, "ssh"))
    model = forest.fit(train, COMBINED_FEATURES, ["line_key"], trees=fv.LINE_TREES)
    stream = read_log_stream(spark, folder)
    run = start_verdicts(stream, "ssh", model, out, new_path(spark, "state"), once=True)
    run.awaitTermination()
    return spark.read.parquet(f"{out}/verdicts")


_FAILED = """SELECT ip, CAST(2024 || ' ' || timestamp AS VARCHAR) AS t,
  strptime('2024 ' || timestamp, '%Y %b %d %H:%M:%S') AS event_time FROM ssh
  WHERE event_type = 'failed_password'"""


@query(
    "burst_windows",
    sql(
        f"""SELECT strftime(time_bucket(INTERVAL 6 HOURS, event_time), '%Y-%m-%d %H:%M:%S') AS window_start, ip,
          count(*) AS failures FROM ({_FAILED}) GROUP BY 1, ip HAVING count(*) >= 2""",
        "ssh",
    ),
)
def burst_windows(spark, sf_dir):
    """Tumbling windows over a table."""
    lines = with_event_time(logs.parsed(spark, sf_dir, "ssh"), 2024)
    return _shown(brute_force_windows(lines, "6 hours", min_failures=2))


@query(
    "burst_windows_sliding",
    sql(
        f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, ip, count(*) AS failures FROM (
          SELECT ip, unnest([time_bucket(INTERVAL 3 HOURS, event_time),
            time_bucket(INTERVAL 3 HOURS, event_time) - INTERVAL 3 HOURS]) AS w FROM ({_FAILED}))
        GROUP BY w, ip HAVING count(*) >= 2""",
        "ssh",
    ),
)
def burst_windows_sliding(spark, sf_dir):
    lines = with_event_time(logs.parsed(spark, sf_dir, "ssh"), 2024)
    return _shown(brute_force_windows(lines, "6 hours", "3 hours", min_failures=2))


@query(
    "stream_bursts",
    sql(
        f"""SELECT strftime(time_bucket(INTERVAL 6 HOURS, event_time), '%Y-%m-%d %H:%M:%S') AS window_start, ip,
          count(*) AS failures FROM ({_FAILED}) GROUP BY 1, ip HAVING count(*) >= 2""",
        "ssh",
    ),
)
def stream_bursts(spark, sf_dir):
    """The same windows over a stream of the parsed lines, each given out once, when it closes.

    The lines arrive as files in no order within 60 days, which the watermark allows for. A last line
    far in the future, which matches no address, moves the watermark past the last window.
    """
    source = logs.stored(spark, sf_dir, "ssh")
    folder = new_path(spark, "parsed-stream")
    source.write.parquet(folder)
    closing = source.limit(1).withColumns({"timestamp": F.lit("Dec 31 23:59:59"), "event_type": F.lit("failed_password"),
                                           "source": F.lit("ssh"), "ip": F.lit(None).cast("string")})
    closing.select(*source.columns).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(source.schema).parquet(folder)
    bursts = brute_force_windows(with_event_time(stream, 2024), "6 hours", late="60 days", min_failures=2)
    out = new_path(spark, "bursts")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/micro_batch={number}")

    run = (
        bursts.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", new_path(spark, "state"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return _shown(spark.read.parquet(out))


def _shown(bursts):
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return bursts.select(start, "ip", "failures")
