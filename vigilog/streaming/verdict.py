"""Score log files as they arrive; each file gets a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import drop_invalid_bytes, strip
from ..operators.forest import Model, score
from ..operators.fusion import normalise_scores
from ..operators.line_features import combined_features
from ..operators.line_rules import evaluate_rules
from ..operators.parsing import parse_source
from ..operators.reports import batch_verdict
from ..sources.shared import materialise, workspace

VERDICT_SCHEMA = (
    "batch string, events bigint, rule_hits bigint, rule_score double, anomaly_score double,"
    " threat_score double, severity string, alpha double, verdict string"
)


def read_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the files that arrive in a folder; ``batch`` is the file."""
    return spark.readStream.text(folder).select(
        F.col("_metadata.file_path").alias("batch"),
        F.col("_metadata.file_block_start").alias("split_start"),
        "value",
    )


def judge_lines(lines: DataFrame, source: str, model: Model) -> tuple[DataFrame, DataFrame]:
    """Verdict per ``batch`` and all rule alerts, for raw lines of one source.

    A batch is judged by its own lines alone, whatever arrives with it.

    The parsed lines and the raw scores are written out, since several steps read them.
    """
    parsed = materialise(parse_source(lines, source), "stream-lines")
    alerts = evaluate_rules(parsed, by=["batch"])
    raw = materialise(
        score(combined_features(parsed, by="batch"), model).select("batch", "raw_score"), "stream-scores"
    )
    scored = normalise_scores(raw, by=("batch",)).withColumn("log_type", F.lit(source))
    return batch_verdict(scored, alerts), alerts


def start_verdicts(
    stream: DataFrame, source: str, model: Model, out: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append verdicts and alerts of each micro-batch under ``out``.

    A micro-batch writes to folders of its own number and overwrites them when it is repeated
    after a failure, so results are neither lost nor doubled. Tables in between are removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        lines = (
            batch.select(
                "batch",
                F.struct(
                    F.col("batch").alias("file"),
                    "split_start",
                    F.monotonically_increasing_id().alias("pos"),
                ).alias("line_key"),
                strip(drop_invalid_bytes(F.col("value"))).alias("raw"),
            )
            .filter(F.col("raw") != "")
        )
        with workspace(batch.sparkSession):
            verdicts, alerts = judge_lines(lines, source, model)
            verdicts.write.mode("overwrite").parquet(f"{out}/verdicts/micro_batch={number}")
            alerts.write.mode("overwrite").parquet(f"{out}/alerts/micro_batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
