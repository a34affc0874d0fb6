"""Text log files as tables: scan, order, number, cut, detect the format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import contains_any, drop_invalid_bytes, matches, strip
from ..operators.parsing import parse_source
from .shared import materialise

SPLIT = ("file", "split_start")


def scan_all_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every line of the files, blank ones too: ``file``, ``split_start``, ``pos``, ``raw``.

    ``(file, split_start, pos)`` is the order of the input: ``pos`` grows within a split
    whichever task reads it, and the start of the split orders the splits of a file.
    """
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("pos"),
        strip(drop_invalid_bytes(F.col("value"))).alias("raw"),
    )


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Stripped lines without the blank ones; ``line_key`` is the input order."""
    return (
        scan_all_lines(spark, paths)
        .filter(F.col("raw") != "")
        .select(F.struct(*SPLIT, "pos").alias("line_key"), "raw")
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Replace the position columns by ``line_key``, a dense 0-based line number.

    Takes the output of ``scan_all_lines``. It is written out first, because a position may
    differ between two readings of the same file. The lines themselves are not shuffled: one
    row per split is counted, and a line's number is the rows before its split plus its place
    in the split. Running totals go over one row per split, never over lines.
    """
    fixed = materialise(lines, "lines")
    splits = fixed.groupBy(*SPLIT).agg(
        F.count("*").alias("__rows"), F.min("pos").alias("__first")
    )
    before = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    return fixed.join(offsets, list(SPLIT)).select(
        (F.col("__offset") + F.col("pos") - F.col("__first")).alias("line_key"), "raw"
    )


def head_lines(lines: DataFrame, max_lines: int) -> DataFrame:
    """The first lines of the input, counting blank lines, which are then dropped."""
    return number_lines(lines).filter((F.col("line_key") < max_lines) & (F.col("raw") != ""))


def parse_files(spark: SparkSession, paths: str | list[str], source: str) -> DataFrame:
    """Scan and parse files of one source."""
    return parse_source(scan_lines(spark, paths), source)


def detect_log_type(
    lines: DataFrame, by: str = "file", order: Sequence[str] = ("split_start", "pos")
) -> DataFrame:
    """The format of each file, judged by its first ten lines joined to one text.

    Takes ``scan_all_lines``, or any ``raw`` lines cut ``by`` a column and put in ``order``. The rank
    limit is applied before the shuffle, so a file sends at most ten lines per task.
    """
    order = Window.partitionBy(by).orderBy(*order)
    sample = (
        lines.withColumn("__rank", F.row_number().over(order))
        .filter(F.col("__rank") <= fv.DETECT_SAMPLE_LINES)
        .groupBy(by)
        .agg(F.sort_array(F.collect_list(F.struct("__rank", "raw"))).alias("__lines"))
        .select(by, F.array_join(F.col("__lines.raw"), " ").alias("__text"))
    )
    text = F.col("__text")
    return sample.select(
        by,
        F.when(contains_any(F.lower(text), fv.DETECT_SSH_WORDS), "ssh")
        .when(matches(text, fv.DETECT_HDFS), "hdfs")
        .when(matches(text, fv.DETECT_APACHE), "apache")
        .otherwise("linux")
        .alias("log_type"),
    )
