"""Order over a whole table without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise


def in_ranges(df: DataFrame, column: str, name: str, ranges: int = 0) -> DataFrame:
    """The rows dealt out by ranges of ``column``, written, with the number of the range in ``part``.

    Ranges ascend with their number, equal values share one, nulls come first.
    """
    ranges = ranges or df.sparkSession.sparkContext.defaultParallelism * 4
    ranged = df.repartitionByRange(ranges, column)
    return materialise(ranged.withColumn("part", F.spark_partition_id()), name)


def positions(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``place``, the 0-based position by ``column``. Only one row per range meets in one task."""
    parts = in_ranges(df, column, name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("part")
        .agg(F.count("*").alias("rows"))
        .select(F.col("part").alias("p"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    )
    rank = F.row_number().over(Window.partitionBy("part").orderBy(column))
    return (
        parts.withColumn("rank", rank)
        .join(offsets, F.col("part") == F.col("p"))
        .withColumn("place", F.col("offset") + F.col("rank") - 1)
        .select(*df.columns, "place")
    )
