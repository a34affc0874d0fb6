"""Dense positions inside groups, without putting a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_BUCKET_WIDTH = 65_536
MAX_BUCKETS = 32_768


def key_buckets(df: DataFrame, key: str) -> Column:
    """Cut the range of an integer order key into at most ``MAX_BUCKETS`` equal stretches.

    One small job reads the smallest and largest key.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return F.lit(0).cast("bigint")
    width = max(MIN_BUCKET_WIDTH, -(-(high - low + 1) // MAX_BUCKETS))
    return F.floor((F.col(key) - F.lit(low)) / F.lit(width))


def dense_ordinal(
    df: DataFrame,
    group: list[str],
    bucket: Column,
    order: list[str],
    out: str = "ordinal",
    total: str | None = None,
) -> DataFrame:
    """Add a dense 0-based position within ``group`` by ``order``, and the size of the group.

    ``bucket`` must not decrease as ``order`` grows. Rows are ranked inside (group, bucket), and
    the rows of the earlier buckets are added. A hot group is thus spread over its buckets, and
    the running totals see one row per (group, bucket). The result depends on the data only,
    not on how rows were partitioned, so a task that runs again gives the same numbers. Group
    columns must not be null.
    """
    keyed = df.withColumn("__bucket", bucket)
    counts = keyed.groupBy(*group, "__bucket").agg(F.count("*").alias("__rows"))
    in_group = Window.partitionBy(*group)
    before = in_group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    columns = {"__offset": F.coalesce(F.sum("__rows").over(before), F.lit(0))}
    if total:
        columns[total] = F.sum("__rows").over(in_group)
    offsets = counts.withColumns(columns).drop("__rows")
    rank = F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy(*order))
    return (
        keyed.withColumn("__rank", rank)
        .join(offsets, [*group, "__bucket"])
        .withColumn(out, F.col("__offset") + F.col("__rank") - 1)
        .drop("__bucket", "__rank", "__offset")
    )
