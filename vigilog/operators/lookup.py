"""Left join of a large table to a one-row-per-key table when some keys may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise

# A key is hot when it holds more than 1/HOT_SHARE of all rows, so at most HOT_SHARE keys are.
HOT_SHARE = 1000
NULL_SLOTS = 1024
# Rows, and bytes of text, of a table that is sent to all tasks whole. Fixed values.
SENT_ROWS = 100_000
SENT_BYTES = 8_000_000


def count_keys(facts: DataFrame, key: str, out: str = "__weight") -> DataFrame:
    """Rows per key, null keys left out (combined on the map side, so hot keys are cheap)."""
    return facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(out))


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    weight: str | None = None,
    row_key: str = "line_key",
) -> DataFrame:
    """``facts`` left-joined to ``dim`` on the string column ``key``.

    ``dim`` has one row per key. ``weight`` names its column with the number of fact rows of the
    key, and then ``dim`` must hold every key of the facts, so that frequent keys without a
    value of interest are known too; without it the rows are counted here.

    ``dim`` is written, so that it is made once and its rows are counted. Up to ``SENT_ROWS`` rows it goes to all
    tasks, and the facts are not shuffled, whatever the planner takes the size of an aggregate to be. Beyond that hot
    keys go through a broadcast of at most
    ``HOT_SHARE`` rows, a bound that follows from what hot means. All other keys go through a sort-merge
    join; rows without a key, and rows already served, are
    spread there by the hash of ``row_key`` instead of meeting in one task. The hash depends on
    the row only, so a task that runs again sends its rows to the same places.
    """
    values = [c for c in dim.columns if c != key]
    if weight is None:
        weight = "__weight"
        dim = count_keys(facts, key).join(dim, key, "left")
    dim = materialise(dim, "looked-up")
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in dim.dtypes if kind == "string"]
    rows, size = dim.agg(F.count("*"), F.coalesce(F.sum(sum(texts[1:], texts[0])), F.lit(0))).first()
    if rows <= SENT_ROWS and size <= SENT_BYTES:
        sent = dim.select(F.col(key).alias("__key"), F.struct(*values).alias("__found"))
        served = facts.join(F.broadcast(sent), F.col(key) == F.col("__key"), "left")
        return served.select(*facts.columns, *[F.col("__found")[v].alias(v) for v in values])
    total = dim.agg(F.sum(weight).alias("__total")).scalar()
    split = dim.withColumn("__hot", F.col(weight) * HOT_SHARE > total)
    hot = split.filter("__hot").select(
        F.col(key).alias("__hot_key"), F.struct(*values).alias("__hot_values")
    )
    cold = split.filter("NOT __hot").select(
        F.col(key).alias("__cold_key"), F.struct(*values).alias("__cold_values")
    )
    spread = F.concat(
        F.lit("\x00"), F.pmod(F.xxhash64(row_key), F.lit(NULL_SLOTS)).cast("string")
    )
    served = facts.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left").withColumn(
        "__probe",
        F.when(F.col("__hot_key").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spread),
    )
    joined = served.join(cold.hint("merge"), F.col("__probe") == F.col("__cold_key"), "left")
    found = F.coalesce("__hot_values", "__cold_values")
    return joined.withColumn("__found", found).select(
        *facts.columns, *[F.col("__found")[v].alias(v) for v in values]
    )
