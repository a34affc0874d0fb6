"""Bounded draws of texts to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drawn_texts(rows: DataFrame, most: int) -> DataFrame:
    """The rows of at most ``most`` distinct values of ``text``: those of the smallest hashes, each once.

    Repeated texts count once, so a text that makes up most of a table neither fills the draw nor leaves it
    empty: it is empty only if ``rows`` is. Rows of equal texts must be alike in their other columns. The
    number that bounds the hashes is read by the driver; what is shuffled for it are hashes.
    """
    hashed = rows.withColumn("__hash", F.xxhash64("text"))
    smallest = hashed.select("__hash").distinct().orderBy("__hash").limit(most)
    cut = smallest.agg(F.max("__hash")).first()[0]
    if cut is None:
        return rows.limit(0)
    return hashed.filter(F.col("__hash") <= cut).drop("__hash").dropDuplicates(["text"])
