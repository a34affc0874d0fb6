"""Label tables of HDFS blocks (CSV with the header ``BlockId,Label``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

SCHEMA = "BlockId string, Label string"


def read_label_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of the file with ``line_key``, their order in the input."""
    return spark.read.schema(SCHEMA).option("header", True).csv(path).select(
        "BlockId",
        "Label",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("pos"),
        ).alias("line_key"),
    )


def last_label(rows: DataFrame) -> DataFrame:
    """One row per block: of repeated blocks the last row wins."""
    return rows.groupBy("block_id").agg(F.max_by("label", "line_key").alias("label"))


def block_number_labels(rows: DataFrame) -> DataFrame:
    """``block_id`` without its prefix, ``label`` 1 for any spelling of 'anomaly'."""
    number = F.regexp_replace(strip(F.col("BlockId")), "blk_", "")
    anomalous = F.when(F.lower(strip(F.col("Label"))) == "anomaly", 1).otherwise(0)
    return last_label(rows.select(number.alias("block_id"), anomalous.alias("label"), "line_key"))


def block_labels(rows: DataFrame) -> DataFrame:
    """``block_id`` as written, ``label`` 1 for exactly 'Anomaly'."""
    anomalous = F.when(F.col("Label") == "Anomaly", 1).otherwise(0)
    return last_label(rows.select(F.col("BlockId").alias("block_id"), anomalous.alias("label"), "line_key"))
