"""Fitted forests as stored versions.

A version is a folder with the nodes, the scaler and a card. It is written under another name and
published by one rename, so a reader sees a whole model or none; versions stay as they are. The card
names the features in their order, the table that trained the model (a digest of its rows) and the
digest of the model's own rows, which is checked on load.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forest import NODE_SCHEMA, Model
from .shared import remove

VERSION = "version="
CARD_SCHEMA = "features array<string>, trained_on string, content string"


def table_digest(df: DataFrame, columns: Sequence[str]) -> str:
    """A digest of the rows of a table, whatever their order and partitions. Repeated rows count."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    parts = [F.conv(F.substring(F.md5(text), at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]
    row = df.agg(*[F.coalesce(F.sum(p), F.lit(0)).alias(f"p{i}") for i, p in enumerate(parts)], F.count("*").alias("n")).first()
    return f"{row['n']}-{row['p0']}-{row['p1']}"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions under a path, ascending."""
    where, files = _files(spark, path)
    if not files.exists(where):
        return []
    names = [status.getPath().getName() for status in files.listStatus(where)]
    return sorted(int(m[1]) for m in (re.match(VERSION + r"(\d+)\Z", n) for n in names) if m)


def _content(nodes: DataFrame, scaler: DataFrame) -> str:
    node_columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    return f"{table_digest(nodes, node_columns)}/{table_digest(scaler, ['feature', 'mean', 'scale'])}"


def save_model(model: Model, path: str, trained_on: str | None = None) -> int:
    """Publish a model as the next version under ``path`` and return its number.

    ``trained_on`` is a digest of the training rows (``table_digest``). Two writers that take the same
    number don't mix: the second one's rename fails, and it tries the next.
    """
    spark = model.nodes.sparkSession
    number = (versions(spark, path) or [0])[-1] + 1
    draft = f"{path}/_draft-{spark.sparkContext.applicationId}-{id(model)}-{number}"
    remove(spark, draft)
    model.nodes.write.parquet(f"{draft}/forest_nodes")
    model.scaler.write.parquet(f"{draft}/scaler")
    card = (list(model.features), trained_on, _content(model.nodes, model.scaler))
    spark.createDataFrame([card], CARD_SCHEMA).coalesce(1).write.parquet(f"{draft}/card")
    while True:
        where, files = _files(spark, f"{path}/{VERSION}{number}")
        # Renaming onto a folder would move into it: the name must be free.
        if not files.exists(where) and files.rename(_files(spark, draft)[0], where):
            return number
        number += 1


def load_model(
    spark: SparkSession, path: str, version: int | None = None,
    features: Sequence[str] | None = None, trained_on: str | None = None,
) -> Model:
    """A published version, the last by default.

    Fails if there is none, if ``features`` (names in order) or ``trained_on`` are given and aren't the
    model's, or if its rows aren't those that were saved.
    """
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no model {'' if version is None else version} under {path}; there are {known}")
    folder = f"{path}/{VERSION}{known[-1] if version is None else version}"
    card = spark.read.schema(CARD_SCHEMA).parquet(f"{folder}/card").first()
    if features is not None and list(features) != card["features"]:
        raise ValueError(f"the model takes the features {card['features']}, not {list(features)}")
    if trained_on is not None and trained_on != card["trained_on"]:
        raise ValueError("the model was trained on other rows")
    nodes, scaler = spark.read.parquet(f"{folder}/forest_nodes"), spark.read.parquet(f"{folder}/scaler")
    if _content(nodes, scaler) != card["content"]:
        raise ValueError(f"the rows of {folder} aren't those that were saved")
    return Model(nodes, scaler, tuple(card["features"]))
