"""Permutation importance of the features of a fitted forest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..sources.shared import materialise
from .forest import HASH_DIGITS, Model, order_key, scale, scorer
from .lookup import count_keys, lookup

#: Rows that are put in order together, about.
BUCKET_ROWS = 32_768


def permutation_importance(
    df: DataFrame,
    model: Model,
    key: Sequence[str],
    seed: int = fv.SEED,
    bucket_rows: int = BUCKET_ROWS,
    by: str | None = None,
) -> DataFrame:
    """Change of the mean score when one feature is shuffled: ``feature``, ``importance``.

    ``by`` names a string column that cuts the rows into batches (null: the batch ''). Rows then are shuffled inside
    their batch, and every batch has its own importances, whose sum is one; a batch of equal rows has zeros.

    All rows count. Rows are put in a circle by an md5 of their key, and a feature is shuffled by taking
    it from the next row of the circle: a random permutation without fixed points, the same for each
    feature, which is scored by itself. So a row meets one other row, whatever the number of
    features, and columns are neither ranked nor unfolded. The circle is cut into buckets of hashes; the
    last row of a bucket takes the first of the next.
    """
    features = list(model.features)
    batch = F.lit("") if by is None else F.coalesce(by, F.lit(""))
    named = df.withColumn("__batch", batch).select(*dict.fromkeys(["__batch", *key, *features]))
    if by is None:
        cut = named.withColumn("__buckets", F.lit(max(1, df.count() // bucket_rows)))
    else:
        sizes = count_keys(named, "__batch", "__rows").withColumn(
            "__buckets", F.greatest(F.lit(1), F.floor(F.col("__rows") / bucket_rows))
        )
        cut = lookup(named, sizes, "__batch", weight="__rows", row_key=key[0]).drop("__rows")
    scaled = scale(cut, model.scaler, features)
    hashed = scaled.withColumn("__at", order_key(F.lit(seed), F.lit("shuffle"), *map(F.col, key)))
    width = F.lit(16.0**HASH_DIGITS) / F.col("__buckets")
    hashed = hashed.withColumn("__bucket", F.floor(F.col("__at") / width).cast("int"))
    own = F.struct(*features)
    rows = materialise(
        hashed.select("__batch", "__buckets", "__bucket", F.struct("__at", *key).alias("__order"), own.alias("__own")),
        "importance",
    )
    # One row per bucket.
    place = ["__batch", "__bucket"]
    firsts = rows.groupBy(*place, "__buckets").agg(F.min_by("__own", "__order").alias("__first"))
    before = F.pmod(F.col("__bucket") - 1, F.col("__buckets")).cast("int")
    firsts = firsts.select("__batch", before.alias("__bucket"), "__first")
    circle = Window.partitionBy(*place).orderBy("__order")
    paired = rows.withColumn("__next", F.lead("__own").over(circle)).join(firsts, place)
    paired = paired.select("__batch", "__own", F.coalesce("__next", "__first").alias("__other"))
    flat = paired.select(
        "__batch",
        *[F.col(f"__own.{name}").alias(f"own{n}") for n, name in enumerate(features)],
        *[F.col(f"__other.{name}").alias(f"other{n}") for n, name in enumerate(features)],
    )
    means = flat.mapInPandas(_sums(model, len(features)), "batch string, j int, s double, n bigint")
    means = means.groupBy("batch", "j").agg((F.sum("s") / F.sum("n")).alias("s"))
    means = materialise(means, "importance-means")  # a row per batch and feature
    base = means.filter("j = -1").select("batch", F.col("s").alias("base"))
    change = means.filter("j >= 0").join(base, "batch").withColumn("change", F.abs(F.col("base") - F.col("s")))
    total = F.sum("change").over(Window.partitionBy("batch")) + F.lit(1e-9)
    names = F.array(*[F.lit(name) for name in features])
    mine = [] if by is None else [F.col("batch").alias(by)]
    return change.select(
        *mine, F.get(names, F.col("j")).alias("feature"), (F.col("change") / total).alias("importance")
    )


def _sums(model: Model, features: int):
    """Sums of scores per batch: as it is (-1) and with each feature from the other row."""
    score = scorer(model.nodes)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, names = pd.factorize(batch.pop("__batch"))
            values = batch.to_numpy(dtype=float)
            own, other = values[:, :features], values[:, features:]
            rows = np.bincount(codes, minlength=len(names))
            base = score(0, own)
            for j in range(-1, features):
                scores = base
                if j >= 0:
                    # Most features of most rows are those of the other row as well, and their score is known.
                    differs = np.flatnonzero(own[:, j] != other[:, j])
                    changed = own[differs]
                    changed[:, j] = other[differs, j]
                    scores = base.copy()
                    scores[differs] = score(0, changed)
                sums = np.bincount(codes, weights=scores, minlength=len(names))
                yield pd.DataFrame({"batch": names, "j": j, "s": sums, "n": rows})

    return sums


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def top_features_by(importance: DataFrame, by: str, n: int) -> DataFrame:
    """The most important features of each batch, with ``rank`` from 1; equal to 6 digits means equal."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round("importance", 6)), "feature")
    return importance.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
