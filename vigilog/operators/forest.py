"""Isolation forest on Spark: scaler, per-tree samples, tree building, scoring.

Liu, Ting, Zhou: Isolation Forest, ICDM 2008. A model is two small tables, ``forest_nodes`` and
``scaler``; their size depends on the number of trees and features, never on the data.

A training table has a unique ``key`` (one or more columns) and numeric features. With a
``fold`` column, one job trains a forest per fold.

Nothing is drawn from a generator: which rows a tree samples, which feature a node splits and where
follow from md5 sums of the seed, the fold, the tree and the row or node. So a forest depends on its
table alone, and any engine that has md5 can repeat it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv

NODE_SCHEMA = (
    "fold int, tree int, node int, feature int, threshold double, left int, right int,"
    " size int, depth int"
)

#: Hexadecimal digits of an md5 sum that are used: 52 bits, which a double holds.
HASH_DIGITS = 13

#: Places in trees that are walked at a time.
WALKED = 1 << 17

#: Rows whose scores a task keeps.
KNOWN_ROWS = 1 << 16


@dataclass(frozen=True)
class Model:
    nodes: DataFrame
    scaler: DataFrame
    features: tuple[str, ...]


# --- scaler -----------------------------------------------------------------------------


def fit_scaler(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per feature: rows ``feature``, ``mean``, ``scale``.

    A constant feature gets scale 1. All features are aggregated in one pass.
    """
    stats = []
    for name in features:
        value = F.col(name).cast("double")
        stats += [F.avg(value).alias(f"m_{name}"), F.stddev_pop(value).alias(f"s_{name}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.col(f"m_{name}").alias("mean"),
                F.when(F.col(f"s_{name}") == 0, 1.0).otherwise(F.col(f"s_{name}")).alias("scale"),
            )
            for name in features
        ]
    )
    return df.groupBy(*by).agg(*stats).select(*by, F.inline(rows))


def scale(df: DataFrame, scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    """Replace each feature by its scaled value. Missing values count as 0.

    The scaler has one row per feature (and fold), so it is turned into literals.
    """
    rows = scaler.collect()
    if not rows:
        raise ValueError("the scaler was fitted on no rows")
    by_fold: dict[int | None, dict[str, tuple[float, float]]] = {}
    for r in rows:
        fold = r["fold"] if "fold" in scaler.columns else None
        by_fold.setdefault(fold, {})[r["feature"]] = (r["mean"], r["scale"])

    def scaled(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        cases = [
            (fold, (value - F.lit(stats[name][0])) / F.lit(stats[name][1]))
            for fold, stats in by_fold.items()
        ]
        if cases[0][0] is None:
            return cases[0][1]
        return reduce(lambda acc, c: acc.when(F.col("fold") == c[0], c[1]), cases, F)

    return df.withColumns({name: scaled(name) for name in features})


# --- training ---------------------------------------------------------------------------


def sample_trees(
    df: DataFrame, key: Sequence[str], trees: int, psi: int = fv.TREE_SAMPLE, seed: int = fv.SEED
) -> DataFrame:
    """A uniform sample of at most ``psi`` rows per tree, without replacement inside a tree.

    One law at every size: a row is drawn for each tree independently, with the share that gives a
    few rows more than needed, and the smallest hashes win, so every tree gets exactly ``psi`` rows.
    The trees of a row come from uniform numbers: one tells, by the distribution of the first
    hit, the first tree that draws the row, another the next tree. So a row costs as many
    hashes as it has hits, and what is shuffled does not grow with the table.
    """
    sizes = {r["fold"]: r["n"] for r in df.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        raise ValueError("no training rows")
    spare = psi + 8 * psi**0.5 + 16
    parts = []
    for fold, n in sizes.items():
        rows = df.filter(F.col("fold") == fold)
        share = min(1.0, spare / n)
        if share == 1.0:
            hits = F.sequence(F.lit(0), F.lit(trees - 1))
        else:
            first = _next_tree(F.lit(-1), share, key, seed)
            # Rows that no tree draws go before anything is unfolded.
            rows = rows.withColumn("__first", first).filter(F.col("__first") < trees)
            hits = _drawn(share, trees, key, seed)
        each = rows.withColumn("tree", F.explode(hits)).withColumn("tree", F.col("tree").cast("int"))
        parts.append(each.withColumn("__u", _unit_hash(key, F.lit(seed), F.col("tree"))).select(*df.columns, "tree", "__u"))
    order = Window.partitionBy("fold", "tree").orderBy("__u", *key)
    picked = reduce(DataFrame.unionByName, parts)
    return (
        picked.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= psi)
        .drop("__u")
    )


def _next_tree(after: Column, share: float, key: Sequence[str], seed: int) -> Column:
    """The next tree that draws the row: a geometric jump, one hash for each."""
    u = _unit_hash(key, F.lit(seed), F.lit("jump"), after)
    jump = F.floor(F.log(1 - u) / F.lit(math.log(1 - share)))
    return (after + 1 + F.least(jump, F.lit(1 << 40))).cast("bigint")


def _drawn(share: float, trees: int, key: Sequence[str], seed: int) -> Column:
    """All trees that draw the row, from ``__first`` on."""

    def step(found: Column, _: Column) -> Column:
        last = F.element_at(found, -1)
        return F.when(
            last >= trees, found
        ).otherwise(F.concat(found, F.array(_next_tree(last, share, key, seed))))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(trees)), F.array("__first"), step)
    return F.filter(found, lambda tree: tree < trees)


def order_key(*parts: Column) -> Column:
    """The first 52 bits of the md5 of values as text, joined by bars: an integer to order or draw by."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("bigint")


def _unit_hash(key: Sequence[str], *more: Column) -> Column:
    return order_key(*more, *map(F.col, key)) / F.lit(float(16**HASH_DIGITS))


def unit(*parts: object) -> float:
    """The same for values in Python: a number in [0, 1)."""
    text = "|".join(map(str, parts)).encode()
    return int(hashlib.md5(text, usedforsecurity=False).hexdigest()[:HASH_DIGITS], 16) / 16**HASH_DIGITS


def _tree_builder(features: list[str], seed: int):
    """The function that builds one tree from its sample (a bounded group of rows)."""

    def build(sample):
        import math

        import numpy as np
        import pandas as pd

        sample = sample.sort_values("rank")
        fold, tree = int(sample["fold"].iloc[0]), int(sample["tree"].iloc[0])
        x = sample[features].to_numpy(dtype=float)
        limit = max(1, math.ceil(math.log2(max(len(x), 2))))
        nodes, todo = [], [(0, 0, np.arange(len(x)))]
        while todo:
            node, depth, rows = todo.pop()
            part = x[rows]
            low, high = part.min(axis=0), part.max(axis=0)
            varying = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(varying):
                nodes.append((fold, tree, node, -1, 0.0, -1, -1, len(rows), depth))
                continue
            feature = int(varying[int(unit(seed, fold, tree, node, "feature") * len(varying))])
            cut = float(low[feature] + unit(seed, fold, tree, node, "cut") * (high[feature] - low[feature]))
            cut = cut if cut < high[feature] else float(low[feature])
            left = part[:, feature] <= cut
            nodes.append((fold, tree, node, feature, cut, 2 * node + 1, 2 * node + 2, len(rows), depth))
            todo.append((2 * node + 1, depth + 1, rows[left]))
            todo.append((2 * node + 2, depth + 1, rows[~left]))
        names = ["fold", "tree", "node", "feature", "threshold", "left", "right", "size", "depth"]
        return pd.DataFrame(nodes, columns=names)

    return build


def fit_nodes(
    scaled: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    trees: int,
    psi: int = fv.TREE_SAMPLE,
    seed: int = fv.SEED,
) -> DataFrame:
    """Tree nodes, at most 2 * psi - 1 per tree. Trees are built in parallel, one per group."""
    columns = dict.fromkeys(["fold", *key, *features])
    sample = sample_trees(scaled.select(*columns), key, trees, psi, seed).select(
        "fold", "tree", "rank", *features
    )
    return sample.groupBy("fold", "tree").applyInPandas(
        _tree_builder(list(features), seed), NODE_SCHEMA
    )


def fit(
    df: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    trees: int = fv.SESSION_TREES,
    psi: int = fv.TREE_SAMPLE,
    seed: int = fv.SEED,
) -> Model:
    """Train on the normal rows (``label`` = 0) of a table.

    The nodes are brought to the driver once (a bounded table), so later uses of the model do
    not train again.
    """
    normal = df.filter(F.col("label") == 0)
    scaler = fit_scaler(normal, features)
    scaler = df.sparkSession.createDataFrame(scaler.collect(), scaler.schema)
    scaled = scale(normal, scaler, features).withColumn("fold", F.lit(0))
    nodes = fit_nodes(scaled, features, key, trees, psi, seed)
    nodes = df.sparkSession.createDataFrame(nodes.collect(), NODE_SCHEMA)
    return Model(nodes, scaler, tuple(features))


# --- scoring ----------------------------------------------------------------------------


def _forest_arrays(nodes: DataFrame):
    """Per fold: feature, threshold and leaf path length of each node, as complete trees.

    A leaf above the last level sends every row left (its threshold is infinite), and its path
    length sits at the place on the last level that rows then reach.
    """
    import numpy as np

    table = nodes.toPandas()
    forests = {}
    for fold, part in table.groupby("fold"):
        trees = sorted(part["tree"].unique())
        depth = int(part["depth"].max())
        inner = 2**depth - 1
        feature = np.zeros((len(trees), max(inner, 1)), dtype=np.int16)
        cut = np.full((len(trees), max(inner, 1)), np.inf)
        length = np.zeros((len(trees), 2**depth))
        for t, (_, tree) in enumerate(part.groupby("tree")):
            for row in tree.itertuples(index=False):
                if row.feature >= 0:
                    feature[t, row.node], cut[t, row.node] = row.feature, row.threshold
                else:
                    place = row.node
                    for _ in range(depth - row.depth):
                        place = 2 * place + 1
                    length[t, place - inner] = row.depth + average_path(row.size)
        psi = int(part.loc[part["node"] == 0, "size"].max())
        forests[int(fold)] = (depth, feature, cut, length, average_path(psi) or 1.0)
    return forests


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    import math

    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n


def _row_hashes(bits):
    """A 64-bit hash of each row of a matrix of bits."""
    import numpy as np

    factors = np.random.default_rng(fv.SEED).integers(1 << 62, size=bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return ((bits ^ (bits >> np.uint64(32))) * factors).sum(axis=1, dtype=np.uint64)


def distinct_rows(x):
    """The distinct rows of a matrix of numbers, and which of them each row is.

    Rows are told apart by a hash of their bits and compared then; should two hashes meet, they are sorted."""
    import numpy as np
    import pandas as pd

    rows = np.ascontiguousarray(x, dtype=float)
    bits = rows.view(np.uint64)
    codes, hashes = pd.factorize(_row_hashes(bits))
    first = np.empty(len(hashes), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(rows))[::-1]
    if (bits[first[codes]] == bits).all():
        return rows[first], codes
    packed = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, first, codes = np.unique(packed, return_index=True, return_inverse=True)
    return rows[first], codes.ravel()


class Known:
    """Scores of rows that a task has seen, by hash and compared then; ``KNOWN_ROWS`` at most, then it begins anew."""

    def __init__(self):
        self.hashes = None

    def scores(self, rows, compute):
        """Scores of distinct rows; ``compute`` gives those of rows not known."""
        import numpy as np

        bits = rows.view(np.uint64)
        hashes = _row_hashes(bits)
        out, new = np.zeros(len(rows)), np.ones(len(rows), dtype=bool)
        if self.hashes is not None:
            at = np.minimum(self.hashes.searchsorted(hashes), len(self.hashes) - 1)
            new = (self.bits[at] != bits).any(axis=1)
            out[~new] = self.values[at[~new]]
        if new.any():
            out[new] = compute(rows[new])
            if self.hashes is None or len(self.hashes) + new.sum() > KNOWN_ROWS:
                self.hashes, self.bits, self.values = np.empty(0, np.uint64), np.empty((0, bits.shape[1]), np.uint64), np.empty(0)
            hashes, bits, values = (np.concatenate(x) for x in ((self.hashes, hashes[new]), (self.bits, bits[new]), (self.values, out[new])))
            order = hashes.argsort(kind="stable")[:KNOWN_ROWS]
            self.hashes, self.bits, self.values = hashes[order], bits[order], values[order]
        return out


def scorer(nodes: DataFrame):
    """A function of a fold's number and a matrix of scaled rows that gives their raw scores.

    Equal rows are scored once in a task, as long as it can keep them: log features repeat a lot. The forest travels
    with the function; its size is bounded by trees and sample size.
    """
    forests = _forest_arrays(nodes)
    known = {number: Known() for number in forests}

    def walk(number, rows):
        import numpy as np

        depth, feature, cut, length, norm = forests[number]
        trees, inner = feature.shape
        first = np.arange(trees)[:, None] * inner
        total = np.zeros(len(rows))
        # All trees take a step at once, for so many rows that the places stay in the cache.
        block = max(1, WALKED // trees)
        for start in range(0, len(rows), block):
            part = rows[start : start + block]
            own = np.arange(len(part)) * part.shape[1]
            place = np.zeros((trees, len(part)), dtype=np.int64)
            for _ in range(depth):
                at = first + place
                right = part.take(own + feature.take(at)) > cut.take(at)
                place = 2 * place + 1 + right
            place -= 2**depth - 1
            for t in range(trees):  # in order, so that sums are those of any other block
                total[start : start + block] += length[t].take(place[t])
        return -np.exp2(-total / trees / norm)

    def score(number, x):
        rows, back = distinct_rows(x)
        return known[number].scores(rows, lambda new: walk(number, new))[back]

    score.folds = list(forests)
    return score


def score_column(nodes: DataFrame, features: Sequence[str], fold: Column | None = None) -> Column:
    """Raw score of scaled rows, in [-1, 0]; lower is more anomalous. Rows come in Arrow batches.

    The features come as one array, whose numbers are the matrix as it is: a column each costs more than the score."""
    of = scorer(nodes)
    width = len(features)

    @F.arrow_udf("double")
    def score(folds: pa.Array, vectors: pa.Array) -> pa.Array:
        import numpy as np

        number = folds.to_numpy(zero_copy_only=False)
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        out = np.zeros(len(x))
        for own in of.folds:
            mine = np.flatnonzero(number == own)
            if len(mine):
                out[mine] = of(own, x if len(mine) == len(x) else x[mine])
        return pa.array(out)

    number = F.lit(0) if fold is None else fold
    return score(number, F.array(*features))


def score(df: DataFrame, model: Model, out: str = "raw_score") -> DataFrame:
    """Add the raw score. Feature columns keep their unscaled values."""
    hidden = [f"__x_{n}" for n in range(len(model.features))]
    copies = df.withColumns({h: F.col(f) for h, f in zip(hidden, model.features)})
    renamed = model.scaler.replace(dict(zip(model.features, hidden)), subset=["feature"])
    scaled = scale(copies, renamed, hidden)
    return scaled.withColumn(out, score_column(model.nodes, hidden)).drop(*hidden)
