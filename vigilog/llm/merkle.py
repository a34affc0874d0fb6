"""Merkle manifest of a table: a root digest, and for each row a proof that it is under that root.

Rows are leaves. Within a group leaves ascend by a key, and every ``FAN`` consecutive nodes become
one until one is left, the subroot. Subroots, ordered by group, make the root in the same way.

The tree is cut into superblocks of ``FAN ** LEVELS`` leaves. A first pass reduces each superblock to
its top; tops are few and make a table of their own, which is climbed by the same steps, so that any
number of rows needs a logarithm of rounds. On the way back leaves and the outer nodes that their
superblock needs are cogrouped: one call finishes the local reduction, joins local and outer
siblings into proofs, and folds the present content of each row through them. No task holds more
than a superblock, however large a group is.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise

FAN = 8
#: Levels that are reduced together: a superblock has ``FAN ** LEVELS`` leaves.
LEVELS = 3
STEPS = "steps array<struct<before:string,after:string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as text that can't run into its neighbours: ``-`` if null, else bytes, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    """The digest of a row, as binary."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``place``, the position within ``grp`` by ``order``, and ``n``, the size of the group.

    Rows are dealt out by ranges, so a large group spreads over many tasks; only a count per group
    and range meets others. Written, since numbers must not change when a task runs again.
    """
    ranged = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    numbered = materialise(
        ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), name
    )
    stretches = numbered.groupBy("grp", "part").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy("grp")
    upto = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.select(
        F.col("grp").alias("g"),
        F.col("part").alias("p"),
        (F.coalesce(F.sum("rows").over(upto), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(group).alias("n"),
    )
    offsets = materialise(offsets, f"{name}-offsets")
    together = (F.col("grp") == F.col("g")) & (F.col("part") == F.col("p"))
    return numbered.join(offsets, together).withColumn("place", F.col("row") + F.col("shift")).select(*nodes.columns, "place", "n")


def reduced(nodes: list[str], whole: bool, fan: int, levels: int) -> list[list[str]]:
    """The nodes of a superblock level by level: up to one node if it is the ``whole`` group, else ``levels`` up."""
    found = [nodes]
    while len(found[-1]) > 1 if whole else len(found) <= levels:
        below = found[-1]
        found.append([digest("".join(below[i : i + fan])) for i in range(0, len(below), fan)])
    return found


def siblings(level: list[str], at: int, fan: int) -> tuple[str, str]:
    """Digests of the node's run before and after it."""
    start = at - at % fan
    return "".join(level[start:at]), "".join(level[at + 1 : start + fan])


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    """The top that a node gives with its siblings, level by level."""
    for before, after in steps:
        node = digest(before + node + after)
    return node


def _steps(levels: list[list[str]], at: int, fan: int) -> list[tuple[str, str]]:
    found = []
    for level in levels[:-1]:
        found.append(siblings(level, at, fan))
        at //= fan
    return found


def _of_row(steps) -> list[tuple[str, str]]:
    return [(s["before"], s["after"]) for s in steps]


class Manifest:
    """The tree of a table, with the fan and the levels of a superblock as parameters."""

    def __init__(self, fan: int = FAN, levels: int = LEVELS):
        if fan < 2 or levels < 1:
            raise ValueError("a fan of 2 or more and one level or more")
        self.fan, self.levels, self.block = fan, levels, fan**levels

    def _blocked(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.floor(F.col("place") / self.block))

    def tops(self, nodes: DataFrame) -> DataFrame:
        """``grp, place, n, node``: the top of each superblock of ``nodes`` (``grp, place, n, node``)."""
        fan, levels, block = self.fan, self.levels, self.block

        def reduce(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("place")
            size = int(rows["n"].iloc[0])
            top = reduced([x.hex() for x in rows["node"]], size <= block, fan, levels)[-1][0]
            return pd.DataFrame({"grp": rows["grp"].iloc[:1], "place": rows["block"].iloc[:1], "n": -(-size // block), "node": [bytes.fromhex(top)]})

        blocked = self._blocked(nodes.select("grp", "place", "n", "node"))
        found = blocked.groupBy("grp", "block").applyInPandas(reduce, "grp string, place bigint, n bigint, node binary")
        return materialise(found, "merkle-tops")

    def climb(self, nodes: DataFrame) -> DataFrame:
        """``grp, place, steps, top``: siblings of each node up to the top of its group, and that top."""
        fan, levels, block = self.fan, self.levels, self.block
        most = nodes.agg(F.max("n")).first()[0] or 0
        tops = self.tops(nodes)
        if most <= block:
            outer = tops.select("grp", "place", F.array().cast(STEPS.split(" ", 1)[1]).alias("steps"), F.hex("node").alias("top"))
            outer = outer.withColumn("top", F.lower("top"))
        else:
            outer = materialise(self.climb(tops), "merkle-outer")

        def join(key, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("place")
            found = reduced([x.hex() for x in rows["node"]], rows["n"].iloc[0] <= block, fan, levels)
            rest = _of_row(above["steps"].iloc[0])
            steps = [[{"before": b, "after": a} for b, a in _steps(found, i, fan) + rest] for i in range(len(rows))]
            return pd.DataFrame({"grp": key[0], "place": rows["place"], "steps": steps, "top": above["top"].iloc[0]})

        inner = self._blocked(nodes.select("grp", "place", "n", "node")).groupBy("grp", "block")
        return inner.cogroup(outer.groupBy("grp", "place")).applyInPandas(join, f"grp string, place bigint, {STEPS}, top string")

    def prove(self, docs: DataFrame, key: str, group: str, fields: list[str], now: Callable[[str], Column] | None = None, proofs: bool = False) -> DataFrame:
        """Leaf, subroot, root and proof of each row, and whether its present content is still under the root.

        ``fields`` are the columns of a leaf, ``key`` orders leaves in their ``group`` (equal keys by
        their leaf, null first). ``now(field)`` is the present value of a field (as it was, unless given).
        Returns ``key, leaf, subroot, root, proof_sha256`` of the recorded content, ``folded_root``, which
        the present leaf gives with the recorded siblings, and ``verified``; with ``proofs`` also ``proof``,
        the siblings before and after at each level. Null is a value of its own in every column, and a
        null group is one. Repeated rows are leaves each. An empty table gives no rows. Columns not named
        are not looked at.
        """
        fan, levels, block = self.fan, self.levels, self.block
        recorded = leaf([F.col(c) for c in fields])
        present = leaf([now(c) for c in fields]) if now else recorded
        named = docs.select(
            # Null before all others, others by their bytes.
            F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("grp"),
            F.col(key).alias("key"),
            recorded.alias("node"),
            present.alias("present"),
        )
        named = named.withColumn("present", F.when(F.col("present") != F.col("node"), F.col("present")))
        leaves = placed(materialise(named, "merkle-leaves"), ["key", "node"], "merkle-placed")
        tops = self.tops(leaves)
        within = materialise(self.climb(tops), "merkle-within")
        # The top of a group is known to each of its superblocks; the first one names it.
        subroots = within.filter("place = 0").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.unhex("top").alias("node"))
        ranked = materialise(placed(subroots, ["name"], "merkle-subroots"), "merkle-ranked")
        across = self.climb(ranked).withColumnsRenamed({"steps": "more", "top": "root", "place": "at"}).drop("grp")
        across = across.join(ranked.select("name", F.col("place").alias("at")), "at").drop("at")
        outer = within.join(across, F.col("grp") == F.col("name")).select(
            "grp", F.col("place").alias("block"), F.concat("steps", "more").alias("steps"), F.col("top").alias("subroot"), "root"
        )
        outer = materialise(outer, "merkle-outer-nodes")

        def finish(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("place")
            nodes = [x.hex() for x in rows["node"]]
            found = reduced(nodes, rows["n"].iloc[0] <= block, fan, levels)
            rest = _of_row(above["steps"].iloc[0])
            root = above["root"].iloc[0]
            # Siblings above a node as one text, from the top of the superblock down.
            higher = ["".join(b + a for b, a in rest)]
            for level in found[-2:0:-1]:
                higher = ["".join(siblings(level, i, fan)) + higher[i // fan] for i in range(len(level))]
            proof_hashes, folded, lists = [], [], []
            for i, (node, other) in enumerate(zip(nodes, rows["present"], strict=True)):
                own = "".join(siblings(nodes, i, fan)) + higher[i // fan] if len(found) > 1 else higher[0]
                proof_hashes.append(digest(own))
                steps = _steps(found, i, fan) + rest
                folded.append(fold(node if other is None else other.hex(), steps))
                if proofs:
                    lists.append([{"before": b, "after": a} for b, a in steps])
            columns = {
                "key": rows["key"],
                "leaf": nodes,
                "subroot": above["subroot"].iloc[0],
                "root": root,
                "proof_sha256": proof_hashes,
                "folded_root": folded,
                "verified": [x == root for x in folded],
            }
            return pd.DataFrame(columns | ({"proof": lists} if proofs else {}))

        schema = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        schema += f", {STEPS.replace('steps', 'proof', 1)}" if proofs else ""
        inner = self._blocked(leaves.withColumn("key", F.col("key").cast("string"))).groupBy("grp", "block")
        done = inner.cogroup(outer.groupBy("grp", "block")).applyInPandas(finish, schema)
        return done.withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key)
