"""SimHash fingerprints and their links, found by vantage-point trees.

Equal fingerprints are one point. A tree grown from a bounded sample of points splits the space by
the Hamming distance to vantage points; its leaves are shards. Every point lives in one shard and is
sent, as a query, to those later shards that a ball around it can reach by the triangle bound. Each
shard grows a tree of its own and prunes by the same bound. A shard gives only the edges of a
spanning forest of what it finds, so a group of thousands of copies gives thousands of edges, not
millions. All is exact: no link is lost.

The space has no small dimension: at a radius of 4 of 64 bits about 0.85 of a node's points survive
each bound, so that the work grows with about the 1.8th power of the number of different
fingerprints.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..sources.shared import materialise
from .components import connected_components

#: Words of a shingle, seed of the hash, differing bits that still link. Fixed values.
SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Points of a shard, and points of the sample for each shard of the upper tree.
SHARD_POINTS = 32_768
SAMPLE_PER_SHARD = 64
MAX_SHARDS = 4096
#: Points below which a node is compared directly.
LEAF_POINTS = 96


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number. Null or no word: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    last = max(1, len(words) - SHINGLE_WORDS + 1)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    stops = ends[min(SHINGLE_WORDS, len(words)) - 1 :]
    hashed = xxhash.xxh64_intdigest
    hashes = np.array(
        [hashed(joined[a : b - 1], SEED) for a, b in zip([0, *ends[: last - 1]], stops, strict=True)], np.uint64
    )
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start : start + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes)).tobytes()
    return int.from_bytes(bits, "big", signed=True)


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(t.as_py()) for t in texts], pa.int64())


def fingerprint(text: Column | str) -> Column:
    """SimHash of lower-cased (A-Z) word shingles, as a ``bigint``; null and wordless texts give 0."""
    return _fingerprints(text)


def as_hex(value: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


class ShardTree:
    """The upper tree: nested lists ``[vantage, limit, inner, outer]`` down to shard numbers."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.shards = 0
        self.root = self._grow(sample, max(1, shards))

    def _grow(self, sample: np.ndarray, shards: int):
        if shards > 1 and len(sample) > 1:
            for vantage in sample[:8]:  # the first that tells the points apart
                distance = _distance(sample, vantage)
                limit = int(np.median(distance))
                if limit == distance.max():
                    limit -= 1
                inner = distance <= limit
                if inner.any() and not inner.all():
                    return [
                        int(vantage), limit,
                        self._grow(sample[inner], (shards + 1) // 2), self._grow(sample[~inner], shards // 2),
                    ]
        self.shards += 1
        return self.shards - 1

    def place(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Point numbers, shards and whether at home: the home of each point, and each later shard
        that holds points within ``radius`` of it, as far as the bounds tell."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def walk(node, at: np.ndarray, home: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, int):
                found.append((at, np.full(len(at), node), home))
                return
            vantage, limit, inner, outer = node
            distance = _distance(points[at], np.uint64(vantage))
            # Shards are numbered from the inside out: a point at home inside goes outside as well, not the reverse.
            lives_in = distance <= limit
            goes_in = np.where(home, lives_in, distance - radius <= limit)
            goes_out = distance + radius > limit
            walk(inner, at[goes_in], home[goes_in])
            walk(outer, at[goes_out], (home & ~lives_in)[goes_out])

        walk(self.root, np.arange(len(points)), np.ones(len(points), bool))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int),) * 3


class Forest:
    """Union of points by number."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[y] = x
            self.edges.append((a, b))


def link_shard(home: np.ndarray, away: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all links among ``home`` and between ``home`` and ``away``.

    Numbers count ``home`` first, then ``away``.
    """
    points = np.concatenate([home, away])
    forest = Forest(len(points))

    def compare(inside: np.ndarray, asking: np.ndarray, joined: bool = False) -> None:
        """``joined``: the points inside hang together already, so one link of a point is enough."""
        block = max(1, (1 << 20) // max(1, len(inside)))
        for start in range(0, len(asking), block):
            part = asking[start : start + block]
            near = np.bitwise_count(points[part, None] ^ points[None, inside]) <= radius
            near &= part[:, None] != inside[None, :]
            if joined:
                rows = np.flatnonzero(near.any(axis=1))
                columns = near[rows].argmax(axis=1)
            else:
                rows, columns = np.nonzero(near)
            for a, b in zip(part[rows].tolist(), inside[columns].tolist(), strict=True):
                forest.join(a, b)

    # inside: points that live in the node; asking: all that may have links there, the former included.
    stack = [(np.arange(len(home)), np.arange(len(points)), 0)]
    while stack:
        inside, asking, tries = stack.pop()
        if len(inside) <= LEAF_POINTS or tries > 8:
            if len(inside):
                compare(inside, asking)
            continue
        vantage_at = inside[(tries * 7919) % len(inside)]
        vantage = points[vantage_at]
        d_inside, d_asking = _distance(points[inside], vantage), _distance(points[asking], vantage)
        # All within the radius of the vantage point hang together by it; links among them add nothing,
        # so those of them that live here need not be asked for again by one another.
        for at in (asking[d_asking <= radius]).tolist():
            if at != vantage_at:
                forest.join(int(vantage_at), at)
        ball, near = inside[d_inside <= radius], d_asking <= radius
        if len(ball) > 1:
            around = asking[~near & (d_asking <= 2 * radius)]
            compare(ball, around, joined=True)
            rest = d_inside > radius
            # The ball's own points still ask for links with the rest of the node, and are no longer inside.
            inside, d_inside = inside[rest], d_inside[rest]
            if not len(inside):
                continue
        limit = int(np.median(d_inside))
        if limit == d_inside.max():
            limit -= 1
        inner = d_inside <= limit
        if not inner.any():
            stack.append((inside, asking, tries + 1))
            continue
        low, high = int(d_inside[inner].min()), int(d_inside[~inner].max())
        stack.append((inside[inner], asking[(d_asking <= limit + radius) & (d_asking >= low - radius)], 0))
        floor = int(d_inside[~inner].min())
        stack.append((inside[~inner], asking[(d_asking >= floor - radius) & (d_asking <= high + radius)], 0))
    return forest.edges


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints within ``radius`` bits of each other.

    ``points`` has one row per different ``fp`` (written, as it is read twice). The result is a
    union of spanning forests: it has the same components as all links, and not more rows than
    points sent to shards.
    """
    count = points.count()
    shards = min(MAX_SHARDS, max(1, count // SHARD_POINTS))
    wanted = SAMPLE_PER_SHARD * shards
    chosen = points.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < F.lit((1 << 40) * min(1.0, wanted / max(1, count))))
    sample = np.array([r["fp"] for r in chosen.select("fp").collect()], np.int64)  # bounded: SAMPLE_PER_SHARD * MAX_SHARDS
    tree = ShardTree(np.sort(sample.view(np.uint64)), shards)

    def place(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            at, shard, home = tree.place(fp.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(shard.astype(np.int32)), pa.array(home.astype(bool))], ["fp", "shard", "home"])

    def link(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy(np.int64)
        at_home = group["home"].to_numpy(bool)
        order = np.concatenate([fp[at_home], fp[~at_home]])
        edges = np.array(link_shard(fp[at_home].view(np.uint64), fp[~at_home].view(np.uint64), radius), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": order[edges[:, 0]], "b": order[edges[:, 1]]})

    placed = points.select("fp").mapInArrow(place, "fp bigint, shard int, home boolean")
    return placed.groupBy("shard").applyInPandas(link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id, component`` of each row of ``doc_id, text``.

    ``component_id`` is the smallest ``doc_id`` reachable over fingerprints that differ in at most
    ``radius`` bits, the row itself included. Rows without ``doc_id`` are linked too; where a
    component has no id at all, ``component_id`` is null. ``component`` is the component's least
    fingerprint as a signed number. Repeated rows stay repeated; null and
    wordless texts have the fingerprint 0. Other columns are not looked at.
    """
    prints = materialise(docs.select("doc_id", fingerprint("text").alias("fp")), "prints")
    points = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    parts = materialise(connected_components(links(points, radius)), "parts")
    # Points without a link are their own component.
    named = points.join(parts, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id")).withColumnRenamed("component", "c")
    by_print = named.join(smallest, F.col("component") == F.col("c")).select(
        F.col("fp").alias("f"), "component_id", "component"
    )
    return prints.join(by_print, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id", "component")
