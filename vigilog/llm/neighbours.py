"""Approximate nearest neighbours by hierarchical navigable small-world graphs.

Equal vectors are one point with its smallest ids. Points are dealt out to shards by hash; each shard
grows its own graph, kept as a row of flat arrays in a written table. Queries go to every shard in
blocks, and the best of all shards are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise

#: Neighbours of a point on an upper layer (twice as many on the lowest), and how many candidates
#: are held while building and while searching.
LINKS = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 96
#: Points of a shard and queries of a block.
SHARD_POINTS = 4096
BLOCK_QUERIES = 4096


class Graph:
    """A small world over the rows of ``vectors``; ``flat[first[i]:]`` holds the neighbours of point
    ``i``: ``2 * LINKS`` places of the lowest layer, then ``LINKS`` of each upper one, -1 where free."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, first: np.ndarray, flat: np.ndarray, entry: int):
        self.vectors, self.levels, self.first, self.flat, self.entry = vectors, levels, first, flat, entry
        self.norms = np.einsum("ij,ij->i", vectors, vectors)

    @classmethod
    def grow(cls, vectors: np.ndarray) -> Graph:
        n = len(vectors)
        draws = np.random.default_rng(n).random(n)
        levels = (-np.log(np.maximum(draws, 1e-12)) / np.log(LINKS)).astype(np.int64)
        places = 2 * LINKS + LINKS * levels
        graph = cls(vectors, levels, np.cumsum(places) - places, np.full(int(places.sum()), -1, np.int64), 0)
        for point in range(1, n):
            graph._insert(point)
        return graph

    def _span(self, point: int, layer: int) -> tuple[int, int]:
        start = int(self.first[point])
        if layer == 0:
            return start, start + 2 * LINKS
        start += 2 * LINKS + LINKS * (layer - 1)
        return start, start + LINKS

    def _distances(self, points: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Squared distances, without the query's own norm."""
        return self.norms[points] - 2 * (self.vectors[points] @ query)

    def _search_layer(self, query: np.ndarray, entries: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest found from the entries, nearest first."""
        seen = np.zeros(len(self.vectors), bool)
        seen[entries] = True
        known = list(zip(self._distances(np.array(entries), query).tolist(), entries, strict=True))
        open_ = list(known)
        heapq.heapify(open_)
        best = [(-d, p) for d, p in known]
        heapq.heapify(best)
        while open_:
            distance, point = heapq.heappop(open_)
            if len(best) >= width and distance > -best[0][0]:
                break
            start, stop = self._span(point, layer)
            near = self.flat[start:stop]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for d, p in zip(self._distances(near, query).tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-d, p))
                    heapq.heappush(open_, (d, p))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, p))
                    heapq.heappush(open_, (d, p))
        return sorted((-d, p) for d, p in best)

    def _choose(self, point: int, candidates: list[int], most: int) -> list[int]:
        """Candidates nearer to the point than to any chosen before; then the nearest others."""
        at = np.array(candidates)
        to_point = self._distances(at, self.vectors[point]) + self.norms[point]
        order = np.argsort(to_point, kind="stable")
        at, to_point = at[order], to_point[order]
        between = self.norms[at][:, None] + self.norms[at][None, :] - 2 * (self.vectors[at] @ self.vectors[at].T)
        closest = np.full(len(at), np.inf)
        chosen, passed = [], []
        for i in range(len(at)):
            if len(chosen) == most:
                break
            if to_point[i] < closest[i]:
                chosen.append(i)
                closest = np.minimum(closest, between[i])
            else:
                passed.append(i)
        return at[chosen + passed[: most - len(chosen)]].tolist()

    def _insert(self, point: int) -> None:
        query, level = self.vectors[point], int(self.levels[point])
        top = int(self.levels[self.entry])
        entries = [self.entry]
        for layer in range(top, level, -1):
            entries = [self._search_layer(query, entries, 1, layer)[0][1]]
        for layer in range(min(top, level), -1, -1):
            found = self._search_layer(query, entries, BUILD_WIDTH, layer)
            entries = [p for _, p in found]
            chosen = self._choose(point, entries, LINKS)
            start, _ = self._span(point, layer)
            self.flat[start : start + len(chosen)] = chosen
            for other in chosen:
                start, stop = self._span(other, layer)
                links = self.flat[start:stop]
                free = np.flatnonzero(links < 0)
                if len(free):
                    links[free[0]] = point
                else:
                    links[:] = self._choose(other, [*links.tolist(), point], stop - start)
        if level > top:
            self.entry = point

    def search(self, query: np.ndarray, k: int, width: int) -> list[int]:
        """The ``k`` nearest points found."""
        entries = [self.entry]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            entries = [self._search_layer(query, entries, 1, layer)[0][1]]
        return [p for _, p in self._search_layer(query, entries, max(k, width), 0)[:k]]


INDEX_SCHEMA = (
    "dim int, shard int, entry int, vectors array<double>, ids array<array<bigint>>,"
    " levels array<int>, first array<int>, flat array<int>"
)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    group = group.assign(least=[min(ids) for ids in group["ids"]]).sort_values("least")
    vectors = np.stack(group["embedding"].to_list()).astype(np.float64)
    graph = Graph.grow(vectors)
    return pd.DataFrame(
        {
            "dim": [vectors.shape[1]],
            "shard": [group["shard"].iloc[0]],
            "entry": [graph.entry],
            "vectors": [vectors.reshape(-1)],
            "ids": [[sorted(ids) for ids in group["ids"]]],
            "levels": [graph.levels],
            "first": [graph.first],
            "flat": [graph.flat],
        }
    )


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, embedding array<double>`` of the rows that take part: an id, and a vector without
    null or non-finite components that isn't all zeros or empty. Of rows with one id the least vector."""
    of = F.col(vector_column).cast("array<double>")
    finite = F.forall(of, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), of.alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists(of, lambda x: x != 0), F.lit(False))
    )
    first = F.row_number().over(Window.partitionBy("vec_id").orderBy("embedding"))
    return rows.withColumn("n", first).filter("n = 1").drop("n")


def build_index(points: DataFrame, keep_ids: int) -> DataFrame:
    """A row of flat arrays per shard of ``usable`` rows; each vector with its ``keep_ids`` least ids.

    The hash of a vector names its shard, so shards have about ``SHARD_POINTS`` different vectors at
    any size of the table. Vectors of different lengths have separate shards.
    """
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    distinct = (
        points.withColumn("n", rank)
        .filter(F.col("n") <= keep_ids)
        .groupBy("embedding")
        .agg(F.collect_list("vec_id").alias("ids"))
    )
    distinct = materialise(distinct, "vectors")
    shards = max(1, -(-distinct.count() // SHARD_POINTS))
    shard = F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")
    dealt = distinct.withColumn("dim", F.size("embedding")).withColumn("shard", shard)
    return materialise(dealt.groupBy("dim", "shard").applyInPandas(_build, INDEX_SCHEMA), "index")


def search(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row of ``query_id, embedding``.

    Euclidean distance in double precision, nearest first, ties by the smaller id; a query doesn't find
    its own id, and only vectors of its own length. The index must keep at least ``k + 1`` ids.
    """
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    asked = (
        queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        .groupBy(F.size("embedding").alias("dim"), "block")
        .agg(F.collect_list("query_id").alias("query_ids"), F.flatten(F.collect_list("embedding")).alias("asked"))
    )
    tasks = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked, ["dim", "block"])

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                vectors = np.asarray(row.vectors).reshape(-1, row.dim)
                graph = Graph(vectors, row.levels, row.first, row.flat, row.entry)
                out: list[tuple[int, int, float]] = []
                for query_id, query in zip(row.query_ids, np.asarray(row.asked).reshape(-1, row.dim), strict=True):
                    near = graph.search(query, k + 1, width)
                    scores = np.sqrt(((vectors[near] - query) ** 2).sum(axis=1))
                    hits = [(s, i) for s, p in zip(scores.tolist(), near, strict=True) for i in row.ids[p] if i != query_id]
                    out += [(query_id, i, s) for s, i in sorted(hits)[:k]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    hits = tasks.repartition("dim", "shard", "block").mapInPandas(answer, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """The ``k`` nearest of every vector whose id is divisible by ``every``, among all others."""
    points = materialise(usable(vectors), "usable")
    index = build_index(points, k + 1)
    queries = points.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    return search(index, queries, k)
