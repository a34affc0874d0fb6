"""Nearest neighbours against brute force."""

import numpy as np

from vigilog.llm.neighbours import Graph, build_index, nearest, search, usable
from vigilog.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every, k):
    kept = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            kept[i] = min(kept.get(i, v), v)
    out = {}
    for q, v in kept.items():
        if q % every == 0:
            near = [(float(np.sqrt(((np.float64(w) - np.float64(v)) ** 2).sum())), i) for i, w in kept.items() if i != q and len(w) == len(v)]
            out[q] = sorted(near)[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, expected):
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in near}) for q, near in expected.items())
    return hits / sum(map(len, expected.values()))


def test_graph_finds_most():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1500, 24)) + rng.integers(0, 4, (1500, 1)) * 3
    graph = Graph.grow(vectors)
    hits = 0
    for q in range(0, 1500, 15):
        near = np.argsort(((vectors - vectors[q]) ** 2).sum(axis=1))[:10]
        hits += len(set(graph.search(vectors[q], 10, 96)) & set(near.tolist()))
    assert hits / 1000 > 0.95


def test_shards_are_merged(spark, monkeypatch):
    monkeypatch.setattr("vigilog.llm.neighbours.SHARD_POINTS", 150)
    monkeypatch.setattr("vigilog.llm.neighbours.BLOCK_QUERIES", 20)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], 0) for i in range(700)]
    got, expected = found(nearest(spark.createDataFrame(rows, SCHEMA), 10, 10)), brute(rows, 10, 10)
    assert recall(got, expected) > 0.95
    for q, near in got.items():
        assert len(near) == 10 and all(abs(s - e) < 1e-9 for s, e in zip([x[0] for x in near], [x[0] for x in expected[q]]) if s == e)


def test_ties_copies_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(40)] + [(100, [0.0, 2.0], 0), (100, [0.0, 1.0], 0), (200, [0.0, 0.0], 0), (201, None, 0),
            (202, [], 0), (203, [1.0, None], 0), (204, [float("nan"), 1.0], 0), (205, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0),
            (206, [1.0, 2.0, 3.0], 0), (300, [1.0, 2.0, 4.0], 0), (7, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "n")
    assert found(nearest(df, 100, 10)) == brute(rows, 100, 10)
    assert found(nearest(df, 7, 3)) == brute(rows, 7, 3)
    assert nearest(df.limit(0), 100, 10).collect() == []


def test_index_is_flat_and_searchable_again(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)], 0) for i in range(90)]
    points = usable(spark.createDataFrame(rows, SCHEMA))
    index = build_index(points, 4)
    row = index.first()
    assert len(row.vectors) == 90 * 4 and len(row["first"]) == 90 and max(row.flat) < 90
    queries = points.filter("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    assert len(search(index, queries, 3).collect()) == 15


def test_query_recall(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, expected = found(QUERIES["op8_nearest"](spark, sf_dir)), brute(rows, 100, 10)
    assert set(got) == set(expected) and recall(got, expected) >= 0.9
