"""SimHash and vantage-point trees against plain versions."""

import re

import numpy as np
import xxhash

from vigilog.llm.components import connected_components
from vigilog.llm.queries import QUERIES
from vigilog.llm.simhash import Forest, ShardTree, fingerprint_of, link_shard, links, near_duplicates


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(pairs):
    """Components of a mapping or of edges, as a set of frozen sets."""
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    out = {}
    for x in list(parent):
        out.setdefault(root(x), set()).add(x)
    return out


def near_pairs(points, radius):
    return [(a, b) for i, a in enumerate(points) for b in points[i:] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius]


def clustered(n, copies, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = base[: n // 20].repeat(copies)
    for _ in range(4):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64))
    return np.unique(np.concatenate([base, near]))


def test_fingerprint():
    for text in [None, "", " \n", "One", "a b c", "A b C d", "a b c d e f", "a b ÄÖ ä\x1cb x", "x y z w " * 50]:
        assert fingerprint_of(text) % (1 << 64) == plain_fingerprint(text), text


def test_trees_lose_no_link():
    points = clustered(1000, 12)
    expected = set(map(frozenset, groups(near_pairs(points.tolist(), 4)).values()))
    for shards in (1, 3, 8):
        tree = ShardTree(np.sort(points[::3]), shards)
        at, shard, home = tree.place(points, 4)
        assert home.sum() == len(points)
        edges = [(p, p) for p in points.tolist()]
        for k in range(tree.shards):
            inside, away = at[(shard == k) & home], at[(shard == k) & ~home]
            both = points[np.concatenate([inside, away])].tolist()
            edges += [(both[a], both[b]) for a, b in link_shard(points[inside], points[away], 4)]
        assert set(map(frozenset, groups(edges).values())) == expected


def test_group_of_thousands_gives_a_forest():
    points = clustered(20, 4000)
    edges = link_shard(points, points[:0], 4)
    forest = Forest(len(points))
    for a, b in edges:
        forest.join(a, b)
    assert len(edges) < len(points) and len(forest.edges) == len(edges)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (5, 5), (None, 3), (300, 301), (300, 301)]
    rows = connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()
    found = {r.node: r.component for r in rows}
    assert len(rows) == len(found)
    assert found == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_links_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr("vigilog.llm.simhash.SHARD_POINTS", 100)
    points = clustered(400, 10).astype(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in points], "fp bigint")
    found = [(r.a, r.b) for r in links(df).collect()] + [(p, p) for p in points]
    assert set(map(frozenset, groups(found).values())) == set(map(frozenset, groups(near_pairs(points, 4)).values()))


def test_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text, 1), (3, text, 2), (3, text, 2), (9, None, 3), (8, "", 4), (None, text, 5), (None, "only here once more", 6), (7, "x y", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    found = near_duplicates(df.select("doc_id", "text", "fp")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found) == [
        (-1, -1), (-1, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 8),
    ]
    assert near_duplicates(df.limit(0)).collect() == []


def test_query_against_all_pairs(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    parts = groups([(a, b) for i, a in enumerate(ids) for b in ids[i:] if (prints[a] ^ prints[b]).bit_count() <= 4])
    expected = {x: min(part) for part in parts.values() for x in part}
    rows = QUERIES["op5_simhash"](spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", expected[i]) for i in ids}
