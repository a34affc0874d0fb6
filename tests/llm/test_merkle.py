"""Merkle manifest: against a plain tree, at several sizes of superblock."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from vigilog.llm.merkle import Manifest
from vigilog.llm.queries import LEAF_FIELDS, QUERIES

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(text):
    return sha256(text.encode()).hexdigest()


def plain(rows, fan=8):
    """doc_id, leaf, subroot, root, proof, folded root of each row (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = nodes[p // fan * fan : p // fan * fan + fan]
                paths[i].append((run[: p % fan], run[p % fan + 1 :]))
            nodes = [h("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
            at = [p // fan for p in at]
        return paths, nodes[0]

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    within = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        within[name] = climb([x[2] for x in groups[name]])
    if not names:
        return []
    across, root = climb([within[name][1] for name in names])
    out = []
    for name, more in zip(names, across, strict=True):
        for (_, _, own, row), path in zip(groups[name], within[name][0], strict=True):
            present = own
            if row[0] is not None and crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                present = leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            node = present
            for before, after in path + more:
                node = h("".join(before) + node + "".join(after))
            proof = h("".join("".join(b) + "".join(a) for b, a in path + more))
            out.append((row[0], own, within[name][1], root, proof, node, node == root))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


def made(spark, rows, **sizes):
    docs = spark.createDataFrame(rows, SCHEMA)
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lower = F.expr("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return Manifest(**sizes).prove(docs, "doc_id", "lang", LEAF_FIELDS, lambda c: F.when(changed, lower).otherwise(F.col(c)) if c == "text" else F.col(c))


@pytest.mark.parametrize("fan, levels", [(2, 1), (2, 2), (8, 1)])
def test_rounds_of_superblocks(spark, fan, levels):
    rng = random.Random(fan * 10 + levels)
    rows = [(i * 3, "s", "en" if rng.random() < 0.8 else rng.choice(["de", "ü", None]), i, f"Text {i} É") for i in range(90)]
    assert order(made(spark, rows, fan=fan, levels=levels).collect()) == order(plain(rows, fan))


def test_nulls_ties_and_odd_rows(spark):
    rows = [(1, "a", "en", 1, "X"), (1, "a", "en", 1, "X"), (1, None, "en", None, "y"), (None, None, None, None, None), (None, "s", None, 5, "Abc"),
            (2**62 + 1, "s", "", 0, ""), (7, "s", "zz", 0, "Long " * 50_000), (-3, "s", "en", -1, "1:x-")]
    found = made(spark, rows)
    assert order(found.collect()) == order(plain(rows))
    assert found.schema["doc_id"].dataType.simpleString() == "bigint"


def test_one_row_and_none(spark):
    (row,) = made(spark, [(5, "s", "en", 1, "a")]).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == h("")
    assert made(spark, []).collect() == []


def test_proofs_and_other_columns(spark):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 grp", "2 place", "3 n", "4 node", "5 block", "6 key")
    found = Manifest().prove(docs, "doc_id", "lang", LEAF_FIELDS, proofs=True).collect()
    for row in found:
        node = row.leaf
        for step in row.proof:
            node = h(step.before + node + step.after)
        assert node == row.root and row.verified
        assert h("".join(s.before + s.after for s in row.proof)) == row.proof_sha256


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(LEAF_FIELDS).collect()]
    found = QUERIES["op13_merkle"](spark, sf_dir).collect()
    assert order(found) == order(plain(rows))
    assert {r.verified for r in found} == {True, False}
