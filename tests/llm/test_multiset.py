"""Multiset hashes: algebra, likeness and neighbours."""

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilog.llm.multiset import LIKE_LANES, WINDOW, Fingerprint, deleted, edited, fingerprint, inserted, with_next

PARAGRAPHS = st.lists(st.text(alphabet="ab \0é", max_size=40), min_size=1, max_size=6)


@settings(max_examples=100, deadline=None)
@given(PARAGRAPHS, st.randoms())
def test_order_independent_and_incremental(parts, random):
    shuffled = random.sample(parts, len(parts))
    whole = Fingerprint.of("\n".join(parts))
    assert whole == Fingerprint.of("\n".join(shuffled))
    total = Fingerprint()
    for part in parts:
        total = total + Fingerprint.of(part)
    assert total == whole and Fingerprint.parse(str(whole)) == whole
    assert whole - Fingerprint.of(parts[0]) + Fingerprint.of(parts[0]) == whole


def test_different_multisets_differ():
    texts = ["a", "a\na", "a\n", "b", "", "ab", "a b", "a\nb\nc", "a\nb"]
    assert len({str(Fingerprint.of(t)) for t in texts}) == len(texts)
    assert Fingerprint.of(None) == Fingerprint.of("")


def test_likeness():
    a = " ".join(f"word{i * 7919 % 1000}" for i in range(3000))
    b = " ".join(f"other{i * 104729 % 1000}" for i in range(3000))
    one, two = Fingerprint.of(a), Fingerprint.of(b)
    assert one.likeness(one) == 1 and one.likeness(two) < 0.3
    assert 0.3 < one.likeness(Fingerprint.of(edited(a, b))) < 0.7


def test_columns(spark):
    df = spark.createDataFrame([("one\ntwo", "three"), (None, "x"), ("one", None)], "text string, p string")
    row = df.select(fingerprint("text").alias("f"), "p").select("f", inserted("f", "p").alias("more")).withColumn("back", deleted("more", F.lit("three"))).collect()
    assert row[0].more == str(Fingerprint.of("three\none\ntwo")) and row[0].back == row[0].f
    assert row[2].more is None


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, part int")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected = []
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        new = edited(text or "", following or "")
        print_, changed = Fingerprint.of(text), Fingerprint.of(new)
        expected.append((i, len(text or ""), hashlib.sha256(new.encode()).hexdigest(), str(print_), str(changed),
                         print_.likeness(changed), print_.likeness(Fingerprint.of(following))))
    got = [tuple(r) for r in with_next(df.repartition(5)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_next_document(spark, monkeypatch):
    monkeypatch.setattr("vigilog.llm.multiset.RANGE_ROWS", 5)
    check(spark, [(i * 3, f"text {i}\nand é{'x' * i}") for i in range(60)])
    check(spark, [(1, "a"), (1, "a"), (1, "b"), (2, None), (7, ""), (9, "last one")])
    check(spark, [(None, "b"), (None, "a"), (4, "c c c"), (5, "d"), (None, None)])
    check(spark, [(None, "b"), (None, "aaaa")])
    check(spark, [(3, "alone")])
    assert with_next(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_query_takes_all_rows(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    check(spark, docs)


def test_long_repetitive_texts_keep_their_likeness():
    """Megabytes of one passage, against the exact count of windows by lane."""
    rng = random.Random(5)
    passage, other = ("".join(rng.choice("abcdefghij ") for _ in range(900)) for _ in range(2))
    cases = [
        (passage * 9000, passage * 4500 + other * 4500),
        ("ab " * 400_000, "ab " * 200_000 + "cd " * 200_000),
        ("thirty-five characters in sentence " * 100_000, "thirty-five characters in sentence " * 50_000 + "x" * 1_750_000),
    ]
    for left, right in cases:
        lanes = []
        for text in (left, right):
            sums = np.zeros(LIKE_LANES, object)
            windows = Counter(text[i : i + WINDOW].ljust(WINDOW, "\0") for i in range(len(text)))
            for window, times in windows.items():
                one = Fingerprint.of(window).like - Fingerprint.of(window[1:]).like  # the window that starts first
                sums += one.astype(object) * times
            lanes.append(sums)
        a, b = lanes
        assert max(map(abs, [*a, *b])) >= 1 << 15
        expected = 2 * int(a @ b) / (int(a @ a) + int(b @ b))
        one, two = Fingerprint.of(left), Fingerprint.of(right)
        assert abs(one.likeness(two) - min(1.0, max(0.0, expected))) < 1e-9
        assert Fingerprint.parse(str(one)) == one
