"""Near copies against brute-force Jaccard similarity."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_simhash import groups

from vigilog.llm import near_copies as module
from vigilog.llm import simhash
from vigilog.llm.near_copies import near_copies


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_links(texts):
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    return [(a, b) for a in ids for b in ids if a <= b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def made(rng):
    """Texts with more and more words changed, a group of near copies, short texts, one common passage."""
    passage = [f"common{i}" for i in range(30)]
    texts = {}
    for base in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 40, 300]))]
        for change in range(6):
            new = list(words)
            for _ in range(change * len(words) // 100 + (change > 3)):
                new[rng.randrange(len(new))] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(new + (passage if base % 3 == 0 else []))
    words = [f"h{i}" for i in range(200)]
    for i in range(60):
        new = list(words)
        new[i] = f"y{i}"
        texts[len(texts)] = " ".join(new)
    for text in ("one two", "One two", "one two three four five", "one two three four six", "", None, "   "):
        texts[len(texts)] = text
    return texts


def components(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    return {r.doc_id: r.component_id for r in near_copies(df).collect()}


def test_against_brute_force(spark):
    texts = made(random.Random(3))
    expected = groups(plain_links(texts))
    assert components(spark, texts) == {i: min(p) for p in expected.values() for i in p}
    assert len({min(p) for p in expected.values()}) < len(texts) - 60


@pytest.mark.parametrize("settings", [{"MANY": 1}, {"MANY": 1 << 30}, {"MANY": 2, "MAX_FREQUENT": 10}, {"COUNTED_BYTES": 1}])
def test_order_of_shingles_does_not_matter(spark, monkeypatch, settings):
    texts = made(random.Random(4))
    for name, value in settings.items():
        monkeypatch.setattr(module, name, value)
    expected = groups(plain_links(texts))
    assert components(spark, texts) == {i: min(p) for p in expected.values() for i in p}


def test_counts_are_over_all_documents(spark):
    """Shingles of a passage in every third document are the frequent ones, and come last in the order."""
    passage = " ".join(f"common{i}" for i in range(40))
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) + (" " + passage if i % 3 == 0 else "") for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    found = module._frequent(docs)
    counted = module._hashes(passage)
    assert len(found.codes) == (counted >= 0).sum() > 0 and set(found.times.tolist()) == {20}
    first = found.first(module._hashes(texts[0]))
    assert not set(first.tolist()) & set(counted[counted >= 0].tolist())
    assert len(module._frequent(docs.limit(0)).codes) == 0


def test_stage_against_brute_force(spark, sf_dir):
    """On the table, where fingerprints of four bits miss near copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = groups(plain_links({r.doc_id: r.text for r in docs.collect()}))
    out = corpus_pipeline.dedup_stage(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted({min(p) for p in parts.values()})


def test_fingerprints_link_and_texts_are_checked(spark, monkeypatch):
    """Without the pairs that shingles add, SimHash still finds what lies within its radius, and no link is unchecked."""
    words = [f"w{i}" for i in range(400)]
    texts = {0: " ".join(words), 1: " ".join([*words, "more"]), 2: " ".join(f"v{i}" for i in range(400)), 3: "a b c", 4: "a b d", 5: None, 6: " "}
    prints = {i: simhash.fingerprint_of(t) for i, t in texts.items()}
    assert 0 < (prints[0] ^ prints[1]).bit_count() <= simhash.RADIUS < ((prints[0] ^ prints[2]) & (2**64 - 1)).bit_count()
    monkeypatch.setattr(module, "_often", lambda met: met.select("a", "b").limit(0))
    assert components(spark, texts) == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    # Fingerprints that are all equal link all texts, of which only similar ones stay linked.
    monkeypatch.setattr(simhash, "fingerprint", lambda text: F.lit(7).cast("bigint"))
    assert components(spark, {0: "a b c", 1: "d e f", 2: "A B c"}) == {0: 0, 1: 1, 2: 0}


def test_common_lines_bring_no_texts_together(spark):
    """Shingles of a line in all short documents come last, whatever their hash, so that no document is looked up under them."""
    line = " ".join(f"common{i}" for i in range(12))
    texts = [" ".join(f"w{i}x{j}" for j in range(12)) + " " + line for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    found = module._frequent(docs)
    common = module._hashes(line)
    assert (common < 0).any() and set(found.counts.tolist()) == {80} and len(found.every) == len(common)
    for text in texts:
        assert not set(found.first(module._hashes(text)).tolist()) & set(common.tolist())
        # Only shingles of one document are left, which lead to no other.
        assert len(found.meeting(found.first(module._hashes(text)))) < 3
