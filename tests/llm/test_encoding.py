"""Byte pairs against the public encoder, and as columns."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilog.llm import byte_pairs
from vigilog.llm.byte_pairs import BytePairs, Ranks
from vigilog.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return Ranks(file.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def public(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def ids(ranks, text):
    return np.frombuffer(ranks.encode(text), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(alphabet="abet hin\n\t'sé漢😀!1  　\x1c", max_size=200)))
def test_same_as_public_encoder(ranks, public, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(ranks, text) == public.encode_ordinary(text)


@pytest.mark.parametrize(
    "text", ["", " ", "  a", "a  ", "<|endoftext|>", "a" * 5000, " " * 3000, "ab" * 4000 + "\n\n", "Zwölf, don't. we'll\n x"]
)
def test_odd_texts(ranks, public, text):
    assert ids(ranks, text) == public.encode_ordinary(text)


def test_table_of_pairs_is_the_vocabulary(ranks):
    with open(PATH, "rb") as file:
        table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    assert table == ranks.rank
    left = np.array([k // ranks.base for k in ranks.pair])
    right = np.array([k % ranks.base for k in ranks.pair])
    assert ranks.pair_rank(left, right).tolist() == list(ranks.pair.values())


def test_columns(spark):
    codec = BytePairs(spark, PATH, public_tokenizers.PATTERN)
    rows = [(1, "one two", 5), (2, None, 6), (3, "", 7), (3, "é" * 70, 8), (None, "one two", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int").drop("ids")
    out = df.select("doc_id", "text", codec.encode("text").alias("ids")).withColumn("back", codec.decode("ids")).collect()
    assert [bytes(r["back"]).decode() for r in out] == [t or "" for _, t, _ in rows]
    assert out[1]["ids"] == [] == out[2]["ids"] and out[0]["ids"] == out[4]["ids"]
    assert df.limit(0).select(codec.encode("text").alias("i")).select(codec.decode("i")).collect() == []


def test_query_against_public_encoder(spark, sf_dir, public):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_byte_pairs"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        tokens = public.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(tokens)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_one_pass_columns(spark):
    codec = BytePairs(spark, PATH, public_tokenizers.PATTERN)
    rows = [(1, "one two"), (2, None), (3, ""), (3, "é" * 70), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = df.select("text", codec.encode_checked("text").alias("c"), codec.encode_decoded("text").alias("d"), codec.encode("text").alias("ids")).collect()
    assert all(r.c.round_trip and r.c.ids == r.d.ids == r.ids and bytes(r.d.decoded) == (r.text or "").encode() for r in out)
    assert df.limit(0).select(codec.encode_checked("text")).collect() == []


def test_small_caches_give_the_same(ranks, public, monkeypatch):
    """Matches that were set aside, and words merged in many lots."""
    monkeypatch.setattr(byte_pairs, "CACHE_BYTES", 2000)
    monkeypatch.setattr(byte_pairs, "SLICE_CHARS", 200)
    monkeypatch.setattr(byte_pairs, "MERGED", 3)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdeé.1") for _ in range(rng.randrange(1, 9))) for _ in range(40)) for _ in range(60)]
    for text, own in zip(texts + texts, ranks.encode_all(texts + texts), strict=True):
        assert np.frombuffer(own, np.int32).tolist() == public.encode_ordinary(text)
    assert len(ranks.words) + len(ranks.older) < 400
