"""Rollups against sums over what is left."""

import threading
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from vigilog.llm.queries import VERSIONS, QUERIES
from vigilog.llm.rollups import Rollups, changes_of, deltas, token_count

CHANGES = "op string, source string, lang string, version string, tokens bigint, old_tokens bigint, documents int"


def totals(rollups):
    return {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in rollups.totals().collect()}


def test_signed_changes(spark):
    rows = [("insert", "a", "en", "v", 5, None, 9), ("insert", "a", "en", "v", 5, None, 9), ("delete", "a", "en", "v", None, 5, 9),
            ("revise", "a", "en", "v", 7, 5, 9), ("insert", None, None, None, None, None, 9), ("delete", "b", "en", "v", 3, 4, 9)]
    out = {tuple(r)[:3]: tuple(r)[3:] for r in deltas(spark.createDataFrame(rows, CHANGES)).collect()}
    assert out == {("a", "en", "v"): (1, 7), (None, None, None): (1, 0), ("b", "en", "v"): (-1, -4)}
    assert deltas(spark.createDataFrame([], CHANGES)).collect() == []
    with pytest.raises(Exception, match="unknown operation"):
        deltas(spark.createDataFrame([(None, "a", "b", "c", 1, 1, 1)], CHANGES)).collect()


def test_commits_are_idempotent(spark, tmp_path):
    rollups = Rollups(spark, f"file://{tmp_path}/r")
    assert rollups.totals().collect() == [] and rollups.version() == 0
    docs = spark.createDataFrame([("a", "en", 5), ("a", "en", 6), (None, "de", 7)], "source string, lang string, n bigint")
    assert rollups.commit("one", changes_of(docs, "insert", "v1", "n"))
    assert not rollups.commit("one", changes_of(docs, "insert", "v1", "n"))
    assert totals(rollups) == {("a", "en", "v1"): (2, 11), (None, "de", "v1"): (1, 7)}
    assert rollups.commit("two", changes_of(docs.filter("source = 'a'"), "delete", "v1", None, "n"))
    assert rollups.commit("three", changes_of(docs.limit(0), "insert", "v1", "n"))
    assert not Rollups(spark, f"file://{tmp_path}/r").commit("two", changes_of(docs, "delete", "v1", None, "n"))
    assert totals(rollups) == {(None, "de", "v1"): (1, 7)} and rollups.version() == 3


def test_writers_at_once_lose_nothing(spark, tmp_path):
    docs = spark.createDataFrame([("a", "en", 5)], "source string, lang string, n bigint")
    Rollups(spark, f"file://{tmp_path}/r").commit("start", changes_of(docs, "insert", "v", "n"))
    work = [threading.Thread(target=lambda i=i: Rollups(spark, f"file://{tmp_path}/r").commit(f"b{i % 3}", changes_of(docs, "insert", "v", "n"))) for i in range(5)]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert totals(Rollups(spark, f"file://{tmp_path}/r")) == {("a", "en", "v"): (4, 20)}


def test_counts(spark):
    count = token_count(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    df = spark.createDataFrame([("one two",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(count("text")).collect()] == [2, 0, 0]


def test_query_against_what_is_left(spark, sf_dir):
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic == 1}
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.doc_id not in toxic]
    expected = Counter()
    for version, name in VERSIONS.items():
        from vigilog.llm.byte_pairs import Ranks

        with open(public_tokenizers.path(name), "rb") as file:
            table = Ranks(file.read(), public_tokenizers.PATTERN).rank
        encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        for r in docs:
            text = "\n".join(dict.fromkeys((r.text or "").split("\n")))
            expected[(r.source, r.lang, version, "documents")] += 1
            expected[(r.source, r.lang, version, "tokens")] += len(encoding.encode_ordinary(text))
    out = Counter()
    for r in QUERIES["op3_token_rollups"](spark, sf_dir).collect():
        out[(r.source, r.lang, r.version, "documents")], out[(r.source, r.lang, r.version, "tokens")] = r.documents, r.tokens
    assert out == expected
