"""The pipeline: each stage on small rows, and the whole against a plain version."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_near_copies import plain_links
from test_simhash import groups
from vigilog.llm.byte_pairs import Ranks
from vigilog.llm.mixing import mix
from vigilog.llm.secrets import REDACTED

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int"


def odd(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(1, long, "en", "a", 1, 1), (2, long, "en", "a", 1, 1), (2, long, "en", "a", 1, 1), (3, None, "en", "b", None, 1), (4, "", None, None, 0, 1),
            (None, long, "en", None, 1, 1), (None, "nameless text of five words", "en", "a", 1, 1), (None, "nameless text of five words", "en", "a", 1, 1),
            (5, "12345 67890 !!!", "en", "a", 1, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_take_odd_rows(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd(spark), sf_dir)
        assert out.columns == corpus_pipeline.COLUMNS
        out.collect()
        assert stage(spark, odd(spark).limit(0), sf_dir).collect() == []
    assert len(corpus_pipeline.encoding_stage(spark, odd(spark), sf_dir).collect()) == 9


def test_language_stage(spark, sf_dir):
    out = corpus_pipeline.language_stage(spark, odd(spark), sf_dir).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 0, 0, 1, 2, 2]


def test_dedup_stage(spark, sf_dir):
    out = corpus_pipeline.dedup_stage(spark, odd(spark), sf_dir).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 1, 3, 5]


def test_secrets_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    secret = "and the token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" is here"
    docs = docs.unionByName(spark.createDataFrame([(-1, secret, "en", "src0", len(secret))], docs.schema))
    out = {r.doc_id: r for r in corpus_pipeline.secrets_stage(spark, docs, sf_dir).collect()}
    for r in docs.collect():
        new = out[r.doc_id]
        assert new.text == r.text or REDACTED in new.text
        assert new.n_chars == len(new.text)
    assert out[-1].text == f"and the token = \"{REDACTED}\" is here"
    assert len(out) == docs.count()


def test_mixing_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.mixing_stage(spark, docs, sf_dir)
    assert out.groupBy("doc_id").count().filter("count > 2").collect() == []
    size = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert abs(size(out) - 1.5 * size(docs)) < 0.1 * size(docs)


def test_mixing_stage_copies(spark, sf_dir):
    """Each document comes as often as the mix takes it, and each source near its target, also below its size."""
    rows = [(i, "w " * (20 + i % 9), "en", "big" if i % 10 else "small", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA.removesuffix(", fp int"))
    times = {r.doc_id: (r.times, r.source, r.target, r.source_size) for r in mix(docs, [1, 1], share=1.0, keep=["doc_id", "source"]).collect()}
    assert {t for t, *_ in times.values()} == {0, 1, 2}
    mixed = corpus_pipeline.mix
    try:
        corpus_pipeline.mix = lambda docs, weights, keep: mixed(docs, [1, 1], share=1.0, keep=keep)
        out = corpus_pipeline.mixing_stage(spark, docs, sf_dir).collect()
    finally:
        corpus_pipeline.mix = mixed
    copies = Counter(r.doc_id for r in out)
    assert all(copies[i] == t for i, (t, *_) in times.items())
    for source in ("big", "small"):
        target, size = next((t, s) for _, name, t, s in times.values() if name == source)
        assert target < size or source == "small"
        assert abs(sum(len(r.text.split()) for r in out if r.source == source) - target) < 30


def test_whole_pipeline(spark, sf_dir):
    """All stages but the learnt one and the mix have an exact plain version; these follow their own input."""
    seen = {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        seen[name] = docs.collect()
    parts = groups(plain_links({r.doc_id: r.text for r in seen["language"]}))
    assert {r.doc_id for r in seen["near_dedup"]} == {min(p) for p in parts.values()}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        table = Ranks(file.read(), public_tokenizers.PATTERN).rank
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((r.doc_id, len(encoding.encode_ordinary(r.text))) for r in seen["mixing"])
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
