"""Language models against a plain version, and held-out accuracy."""

import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from vigilog.llm.language import ORDER, ContextModel, _symbols, _windows, identify, train
from vigilog.llm.queries import QUERIES


def counted(texts):
    counts = Counter()
    for lang, text in texts:
        counts.update((lang, int(w)) for w in _windows(_symbols(text)))
    return [(lang, w, n) for (lang, w), n in counts.items()]


def plain_bits(texts, lang, text):
    """Code length by asking contexts one after another, with the bytes already asked for left out."""
    follow = defaultdict(Counter)
    for of, sample in texts:
        if of == lang:
            raw = b"\0" * ORDER + sample.encode()
            for i in range(ORDER, len(raw)):
                for order in range(ORDER + 1):
                    follow[raw[i - order : i]][raw[i]] += 1

    known = {None: [1 / 256] * 256}

    def chances(context):
        if context not in known:
            shorter = chances(context[1:] if context else None)
            seen = follow.get(context)
            if not seen:
                known[context] = shorter
            else:
                total = sum(seen.values()) + len(seen)
                left = sum(p for b, p in enumerate(shorter) if b not in seen)
                known[context] = [seen[b] / total if b in seen else len(seen) / total * p / left for b, p in enumerate(shorter)]
        return known[context]

    raw = b"\0" * ORDER + text.encode()
    return sum(-math.log2(chances(raw[i - ORDER : i])[raw[i]]) for i in range(ORDER, len(raw)))


def test_exact_code_lengths():
    texts = [("de", "die der das ist über"), ("en", "the there is and of the"), ("en", "a band"), ("xx", "zz")]
    model = ContextModel(counted(texts))
    for text in ["the die", "über", "", "q漢!", "zzzz the"]:
        for lang, bits in zip(model.languages, model.code_lengths(text), strict=True):
            assert abs(bits - plain_bits(texts, lang, text)) < 1e-3, (lang, text)


def test_long_texts_are_read_whole():
    model = ContextModel(counted([("a", "ab" * 50), ("b", "ba cd" * 50)]))
    piece = "ab cd " * 1000
    whole = model.code_lengths(piece * 300)
    assert abs(whole[0] / model.code_lengths(piece)[0] - 300) < 1


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op9_language"](spark, sf_dir).collect() if r.held_out and r.lang_pred != "und"]
    assert rows and sum(truth[r.doc_id] == r.lang_pred for r in rows) / len(rows) > 0.95


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", 0), (2, "der hund und die katze", "de", 0), (3, "x", None, 0), (4, None, "fr", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, bits int")
    model = train(df)
    assert model.languages == ["de", "en"]
    probe = spark.createDataFrame(
        [(1, "the dog"), (2, None), (3, ""), (4, "12 34 !!"), (None, "die katze"), (5, "the dog")], "doc_id bigint, text string"
    )
    out = [r.f for r in probe.select(identify(probe, model).alias("f")).collect()]
    assert [x.lang_pred for x in out] == ["en", "und", "und", "und", "de", "en"]
    assert all(0 <= x.score <= 1 for x in out) and out[1].score == 0
    assert train(df.limit(0)) is None
    assert {r.f.lang_pred for r in probe.select(identify(probe, None).alias("f")).collect()} == {"und"}


def test_model_takes_little_beside_its_costs():
    """The driver makes the model: it holds no second table of the longest contexts."""
    rng = np.random.default_rng(5)
    letters = rng.integers(97, 157, (60_000, 4))
    window = np.unique((letters << np.array([24, 16, 8, 0])).sum(axis=1))
    counts = pa.table({"lang": [f"l{i % 2}" for i in range(len(window))], "window": window, "n": np.ones(len(window), np.int64)})
    tracemalloc.start()
    model = ContextModel(counts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2.5 * model.cost.nbytes
