"""Weak labels: accuracies recovered from votes alone, and scores."""

import numpy as np
from pyspark.sql import functions as F

from vigilog.llm.quality import fit_labellers, labellers, score
from vigilog.llm.queries import QUERIES

GOOD = "The cat sat on the mat and it was warm. We read that this is a good day for it.\nThey have not gone with her yet, and so we wait here.\n" * 3


def test_accuracies_are_recovered():
    rng = np.random.default_rng(0)
    truth = rng.random(40_000) < 0.7
    accuracy = np.array([0.95, 0.85, 0.75, 0.65, 0.9])
    right = rng.random((len(truth), 5)) < accuracy
    vote = np.where(right, truth[:, None], ~truth[:, None]).astype(int).astype(str)
    vote[rng.random(vote.shape) < 0.2] = "-"
    patterns, counts = np.unique(["".join(v) for v in vote], return_counts=True)
    posterior, found, prior = fit_labellers(list(zip(patterns.tolist(), counts.tolist(), strict=True)))
    assert np.abs(np.array(found) - accuracy).max() < 0.03 and abs(prior - 0.7) < 0.03
    judged = np.array([posterior["".join(v)] >= 0.5 for v in vote])
    assert (judged == truth).mean() > 0.9
    assert fit_labellers([]) == ({}, [], 0.5)


def test_votes(spark):
    bad = "BUY!! NOW### $$$ %%% ***\n" * 30
    df = spark.createDataFrame([(GOOD,), (bad,), ("",)], "text string")
    rows = df.select(*[v.alias(k) for k, v in labellers(F.col("text")).items()]).collect()
    assert all(rows[0][k] == 1 for k in ("common", "capitals")) and rows[0]["letters"] != 0 and rows[0]["abuse"] is None
    assert all(rows[1][k] == 0 for k in ("common", "letters", "capitals", "marks", "lines"))
    assert rows[2]["length"] == 0


def test_scores(spark):
    bad = "BUY!! NOW### $$$ %%% *** IDIOT moron\n" * 30
    rows = [(i, GOOD + f"word{i} more", 1) for i in range(60)] + [(100 + i, bad + f"x{i}", 1) for i in range(20)]
    rows += [(None, GOOD, 1), (200, None, 1), (201, "", 1), (0, GOOD + "word0 more", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    out = score(df).collect()
    assert len(out) == len(rows)
    assert all(r.keep for r in out if r.doc_id is not None and r.doc_id < 60) and not any(r.keep for r in out if r.doc_id and 100 <= r.doc_id < 200)
    assert len({(r.posterior, r.quality) for r in out if r.doc_id == 0}) == 1
    assert score(df.limit(0)).collect() == []


def test_query_follows_labels(spark, sf_dir):
    out = {r.doc_id: (r.posterior + r.quality) / 2 for r in QUERIES["op4_quality"](spark, sf_dir).collect()}
    assert len(out) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [out[i] for i, q in labels.items() if q == 1 and i in out]
    bad = [out[i] for i, q in labels.items() if q == 0 and i in out]
    wins = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert wins > 0.8, wins
