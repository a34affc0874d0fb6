"""Metrics against published counts and brute force."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from vigilog.functions import fixed_values as fv
from vigilog.operators import evaluation, fusion, ngram

PUBLISHED = {
    (79227, 28668, 262811, 17027): (0.7343, 0.8231, 0.7762, 0.0984),
    (8155, 5891, 552332, 8683): (0.5806, 0.4843, 0.5281, 0.0106),
    (67920, 155731, 269737, 16): (0.3037, 0.9998, 0.4659, 0.3660),
    (0, 0, 10, 0): (0.0, 0.0, 0.0, 0.0),
}


def test_published_metrics(spark):
    counts = spark.createDataFrame(list(PUBLISHED), "tp bigint, fp bigint, tn bigint, fn bigint")
    for r in evaluation.quality(counts).collect():
        assert (r["precision"], r["recall"], r["f1"], r["fpr"]) == PUBLISHED[r["tp"], r["fp"], r["tn"], r["fn"]]


def test_single_class_counts_as_true_positives(spark):
    row = evaluation.confusion_metrics(spark.createDataFrame([(0, 0)] * 7, "label int, pred int")).first()
    assert (row["true_positives"], row["true_negatives"], row["accuracy"], row["f1_score"]) == (7, 0, 1.0, 0.0)


def sessions(spark, n=400):
    rng = random.Random(1)
    rows = [(rng.randrange(2), rng.choice([0.0, 0.7, 0.8, 1.0]), rng.random()) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "label int, rule_score double, anomaly_score double")


def test_sweep_equals_brute_force(spark):
    rows, df = sessions(spark)
    for r in evaluation.sweep(df, fv.TUNE_ALPHAS, fv.TUNE_THRESHOLDS).collect():
        preds = [(y, a * 1) for y, a in ((y, r["alpha"] * s + (1 - r["alpha"]) * a >= r["threshold"]) for y, s, a in rows)]
        assert r["tp"] == sum(1 for y, p in preds if y and p)
        assert r["fp"] == sum(1 for y, p in preds if not y and p)
        assert r["tn"] + r["fn"] == sum(1 for _, p in preds if not p)


def test_best_grid_point_is_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (0, 0.0, 0.0)], "label int, rule_score double, anomaly_score double")
    best = evaluation.grid_tune(df).first()
    assert (best["best_alpha"], best["best_threshold"], best["best_f1"]) == (0.0, 0.05, 1.0)


@pytest.mark.parametrize("share", [0.0, 0.001, 0.05, 0.37, 0.5, 0.999, 1.0])
@pytest.mark.parametrize("kind", ["spread", "ties", "one"])
def test_exact_quantile(spark, share, kind):
    rng = np.random.default_rng(3)
    values = {
        "spread": rng.normal(size=5003), "ties": np.round(rng.normal(size=4000), 1), "one": np.array([2.5]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert evaluation.exact_quantile(df, "v", share) == pytest.approx(float(np.quantile(values, share)), abs=1e-12)


def test_folds_are_stratified(spark):
    rows = [(n, int(n % 10 == 0)) for n in range(1003)]
    df = spark.createDataFrame(rows, "k bigint, label int")
    folds = evaluation.stratified_folds(df, ["k"])
    again = evaluation.stratified_folds(df.repartition(9), ["k"])
    assert folds.exceptAll(again).count() == 0
    for label, n in ((0, 902), (1, 101)):
        sizes = [r["count"] for r in folds.filter(f"label = {label}").groupBy("fold").count().collect()]
        assert len(sizes) == 5 and sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_constant_scores(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "k int, raw_score double")
    assert {r["anomaly_score"] for r in fusion.normalise_scores(df).collect()} == {0.0}
    assert {r["anomaly_score"] for r in fusion.normalise_scores(df, eps=True).collect()} == {1.0}


def test_ngrams_equal_brute_force(spark):
    from collections import Counter

    rng = random.Random(5)
    rows = [(f"n{w % 3}", w, int(w % 4 == 0), [rng.randrange(3) for _ in range(12)]) for w in range(90)]
    df = spark.createDataFrame(rows, "node string, win_no bigint, label int, keys array<int>")
    history, k = 2, 2
    table = {}
    for node, w, label, keys in sorted(rows):
        if label == 0:
            for i in range(len(keys) - history):
                table.setdefault(tuple(keys[i:i + history]), Counter())[keys[i + history]] += 1
    usual = {c: {x for x, _ in n.most_common(k)} for c, n in table.items()}
    want = {
        (node, w): int(any(keys[i + history] not in usual.get(tuple(keys[i:i + history]), ()) for i in range(len(keys) - history)))
        for node, w, _, keys in rows
    }
    found = ngram.ngram_detect(df, history, k)
    assert {(r["node"], r["win_no"]): r["pred"] for r in found.collect()} == want
    assert len(set(want.values())) == 2


def test_short_windows_are_never_unusual(spark):
    df = spark.createDataFrame([("n", 0, 1, [1] * 10)], "node string, win_no bigint, label int, keys array<int>")
    assert ngram.ngram_detect(df).first()["pred"] == 0


def test_training_sample_is_bounded(spark):
    rows = [("n", w, 0, [w % 5] * 12) for w in range(50)]
    df = spark.createDataFrame(rows, "node string, win_no bigint, label int, keys array<int>")
    assert ngram.sample_windows(df, 7).count() == 7
    found = ngram.ngram_detect(df, train_windows=1)
    assert found.filter("pred = 0").count() == 10


def test_order_bits_order_as_doubles(spark):
    values = [float("-inf"), -1e308, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, math.nextafter(1.0, 2), 1e308, float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", evaluation.order_bits(F.col("v")).alias("k")).collect()
    keys = [r.k for r in rows]
    assert keys == sorted(keys) and len(set(keys)) == len(values) - 1
    assert all(evaluation.from_order_bits(r.k) == r.v for r in rows)


def test_selection_of_all_distinct_values_counts_digits_only(spark):
    """200,000 distinct values over many powers of ten: a pass reads at most 65,536 counts, and all ranks are right."""
    n = 200_000
    df = spark.range(n).select(F.expr("(hash(id) / 7.0) * pow(10, id % 200 - 100)").alias("v"))
    keys = df.select(evaluation.order_bits(F.col("v")).alias("key"))
    heads = keys.select(F.shiftright("key", 48).alias("h")).distinct().count()
    assert heads <= 1 << evaluation.DIGIT_BITS
    values = sorted(r.v for r in df.collect())
    ranks = [0, 1, n // 3, n - 2, n - 1]
    assert [evaluation.from_order_bits(k) for k in evaluation.select_ranks(keys, ranks)] == [values[r] for r in ranks]
    plan = keys.groupBy(F.shiftright("key", 48)).count()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_quantile_of_no_values(spark):
    assert evaluation.exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None
    one = spark.createDataFrame([(None,), (float("inf"),), (float("inf"),)], "v double")
    assert evaluation.exact_quantile(one, "v", 0.3) == float("inf")


@pytest.mark.parametrize("size, step, history", [(20, 10, 10), (12, 3, 4), (6, 8, 2), (5, 2, 5)])
def test_steps_judged_once_equal_windows(spark, size, step, history):
    """Detection from lines equals detection from window sequences, on nodes over many chunks."""
    rng = random.Random(size)
    rows = [(i, rng.choice("aab"), rng.choice([1, 2, 3]) if rng.random() < 0.3 else i % 3 + 1, int(rng.random() < 0.01)) for i in range(2500)]
    keyed = spark.createDataFrame(rows, "line_key bigint, node string, key int, label int")
    found = ngram.detect_windows(keyed, size, step, history, k=2)
    wanted = ngram.ngram_detect(ngram.key_sequences(keyed, size, step), history, k=2)
    assert sorted(found.collect()) == sorted(wanted.select(found.columns).collect())
    steps = ngram.line_steps(keyed, size, step, history)
    assert steps.count() == steps.select("node", "ordinal").distinct().count() <= len(rows)
