"""The forest: samples, trees, scores, stored models, importance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.operators import cross_validation, forest, importance
from vigilog.sources.models import load_model, save_model, table_digest, versions

FEATURES = ["a", "b", "c"]


def table(spark, n=1500, outliers=5):
    rng = np.random.default_rng(0)
    rows = [(i, 0, *map(float, rng.normal(size=2)), 1.0) for i in range(n)]
    rows += [(n + i, 1, 9.0 + i, -9.0, 1.0) for i in range(outliers)]
    return spark.createDataFrame(rows, "k bigint, label int, a double, b double, c double")


def test_scaler_uses_population_deviation_and_keeps_constants(spark):
    df = table(spark, 50, 0)
    stats = {r["feature"]: (r["mean"], r["scale"]) for r in forest.fit_scaler(df, FEATURES).collect()}
    a = np.array([r["a"] for r in df.collect()])
    assert np.allclose(stats["a"], (a.mean(), a.std())) and stats["c"] == (1.0, 1.0)


def test_one_sampling_law_at_every_size(spark):
    for rows in (300, 3000, 40_000):
        df = spark.range(rows).withColumn("fold", F.lit(0))
        picked = forest.sample_trees(df, ["id"], 20)
        assert [r["count"] for r in picked.groupBy("tree").count().collect()] == [256] * 20
        assert picked.exceptAll(forest.sample_trees(df.repartition(5), ["id"], 20)).count() == 0
        # Trees draw independently: two of them share about 256 * 256 / rows rows.
        ids = {}
        for r in picked.collect():
            ids.setdefault(r["tree"], set()).add(r["id"])
        shared = [len(ids[a] & ids[b]) for a in ids for b in ids if a < b]
        mean = 256 * 256 / rows
        assert abs(sum(shared) / len(shared) - mean) < 0.05 * mean + 0.5
    tiny = spark.range(9).withColumn("fold", F.lit(0))
    assert forest.sample_trees(tiny, ["id"], 4).count() == 36


def path_length(nodes, row):
    at = nodes[0]
    while at["feature"] >= 0:
        at = nodes[at["left"] if row[at["feature"]] <= at["threshold"] else at["right"]]
    return at["depth"] + forest.average_path(at["size"])


def test_scores_equal_a_walk_down_the_trees(spark):
    df = table(spark, 300)
    model = forest.fit(df, FEATURES, ["k"], trees=7)
    trees = {}
    for r in model.nodes.collect():
        trees.setdefault(r["tree"], {})[r["node"]] = r
    stats = {r["feature"]: (r["mean"], r["scale"]) for r in model.scaler.collect()}
    norm = forest.average_path(256)
    for r in forest.score(df, model).limit(60).collect():
        row = [(r[f] - stats[f][0]) / stats[f][1] for f in FEATURES]
        depth = np.mean([path_length(t, row) for t in trees.values()])
        assert math.isclose(r["raw_score"], -(2 ** (-depth / norm)), rel_tol=1e-9)


def test_trees_hold_their_whole_sample(spark):
    nodes = forest.fit(table(spark), FEATURES, ["k"], trees=10).nodes
    leaves = nodes.filter("feature < 0").groupBy("tree").agg(F.sum("size").alias("n"), F.max("depth").alias("d"))
    assert all(r["n"] == 256 and r["d"] <= 8 for r in leaves.collect())
    assert nodes.filter("feature = 2").count() == 0


def test_planted_outliers_rank_first_whatever_the_partitions(spark):
    df = table(spark)
    scored = forest.score(df, forest.fit(df, FEATURES, ["k"]))
    lowest = [r["label"] for r in scored.orderBy("raw_score").limit(5).collect()]
    assert lowest == [1] * 5
    again = forest.score(df, forest.fit(df.repartition(6), FEATURES, ["k"]))
    both = scored.select("k", "raw_score").join(again.select("k", F.col("raw_score").alias("s")), "k")
    assert both.filter("abs(raw_score - s) > 1e-12").count() == 0


def test_model_roundtrip(spark, tmp_path):
    df = table(spark, 400)
    model = forest.fit(df, FEATURES, ["k"], trees=10)
    save_model(model, str(tmp_path / "m"))
    loaded = load_model(spark, str(tmp_path / "m"))
    assert loaded.features == model.features
    both = forest.score(forest.score(df, model), loaded, "s")
    assert both.filter("raw_score <> s").count() == 0


def test_importance_finds_the_features_that_vary(spark):
    df = table(spark)
    found = {r["feature"]: r["importance"] for r in importance.permutation_importance(
        df, forest.fit(df, FEATURES, ["k"], trees=20), ["k"]).collect()}
    assert set(found) == set(FEATURES) and found["c"] < 1e-9 < found["a"]
    assert math.isclose(sum(found.values()), 1.0, abs_tol=1e-4) or sum(found.values()) < 1e-6


def test_cross_validation_on_separable_data(spark):
    df = table(spark, 500, 50).withColumn("rule_score", F.col("label").cast("double"))
    folds = cross_validation.cross_validate(df, FEATURES, ["k"], 0.55, 0.5, trees=10).collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4]
    assert all(r["tp"] + r["fn"] == 10 and r["recall"] == 1.0 for r in folds)


def test_model_versions_are_published_whole_and_checked(spark, tmp_path):
    df = table(spark, 300)
    path = str(tmp_path / "m")
    model = forest.fit(df, FEATURES, ["k"], trees=5)
    digest = table_digest(df, ["k", *FEATURES])
    assert digest == table_digest(df.repartition(7), ["k", *FEATURES]) != table_digest(df.filter("k > 0"), ["k", *FEATURES])
    with pytest.raises(FileNotFoundError):
        load_model(spark, path)
    assert save_model(model, path, digest) == 1
    other = forest.fit(df, FEATURES, ["k"], trees=6)
    assert save_model(other, path) == 2 and versions(spark, path) == [1, 2]
    assert load_model(spark, path).nodes.select("tree").distinct().count() == 6
    first = load_model(spark, path, version=1, features=FEATURES, trained_on=digest)
    assert first.nodes.select("tree").distinct().count() == 5
    both = forest.score(forest.score(df, model), first, "s")
    assert both.filter("raw_score <> s").count() == 0
    with pytest.raises(ValueError, match="takes the features"):
        load_model(spark, path, features=FEATURES[::-1])
    with pytest.raises(ValueError, match="other rows"):
        load_model(spark, path, version=2, trained_on=digest)
    # A draft that was never renamed isn't a version; a model whose files changed is refused.
    model.nodes.write.parquet(f"{path}/_draft-lost/forest_nodes")
    assert versions(spark, path) == [1, 2]
    model.nodes.limit(3).write.mode("append").parquet(f"{path}/version=1/forest_nodes")
    with pytest.raises(ValueError, match="aren't those"):
        load_model(spark, path, version=1)
