"""Boosted trees of several targets: early stopping, a planted signal, margins and contributions."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from labspark.operators import boosting, risk, stats


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 4))
    signal = {"a": (x[:, 0] * x[:, 1] > 0.1), "b": (np.abs(x[:, 2]) > 1), "c": (x[:, 3] > 0.5)}
    rows = [(i, *map(float, r), *(int(s[i] != (rng.random() < 0.1)) for s in signal.values())) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, x3 double, a int, b int, c int").repartition(4).cache()


COLUMNS = ("x0", "x1", "x2", "x3")


def test_three_targets_stop_early_and_beat_the_baseline(spark, cohort):
    models = risk.train_targets(cohort, COLUMNS, ("a", "b", "c"), "id", patience=8, rate=0.3)
    for t, model in models.items():
        assert 0 < len(model.trees.trees) < 120 and len(model.trees.losses) - 1 - len(model.trees.trees) == 8
        assert model.trees.losses[len(model.trees.trees)] == min(model.trees.losses)
        scored = risk.score(cohort, model)
        assert scored.count() == 3000
        own = stats.ranking_scores(scored.withColumn("y", F.col(t)), "margin", "y").first().auroc
        plain = risk.baseline(cohort, COLUMNS, t).transform(cohort).select(vector_to_array("probability")[1].alias("p"), F.col(t).alias("y"))
        assert own > 0.85 and (t == "c" or own > stats.ranking_scores(plain, "p", "y").first().auroc + 0.2)


def test_first_tree_is_the_best_split(spark):
    rows = spark.createDataFrame([(i, float(i), float(i % 2), int(i >= 60), "train") for i in range(100)] + [(i, float(i), 0.0, int(i >= 60), "calibration") for i in range(100)], "id int, x double, z double, y int, split string")
    model = boosting.fit(rows, ("x", "z"), ("y",), rounds=1, depth=1, bins=64)["y"]
    tree = model.trees[0]
    assert tree.feature[0] == 0 and 58 <= model.cuts[0][tree.cut[0]] < 60 and tree.value[1] < 0 < tree.value[2] and tree.weight[0] == 100
    p = 0.4
    left = sum(p for i in range(100) if i <= model.cuts[0][tree.cut[0]]), sum(p * (1 - p) for i in range(100) if i <= model.cuts[0][tree.cut[0]])
    assert tree.value[1] == pytest.approx(-0.05 * left[0] / (left[1] + 1)) or model.cuts[0][tree.cut[0]] < 59
    single = boosting.fit(rows.withColumn("y", F.lit(1)), ("x", "z"), ("y",), rounds=5)["y"]
    assert single.trees == [] and boosting.fit(rows.limit(0), ("x", "z"), ("y",), rounds=5)["y"].trees == []


def test_contributions_add_up_to_the_margin_with_missing_values(spark, cohort):
    rows = cohort.withColumn("x1", F.when(F.col("id") % 5 > 0, F.col("x1")))
    model = risk.train(rows, COLUMNS, "a", "id", iterations=6)
    scored = {r.id: r.margin for r in risk.score(rows, model).collect()}
    for r in risk.contributions(rows, model, "id").collect():
        assert r.bias + sum(r.contributions) == pytest.approx(scored[r.id], abs=1e-9)


def test_a_pass_is_one_job_of_one_stage(spark, cohort):
    """Rounds of small tables cost what starting a job costs, so a level of all trees is one job without a shuffle."""
    rows = stats.stratified_split(cohort, "id", "a").cache()
    rows.count()
    spark.sparkContext.setJobGroup("boosting", "one fit")
    try:
        model = boosting.fit(rows, COLUMNS, ("a", "b", "c"), rounds=20, depth=2)["a"]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("boosting"))
    assert len(model.losses) == 21 and stages < 60, stages


def test_small_tables_are_fitted_in_few_jobs(spark, cohort, monkeypatch):
    """A small table's rounds are steps of one task a target, and give the trees that the passes over many tasks give."""
    rows = stats.stratified_split(cohort, "id", "a").withColumn("x1", F.when(F.col("id") % 5 > 0, F.col("x1"))).cache()
    rows.count()
    spark.sparkContext.setJobGroup("alone", "one fit")
    try:
        own = boosting.fit(rows, COLUMNS, ("a", "b", "c"), rounds=18, depth=3)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("alone")) < 10
    monkeypatch.setattr(boosting, "ALONE", 0)
    x = np.random.default_rng(3).normal(size=(500, 4))
    x[::7, 1] = np.nan
    for t, passes in boosting.fit(rows, COLUMNS, ("a", "b", "c"), rounds=18, depth=3).items():
        assert len(own[t].trees) == len(passes.trees) > 0 and own[t].losses == pytest.approx(passes.losses, rel=1e-9)
        assert np.allclose(own[t].margins(x), passes.margins(x), rtol=0, atol=1e-9)
        for a, b in zip(own[t].trees, passes.trees, strict=True):
            assert (a.feature == b.feature).all() and np.array_equal(a.weight, b.weight)


def test_sums_of_a_sibling_are_the_rest_of_its_parent(spark, cohort):
    """Weights and values of all leaves are those of the rows that reach them."""
    rows = stats.stratified_split(cohort, "id", "a")
    model = boosting.fit(rows, COLUMNS, ("a",), rounds=1, depth=3, penalty=1.0)["a"]
    own = [r for r in rows.where("split = 'train'").collect()]
    x, y, p = np.array([[r[c] for c in COLUMNS] for r in own]), np.array([r.a for r in own]), 1 / (1 + np.exp(-model.base))
    reached = model.trees[0].leaves(boosting.binned(x, model.cuts).T, 3)
    for leaf in np.unique(reached).tolist():
        at = reached == leaf
        assert model.trees[0].weight[leaf] == at.sum()
        assert model.trees[0].value[leaf] == pytest.approx(-0.05 * (p - y[at]).sum() / (at.sum() * p * (1 - p) + 1))
