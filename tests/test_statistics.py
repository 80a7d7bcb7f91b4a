"""Percentiles by counts, resampled spline fits, and measures where a divisor is zero."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labspark.operators import bands, cluster, features, risk, stats


def test_percentiles_with_ties_and_null_keys(spark):
    rng = np.random.default_rng(1)
    groups = {"tied": np.where(rng.random(30_000) < 0.34, 0.0, rng.normal(size=30_000).round(3)), "one": np.array([4.5]), None: rng.normal(size=2_000), "two": np.array([1.0, 2.0]), "equal": np.zeros(5_000)}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("one", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    levels = (0.0, 0.01, 0.25, 0.3333, 0.5, 0.9, 0.999, 1.0)
    got = {r.k: r for r in stats.percentiles(df, ("k",), F.col("x"), levels).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert got[k].n == len(xs) and np.allclose(got[k].quantiles, np.quantile(xs, levels), rtol=0, atol=1e-12)
    assert stats.percentiles(df.limit(0), ("k",), F.col("x"), levels).count() == 0


def test_no_group_is_collected(spark):
    """What a percentile's plan gathers for a group is one entry a level; a tie is one count."""
    df = spark.range(200_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") / 7).alias("x"))
    stats_rows = []
    kept = stats.running_sums
    try:
        stats.running_sums = lambda rows, *a, **b: stats_rows.append(rows.count()) or kept(rows, *a, **b)
        stats.percentiles(df, ("k",), F.col("x"), (0.25, 0.5)).collect()
    finally:
        stats.running_sums = kept
    assert stats_rows[0] < 500  # 66,667 rows are tied at the first level


def test_medians_of_groups_and_of_all(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 5.0), ("b", 2.0, None), (None, 10.0, 1.0)], "g string, x double, y double")
    got = {(r.grouping, r.g): (r.x, r.y) for r in stats.medians(df, [("g",), ()], ("x", "y")).collect()}
    assert got == {(0, "a"): (2.0, 5.0), (0, "b"): (2.0, None), (0, None): (10.0, 1.0), (1, None): (2.5, 3.0)}
    assert features.fit_imputer(df.limit(0), ("g",), ("x", "y")).collect()[0].asDict() == {"g": None, "x": None, "y": None}


def test_spline_matrix_equals_the_column_form(spark):
    xs = [-0.4, 0.0, 0.2, 0.37, 0.999, 1.0, 1.7]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    by_column = df.select("x", *[b.alias(f"b{i}") for i, b in enumerate(bands.spline_basis(F.col("x"), 0.0, 1.0))]).collect()
    assert np.allclose(bands.spline_matrix(np.array(xs), 0.0, 1.0), [list(r)[1:] for r in by_column], atol=1e-9)


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x, age, female = rng.normal(size=n), rng.uniform(18, 80, n), rng.integers(0, 2, n)
    p = 1 / (1 + np.exp(-(-2 + 0.9 * (x - 0.3) ** 2 + 0.02 * (age - 45) + 0.5 * female)))
    y = (rng.random(n) < p).astype(float)
    rows = [(int(k), *map(float, r)) for k, r in enumerate(zip(x, y, age, female, strict=True))]
    return spark.createDataFrame([*rows, (n, None, 1.0, 30.0, 1.0)], "id long, x double, y double, age double, female double")


def test_resampled_fits_are_the_optimum_of_their_own_weights(spark, cohort):
    rows = cohort.withColumn("key_hash", F.xxhash64("id")).dropna()
    own = rows.toPandas()
    ends = (own.x.min(), own.x.max())
    beta = bands.spline_fits(rows, "x", "y", ("age", "female"), 6, 0.5, ends)
    weights = bands.poisson_draws(own.key_hash.to_numpy(), 6, 0.5)
    assert abs(weights.mean() - 0.5) < 0.02 and not np.array_equal(weights[:, 0], weights[:, 1])
    design = np.column_stack([np.ones(len(own)), bands.spline_matrix(own.x.to_numpy(), *ends), own.age, own.female])
    for r in range(6):
        w, y = weights[:, r], own.y.to_numpy()
        mean = (w @ design) / w.sum()
        var = (w @ design**2) / w.sum() - mean**2
        var[0] = 0
        # one Newton step of this fit alone moves no coefficient by more than 1e-6
        mu = 1 / (1 + np.exp(-design @ beta[r]))
        step = np.linalg.solve((design * (w * mu * (1 - mu))[:, None]).T @ design + np.diag(var), design.T @ (w * (y - mu)) - var * beta[r])
        assert np.abs(step).max() < 1e-6
    single = bands.spline_fits(rows, "x", "y", ("age", "female"), ends=ends)
    assert single.shape == (1, 11) and single[0, -1] > 0  # the risk of women is higher by construction


def test_band_and_its_interval(spark, cohort):
    curve = bands.risk_curve(cohort, "x", "y", ("age", "female"))
    found = bands.band(curve, "x").first()
    assert curve.count() == 120 and found.band_low < 0.3 < found.band_high
    edges = bands.bootstrap_edges(cohort, "id", "x", "y", ("age", "female"), 20, 15_000).first()
    assert edges.fits == 20 and edges.low_ci[0] <= found.band_low + 0.15 and edges.high_ci[1] >= found.band_high - 0.15
    assert bands.risk_curve(cohort.limit(0), "x", "y").count() == 0
    assert bands.bootstrap_edges(cohort.limit(0), "id", "x", "y").first().fits == 0


def test_measures_without_a_divisor(spark):
    equal = spark.createDataFrame([(k, [1.0, 2.0], k % 2) for k in range(6)], "id int, v array<double>, c int")
    assert cluster.silhouette(equal, "id", "v", "c").first().silhouette == 0.0
    one = spark.createDataFrame([(0.1, 1), (0.2, 1)], "p double, y int")
    assert stats.ranking_scores(one, "p", "y").first().auroc is None
    none = stats.ranking_scores(one.withColumn("y", F.lit(0)), "p", "y").first()
    assert none.auroc is None and none.average_precision is None and math.isclose(none.brier, 0.025)
    assert stats.calibration_error(one.limit(0), "p", "y").first().ece is None
    assert stats.crosstab_shares(spark.createDataFrame([("a", None)], "r string, c string"), "r", "c", ("x",)).first()[1] is None
    zero = spark.createDataFrame([("age", 0.0), ("TSH", 0.0)], "marker string, contribution double")
    assert risk.demographic_share(zero).first().demographic_share is None
    flat = spark.createDataFrame([(1, 2.0, 0), (1, 2.0, 1)], "c int, m double, r int")
    assert cluster.profiles(flat, "c", ("m",), ("r",)).first().z_m is None


def test_reconciliation(spark):
    injected = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b"), (None, "a"), (4, None)], "id int, kind string")
    detected = spark.createDataFrame([(1, "a"), (1, "a"), (9, "b"), (None, "a"), (5, "c")], "id int, kind string")
    got = {r.kind: (r.injected, r.detected, r.spurious, r.share) for r in stats.reconciliation(injected, detected, "id", "kind").collect()}
    assert got == {"a": (3, 2, 0, 2 / 3), "b": (1, 0, 1, 0.0), "c": (0, 0, 1, None), None: (1, 0, 0, 0.0)}
    assert stats.reconciliation(injected.limit(0), detected.limit(0), "id", "kind").count() == 0


def test_insight_table(spark):
    rows = spark.createDataFrame([("x", 1.0), ("x", 9.0), ("y", None), ("y", 8.0), ("z", 1.0), (None, 9.0)], "g string, v double")
    got = {(r.measure, r.g): (r.n, r.hits, r.percent, r.points_off, r.place) for r in stats.insight_table(rows, "g", {"big": F.col("v") > 5, "any": F.lit(True)}).collect()}
    assert got["big", None] == (1, 1, 100.0, 50.0, 1) and got["big", "x"] == (2, 1, 50.0, 0.0, 2) and got["big", "y"] == (2, 1, 50.0, 0.0, 3) and got["big", "z"] == (1, 0, 0.0, -50.0, 4)
    assert [got["any", g][4] for g in (None, "x", "y", "z")] == [1, 2, 3, 4] and stats.insight_table(rows.limit(0), "g", {"big": F.col("v") > 5}).count() == 0
