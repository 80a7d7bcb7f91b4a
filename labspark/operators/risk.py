"""Risk models, calibration and contributions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.io import durable
from . import boosting, stats


@dataclass
class RiskModel:
    """A target's trees, its calibration knots (margin, probability) and prevalence."""

    columns: tuple[str, ...]
    trees: boosting.Ensemble
    knots: list[tuple[float, float]]
    prevalence: float


def train_targets(rows: DataFrame, columns: tuple[str, ...], labels: tuple[str, ...], key: str, rounds: int = 1500, patience: int = 50, rate: float = 0.05, depth: int = 4, seed: int = 42) -> dict[str, RiskModel]:
    """For each label boosted trees that stop early on the calibration rows, and an isotonic calibration on these, which the trees were not grown on.

    All labels share one split, stratified by their combination, and their passes over the rows (``boosting.fit``).
    """
    marked = rows.select(key, *columns, *labels).withColumn("_stratum", F.concat_ws("|", *labels))
    split = durable(stats.stratified_split(marked, key, "_stratum", seed=seed).drop("_stratum"))
    found = boosting.fit(split, columns, labels, rounds=rounds, patience=patience, rate=rate, depth=depth)
    held = durable(boosting.margins(split.where("split = 'calibration'").select(*columns, *labels), columns, found))
    prevalence = rows.agg(*[F.avg(t).alias(t) for t in labels]).first()
    out = {}
    for t in labels:
        fitted = IsotonicRegression(featuresCol="m", labelCol="y").fit(held.select(F.col(t).cast("double").alias("y"), F.col(f"margin_{t}").alias("m")))
        knots = list(zip(map(float, fitted.boundaries.toArray()), map(float, fitted.predictions.toArray()), strict=True))
        out[t] = RiskModel(columns, found[t], knots, prevalence[t])
    return out


def train(rows: DataFrame, columns: tuple[str, ...], label: str, key: str, iterations: int = 1500, depth: int = 4, seed: int = 42) -> RiskModel:
    """J14, J15 for one label."""
    return train_targets(rows, columns, (label,), key, iterations, depth=depth, seed=seed)[label]


def baseline(rows: DataFrame, columns: tuple[str, ...], label: str):
    """A logistic model on the same features, standardised."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_r"), StandardScaler(inputCol="_r", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=label, regParam=1e-4)]).fit(rows)


def score(rows: DataFrame, model: RiskModel) -> DataFrame:
    """Columns margin, probability (calibrated), level and prevalence."""
    made = boosting.margins(rows, model.columns, {"": model.trees}).withColumnRenamed("margin_", "margin")
    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in model.knots])
    made = made.withColumn("probability", S.interpolate(F.col("margin"), knots))
    return made.withColumns({"level": S.risk_level(F.col("probability")), "prevalence": F.lit(model.prevalence)})


def gated(scored: DataFrame, markers: tuple[str, ...], least: int = 3) -> DataFrame:
    """Rows with too few measured markers have no probability, and a note."""
    enough = sum((F.col(m).isNotNull().cast("int") for m in markers), F.lit(0)) >= least
    return scored.withColumns({"probability": F.when(enough, F.col("probability")), "level": F.when(enough, F.col("level")), "note": F.when(~enough, F.lit(f"fewer than {least} markers"))})


@dataclass
class LeafPath:
    """A leaf's value, and for each feature on its path the tests it passes and the share of training rows that passed them."""

    value: float
    features: list[int]
    shares: list[float]
    conditions: list[list[tuple[float, bool]]]


def leaf_paths(tree: tuple[np.ndarray, ...]) -> list[LeafPath]:
    """The leaves of a tree with their paths; tests of one feature are taken together."""
    feature, threshold, left, right, value, weight = tree
    out: list[LeafPath] = []
    todo: list[tuple[int, dict[int, tuple[float, tuple]]]] = [(0, {})]
    while todo:
        k, path = todo.pop()
        if feature[k] >= 0:
            f = int(feature[k])
            for child, is_left in ((left[k], True), (right[k], False)):
                share, tests = path.get(f, (1.0, ()))
                todo.append((int(child), path | {f: (share * weight[child] / weight[k], (*tests, (float(threshold[k]), is_left)))}))
        else:
            out.append(LeafPath(float(value[k]), list(path), [s for s, _ in path.values()], [list(t) for _, t in path.values()]))
    return out


def shapley(leaves: list[LeafPath], x: np.ndarray) -> np.ndarray:
    """Exact Shapley values of one tree for all rows of ``x`` at once, in time quadratic in a path's length.

    A leaf's path is extended by one feature at a time: ``w[j]`` is the weight of the coalitions in which j of the features so far are known, where a
    known feature either agrees with the row or not, and an unknown one passes its share.  A feature's contribution is read off by taking it
    out again, which undoes its extension.
    """
    out = np.zeros(x.shape)
    for leaf in leaves:
        n = len(leaf.features)
        agrees = np.ones((n, len(x)), bool)
        for i, (f, tests) in enumerate(zip(leaf.features, leaf.conditions, strict=True)):
            for bound, is_left in tests:
                agrees[i] &= (x[:, f] <= bound) == is_left
        w = [np.ones(len(x))]
        for m, (share, one) in enumerate(zip(leaf.shares, agrees, strict=True), 1):
            unknown, known = [v * share * (m - j) / (m + 1) for j, v in enumerate(w)], [v * one * (j + 1) / (m + 1) for j, v in enumerate(w)]
            w = [(unknown[j] if j < m else 0) + (known[j - 1] if j else 0) for j in range(m + 1)]
        for f, share, one in zip(leaf.features, leaf.shares, agrees, strict=True):
            without_known, without_unknown, later = np.zeros(len(x)), np.zeros(len(x)), w[n]
            for j in range(n - 1, -1, -1):
                part = later * (n + 1) / (j + 1)  # where the row agrees, the highest weight came from the feature being known
                without_known += part
                later = w[j] - part * share * (n - j) / (n + 1)
                if share > 0:  # where it does not, every weight came from it being unknown
                    without_unknown += w[j] / (share * (n - j) / (n + 1))
            out[:, f] += np.where(one, without_known, without_unknown) * (one - share) * leaf.value
    return out


def expected(tree: tuple[np.ndarray, ...]) -> float:
    """The tree's mean under its path weights."""
    feature, _, left, right, value, weight = tree
    mean = np.array(value, float)
    for k in range(len(feature) - 1, -1, -1):
        if feature[k] >= 0:
            mean[k] = (mean[left[k]] * weight[left[k]] + mean[right[k]] * weight[right[k]]) / weight[k]
    return float(mean[0])


def contributions(rows: DataFrame, model: RiskModel, key: str) -> DataFrame:
    """Key, bias and ``contributions`` (an entry per column), which add up to the row's margin."""
    trees = model.trees.arrays()
    bias = model.trees.base + sum(expected(t) for t in trees)
    columns, leaves = list(model.columns), [leaf_paths(t) for t in trees]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.nan_to_num(pdf[columns].to_numpy(float), nan=-np.inf)  # a missing value passes every test, as in the trees
            made = sum((shapley(own, x) for own in leaves), np.zeros(x.shape))
            yield pd.DataFrame({key: pdf[key], "bias": bias, "contributions": [m.tolist() for m in made]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, *columns).mapInPandas(run, f"`{key}` {kind}, bias double, contributions array<double>")


def by_marker(rows: DataFrame, key: str, columns: tuple[str, ...], sources: dict[str, tuple[str, ...]]) -> DataFrame:
    """Contributions summed over features to the markers they come from, a feature's share split evenly; key, marker, contribution."""
    names = F.array(*[F.array(*map(F.lit, sources.get(c, (c,)))) for c in columns])
    each = rows.select(key, F.explode(F.arrays_zip(F.col("contributions").alias("c"), names.alias("s"))).alias("z")).select(key, F.explode("z.s").alias("marker"), (F.col("z.c") / F.size("z.s")).alias("c"))
    return each.groupBy(key, "marker").agg(F.sum("c").alias("contribution"))


def top_drivers(rows: DataFrame, key: str, n: int = 3) -> DataFrame:
    """the ``n`` largest contributions of each row by size, without those near nothing."""
    items = F.array_sort(F.collect_list(F.struct((-F.abs("contribution")).alias("o"), "marker", "contribution")))
    return rows.where(F.abs("contribution") > 1e-6).groupBy(key).agg(F.transform(F.slice(items, 1, n), lambda s: F.struct(s["marker"].alias("marker"), s["contribution"].alias("contribution"), F.when(s["contribution"] > 0, "raises").otherwise("lowers").alias("direction"))).alias("drivers"))


def importance(rows: DataFrame) -> DataFrame:
    """Mean size of each marker's contributions."""
    return rows.groupBy("marker").agg(F.avg(F.abs("contribution")).alias("importance"))


def demographic_share(rows: DataFrame, demographics: tuple[str, ...] = ("sex", "age")) -> DataFrame:
    """J23; null where all contributions are zero."""
    return rows.agg(F.try_divide(F.sum(F.when(F.col("marker").isin(*demographics), F.abs("contribution")).otherwise(0)), F.sum(F.abs("contribution"))).alias("demographic_share"))
