"""Functional ranges from spline risk curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import durable, packed
from . import stats


def spline_basis(x: Column, low: float, high: float, knots: int = 6, degree: int = 3) -> list[Column]:
    """Cubic B-spline basis on ``knots`` uniform knots from low to high, by the Cox-de Boor recursion in column expressions; beyond the
    ends each basis function goes on as a straight line."""
    step = (high - low) / (knots - 1)
    grid = [low + step * (i - degree) for i in range(knots + 2 * degree)]

    def basis(at: Column, i: int, k: int, last: bool = False) -> Column:
        if k == 0:
            return ((at >= grid[i]) & (at < grid[i + 1])).cast("double")
        left = (at - grid[i]) / (grid[i + k] - grid[i]) * basis(at, i, k - 1)
        return left + (grid[i + k + 1] - at) / (grid[i + k + 1] - grid[i + 1]) * basis(at, i + 1, k - 1)

    inside = F.least(F.greatest(x, F.lit(low)), F.lit(high - 1e-9 * (high - low)))
    out = []
    for i in range(knots + degree - 1):
        slope = degree * (basis(inside, i, degree - 1) / (grid[i + degree] - grid[i]) - basis(inside, i + 1, degree - 1) / (grid[i + degree + 1] - grid[i + 1]))
        out.append(basis(inside, i, degree) + slope * (x - inside))
    return out


def spline_matrix(x: np.ndarray, low: float, high: float, knots: int = 6, degree: int = 3) -> np.ndarray:
    """``spline_basis`` for an array of values, a column for each basis function."""
    step = (high - low) / (knots - 1)
    grid = low + step * (np.arange(knots + 2 * degree) - degree)
    inside = np.clip(x, low, high - 1e-9 * (high - low))[:, None]
    level = ((inside >= grid[:-1]) & (inside < grid[1:])).astype(float)
    for k in range(1, degree + 1):
        below, n = level, len(grid) - 1 - k
        level = (inside - grid[:n]) / (k * step) * below[:, :n] + (grid[k + 1 : k + 1 + n] - inside) / (k * step) * below[:, 1 : n + 1]
    slope = (below[:, :-1] - below[:, 1:]) / step
    return level + slope * (x[:, None] - inside)


def poisson_draws(hashes: np.ndarray, replicates: int, rate: float) -> np.ndarray:
    """A row's Poisson count in each replicate, a column each, from a 64-bit hash of the row's key."""
    cumulative, term = [], np.exp(-rate)
    for k in range(24):
        cumulative.append(term + (cumulative[-1] if cumulative else 0.0))
        term *= rate / (k + 1)
    x = hashes.view(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return np.searchsorted(cumulative, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), "right").astype(float)


def spline_fits(rows: DataFrame, x: str, label: str, extra: tuple[str, ...] = (), replicates: int = 0, rate: float = 1.0, ends: tuple[float, float] | None = None, rounds: int = 40, tolerance: float = 1e-9) -> np.ndarray:
    """Coefficients (a row a fit: intercept, splines, covariates) of logistic models under several weightings of the same rows.

    ``rows`` has the columns and, for resampled fits, ``key_hash``.  Without replicates there is one fit of all rows, with them one for each column of
    ``poisson_draws``.  All fits take their Newton steps together: a pass over the rows gives every fit's weighted products of the design, its gradient and its loss, which
    are summed by Spark; the driver gets some 150 numbers a fit and round.  The penalty is half the squared coefficients of covariates scaled to
    their weighted deviation, as for a unit inverse strength; the intercept is free.  A step that raises a fit's loss is halved.
    """
    low, high = ends or rows.agg(F.min(x), F.max(x)).first()
    fits, p = max(1, replicates), 1 + 8 + len(extra)
    columns = [x, label, *extra]

    def products(beta: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((fits, p * p + p + 1))
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]
                design, y = np.column_stack([np.ones(len(v[0])), spline_matrix(v[0], low, high), *v[2:]]), v[1]
                weights = poisson_draws(batch.column("key_hash").to_numpy(), replicates, rate) if replicates else np.ones((len(y), 1))
                for r in range(fits):
                    own = weights[:, r] > 0
                    d, t, w = design[own], y[own], weights[own, r]
                    z = d @ beta[r]
                    mu = 1 / (1 + np.exp(-z))
                    total[r, : p * p] += (d * (w * mu * (1 - mu))[:, None]).T.dot(d).ravel()
                    total[r, p * p : -1] += d.T @ (w * (t - mu))
                    total[r, -1] += float(w @ (np.logaddexp(0, z) - t * z))
            yield pa.RecordBatch.from_pydict({"fit": np.repeat(np.arange(fits), total.shape[1]), "place": np.tile(np.arange(total.shape[1]), fits), "value": total.ravel()})

        found = rows.mapInArrow(run, "fit bigint, place bigint, value double").groupBy("fit", "place").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros((fits, p * p + p + 1))
        out[found.column("fit").to_numpy(), found.column("place").to_numpy()] = found.column("value").to_numpy()
        return out[:, : p * p].reshape(fits, p, p), out[:, p * p : -1], out[:, -1]

    beta, best, penalty = np.zeros((fits, p)), np.full(fits, np.inf), None
    kept, step = beta.copy(), np.zeros((fits, p))
    for _ in range(rounds):
        curvature, slope, loss = products(beta)
        if penalty is None:  # at zero the curvature is a quarter of the weighted second moments
            size = np.maximum(curvature[:, 0, 0], 1e-300)[:, None]
            mean, square = curvature[:, 0, :] / size, np.diagonal(curvature, axis1=1, axis2=2) / size
            penalty = np.where(square - mean**2 > 1e-12 * np.maximum(square, 1e-300), square - mean**2, 1.0)
            penalty[:, 0] = 0.0
        loss = loss + (penalty * beta**2).sum(1) / 2
        worse = loss > best + 1e-9 * np.abs(best)
        step[worse] /= 2
        for r in np.flatnonzero(~worse):
            kept[r], best[r] = beta[r], loss[r]
            step[r] = np.linalg.lstsq(curvature[r] + np.diag(penalty[r]), slope[r] - penalty[r] * beta[r], rcond=None)[0]
        beta = kept + step
        if np.abs(step).max() <= tolerance * max(1.0, np.abs(kept).max()):
            break
    return beta


def _curves(rows: DataFrame, x: str, beta: np.ndarray, ends: tuple[float, float], grid: tuple[float, float], means: list[float], points: int) -> DataFrame:
    at = np.linspace(*grid, points)
    design = np.column_stack([np.ones(points), spline_matrix(at, *ends), *[np.full(points, m) for m in means]])
    risk = 1 / (1 + np.exp(-design @ beta.T))
    found = [(r, k, float(at[k]), float(risk[k, r])) for r in range(len(beta)) for k in range(points)]
    return rows.sparkSession.createDataFrame(found, f"replicate int, point int, `{x}` double, risk double")


def _prepared(rows: DataFrame, x: str, label: str, extra: tuple[str, ...], key: str | None, grid: tuple[float, float] | None):
    """The rows that have all columns, as numbers, kept; their ends, the grid's (by default the 1st and 99th percentile), covariate means and count."""
    columns = [F.col(c).cast("double").alias(c) for c in (x, label, *extra)]
    kept = durable(rows.select(*columns, *([F.xxhash64(key).alias("key_hash")] if key else [])).dropna())
    low, high, n, *means = kept.agg(F.min(x), F.max(x), F.count("*"), *[F.avg(e) for e in extra]).first()
    if n and low < high:
        grid = grid or tuple(stats.percentiles(kept, (), F.col(x), (0.01, 0.99)).first()["quantiles"])
    return packed(kept, n), (low, high), grid, means, n


def risk_curve(rows: DataFrame, x: str, label: str, extra: tuple[str, ...] = (), points: int = 120, grid: tuple[float, float] | None = None) -> DataFrame:
    """Point, x, risk of a spline logistic model on an even grid, other covariates (age, sex) at their means.

    Rows that lack a value are left out; no rows, or one value of ``x`` alone, give no curve.
    """
    kept, ends, grid, means, n = _prepared(rows, x, label, extra, None, grid)
    if not n or ends[0] == ends[1]:
        return rows.sparkSession.createDataFrame([], f"point int, `{x}` double, risk double")
    return _curves(rows, x, spline_fits(kept, x, label, extra, ends=ends), ends, grid, means, points).drop("replicate")


def band(curve: DataFrame, x: str, keys: tuple[str, ...] = (), factor: float = 1.25, contrast: float = 1.3) -> DataFrame:
    """The contiguous grid points around the least risk where it stays within ``factor`` of that, unless the curve is flatter than
    ``contrast``; ``low_limited`` and ``high_limited`` say that the band ends at the data's edge."""
    own = Window.partitionBy(*keys)
    rows = curve.withColumns({"_min": F.min("risk").over(own), "_max": F.max("risk").over(own), "_last": F.max("point").over(own), "_at": F.first("point").over(own.orderBy("risk", "point"))})
    rows = rows.withColumn("_out", (F.col("risk") > factor * F.col("_min")).cast("int"))
    up, down = own.orderBy("point"), own.orderBy(F.desc("point"))
    breaks = F.when(F.col("point") >= F.col("_at"), F.sum(F.when(F.col("point") >= F.col("_at"), F.col("_out")).otherwise(0)).over(up)).otherwise(F.sum(F.when(F.col("point") <= F.col("_at"), F.col("_out")).otherwise(0)).over(down))
    kept = rows.withColumn("_breaks", breaks).where((F.col("_breaks") == 0) & (F.col("_max") >= contrast * F.col("_min")))
    edges = [F.min(x).alias("band_low"), F.max(x).alias("band_high"), (F.min("point") == 0).alias("low_limited"), (F.max("point") == F.max("_last")).alias("high_limited"), F.min("_min").alias("least_risk")]
    return kept.groupBy(*keys).agg(*edges) if keys else kept.agg(*edges).where("band_low is not null")


def bootstrap_edges(rows: DataFrame, key: str, x: str, label: str, extra: tuple[str, ...] = (), replicates: int = 20, size: int = 15_000, points: int = 120) -> DataFrame:
    """5th and 95th percentile of both edges over refits of resampled rows on a common grid, and how many fits had a band.

    A resample of about ``size`` rows is drawn with replacement as a Poisson count for each row; all refits share their passes (``spline_fits``).
    """
    kept, ends, grid, means, n = _prepared(rows, x, label, extra, key, None)
    if not n or ends[0] == ends[1]:
        curves = rows.sparkSession.createDataFrame([], f"replicate int, point int, `{x}` double, risk double")
    else:
        beta = spline_fits(kept, x, label, extra, replicates, min(size, n) / n, ends)
        curves = _curves(rows, x, beta, ends, grid, means, points)
    q = F.array(F.lit(0.05), F.lit(0.95))
    return band(curves, x, ("replicate",)).agg(F.percentile("band_low", q).alias("low_ci"), F.percentile("band_high", q).alias("high_ci"), F.count("*").alias("fits"))  # a row a fit


def band_errors(bands: DataFrame, truths: DataFrame) -> DataFrame:
    """Discovered edges (marker, edge, ci_low, ci_high, width, reference_width) against known ones (marker, truth)."""
    return bands.join(truths, "marker").select("marker", (F.abs(F.col("edge") - F.col("truth")) / F.abs("truth")).alias("relative_error"), F.col("truth").between(F.col("ci_low"), F.col("ci_high")).alias("in_interval"), (F.col("width") < F.col("reference_width")).alias("narrower"))
