"""Quality flags, issue tables and per-report rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog
from . import stats


def population_stats(rows: DataFrame, keys: tuple[str, ...] = ("marker",), value: str = "value_si", where: Column | None = None, exact: bool = True) -> DataFrame:
    """Log-scale mean, sample deviation, quartiles and count of each group, over rows that ``where`` selects.

    Quartiles are exact without holding a group's values (see ``stats.percentiles``), at the price of two more passes; ``exact`` False takes
    a sketch's, in one pass, whose places are off by one in ``stats.ACCURACY`` of the group at most.
    """
    ln = F.log(F.greatest(F.col(value), F.lit(1e-6)))
    chosen = rows.where(F.col(value).isNotNull() & (where if where is not None else F.lit(True)))
    moments = [F.avg(ln).alias("log_mean"), F.stddev_samp(ln).alias("log_sd")]
    if not exact:
        return chosen.groupBy(*keys).agg(*moments, F.percentile_approx(ln, F.lit(0.25), stats.ACCURACY).alias("log_q1"), F.percentile_approx(ln, F.lit(0.75), stats.ACCURACY).alias("log_q3"), F.count("*").alias("n"))
    quartiles = stats.percentiles(chosen, keys, ln, (0.25, 0.75), "q").select(*keys, F.col("q")[0].alias("log_q1"), F.col("q")[1].alias("log_q3"), "n")
    return chosen.groupBy(*keys).agg(*moments).join(quartiles, list(keys))


def z_log(value: Column, mean: Column, sd: Column, floor: float = 1e-6) -> Column:
    """Distance from the mean in deviations, 0 where the deviation is 0, null where the value is null."""
    return F.when(value.isNull(), None).when(sd == 0, 0.0).otherwise((F.log(F.greatest(value, F.lit(floor))) - mean) / sd)


def beyond_fences(value: Column, q1: Column, q3: Column, k: float = 3.0, floor: float = 1e-6) -> Column:
    """I8: outside Tukey's fences on the log scale."""
    ln = F.log(F.greatest(value, F.lit(floor)))
    return F.when(value.isNull(), None).otherwise((ln < q1 - k * (q3 - q1)) | (ln > q3 + k * (q3 - q1)))


def misread_suspect(value: Column, implausible: Column, z: Column, low: Column, high: Column) -> Column:
    """Implausible or far out, while a tenth, a hundredth or ten times it lies in the reference."""
    lands = (value / 10).between(low, high) | (value / 100).between(low, high) | (value * 10).between(low, high)
    return (implausible | (F.abs(z) > 4)) & lands


def decimal_shift(value: Column, low: Column, high: Column) -> Column:
    """The first of 0.1, 0.01, 10, 100 that brings a value outside the reference into it."""
    tries = [F.when((value * f).between(low, high), F.lit(f)) for f in (0.1, 0.01, 10.0, 100.0)]
    return F.when(~value.between(low, high), F.coalesce(*tries))


def flag_mismatch(value: Column, printed: Column, flag: Column) -> Column:
    """The laboratory's H or L against the printed range; null without a flag or range."""
    low = F.regexp_extract(printed, r"([0-9]+(?:[.,][0-9]+)?)\s*(?:-|–|to)\s*([0-9]+(?:[.,][0-9]+)?)", 1)
    high = F.regexp_extract(printed, r"([0-9]+(?:[.,][0-9]+)?)\s*(?:-|–|to)\s*([0-9]+(?:[.,][0-9]+)?)", 2)
    low, high = (F.replace(x, F.lit(","), F.lit(".")).try_cast("double") for x in (low, high))
    mark = F.substring(F.upper(flag), 1, 1)
    return F.when(mark.isin("H", "L") & low.isNotNull() & value.isNotNull(), ((mark == "H") & (value <= high)) | ((mark == "L") & (value >= low)))


def keep_best(rows: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order.  The rank filter reaches the map side (WindowGroupLimit)."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def report_issues(rows: DataFrame, expected: tuple[str, ...] = catalog.MARKERS) -> DataFrame:
    """One row per finding: report_id, marker, code, severity, message.

    ``rows``: normalised rows with report_id, line_no, marker, value_si, confidence, unit_inferred, low, high, plaus_low, plaus_high, log_mean,
    log_sd, log_q1, log_q3, reference_text, flag.  Duplicates follow I13: within five per cent they are information, else a warning.
    """
    value = F.col("value_si")
    implausible = ~value.between(F.col("plaus_low"), F.col("plaus_high"))
    z = z_log(value, F.col("log_mean"), F.col("log_sd"), 1e-3)
    order = Window.partitionBy("report_id", "marker").orderBy(F.desc("confidence"), "line_no")
    best = F.first("value_si").over(order)
    place = F.row_number().over(order)
    near = F.abs(value - best) <= 0.05 * F.greatest(F.abs(value), F.abs(best))
    checks = [
        (implausible, "implausible_value", F.lit("error")),
        (~implausible & (F.col("confidence") < 0.75), "low_confidence", F.lit("warning")),
        (~implausible & (F.abs(z) > 4), "zscore_outlier", F.lit("warning")),
        (~implausible & beyond_fences(value, F.col("log_q1"), F.col("log_q3"), 3.0, 1e-3), "iqr_outlier", F.lit("warning")),
        (decimal_shift(value, F.col("low"), F.col("high")).isNotNull() & (implausible | (F.abs(z) > 4)), "decimal_shift", F.lit("warning")),
        (flag_mismatch(value, F.col("reference_text"), F.col("flag")), "flag_mismatch", F.lit("warning")),
        (F.col("unit_inferred"), "unit_inferred", F.lit("warning")),
        (F.col("_place") > 1, "duplicate", F.when(F.col("_near"), "info").otherwise("warning")),
    ]
    found = F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), s.alias("severity"))) for c, code, s in checks])
    issues = rows.withColumns({"_place": place, "_near": near}).select("report_id", "marker", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i"), value.alias("_v"))
    return issues.select("report_id", "marker", "i.code", "i.severity", F.concat_ws(" ", "marker", F.replace("i.code", F.lit("_"), F.lit(" ")), F.round("_v", 3).cast("string")).alias("message"))


def report_rollup(rows: DataFrame, issues: DataFrame, expected: tuple[str, ...] = catalog.MARKERS) -> DataFrame:
    """Completeness, missing markers, issues, checks run and whether a clinician should look, per report.

    Implausible rows don't count as present; errors, and warnings about duplicates or decimal shifts, call for attention.
    """
    good = F.col("value_si").between(F.col("plaus_low"), F.col("plaus_high"))
    present = rows.groupBy("report_id").agg(F.collect_set(F.when(good, F.col("marker"))).alias("present"), F.count("*").alias("rows_checked"))
    listed = issues.groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct("marker", "code", "severity", "message"))).alias("issues"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if((F.col("severity") == "warning") & F.col("code").isin("decimal_shift", "duplicate")).alias("doubts"))
    missing = F.array_except(F.array(*map(F.lit, expected)), F.col("present"))
    joined = present.join(listed, "report_id", "left")
    return joined.select("report_id", F.round(F.size("present") / len(expected), 3).alias("completeness"), missing.alias("missing_markers"), F.coalesce("issues", F.array().cast("array<struct<marker:string,code:string,severity:string,message:string>>")).alias("issues"), ((F.coalesce("errors", F.lit(0)) > 0) | (F.coalesce("doubts", F.lit(0)) > 0)).alias("needs_clinician_attention"), "rows_checked")
