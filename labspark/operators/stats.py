"""Ranks, correlations, percentile ladders, calibration and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import durable

#: Relative accuracy of the sketches that bracket an exact percentile: some 4 / ACCURACY of a group's values are sorted for each.
ACCURACY = 10_000


def average_rank(partition: list[str], by: str) -> Column:
    """E5: the rank of ``by`` within a partition, ties sharing the mean of their places."""
    own = Window.partitionBy(*partition)
    return F.rank().over(own.orderBy(by)) + (F.count("*").over(Window.partitionBy(*partition, by)) - 1) / 2


def percentiles(rows: DataFrame, keys: tuple[str, ...], value: Column, levels: tuple[float, ...], to: str = "quantiles") -> DataFrame:
    """keys, ``to``, n: exact percentiles (interpolated between neighbours) of each group at rising ``levels``, nulls left out.

    A mergeable sketch brackets each level in one pass.  A second pass counts: a row for each different value within a bracket (ties are one count), and
    one for all values between two brackets, with their least and greatest.  Running sums over range partitions of these counts give the places, so no task holds a
    group's values, however many are equal; the counts are some 4 / ACCURACY of a group's different values a level.  A null key is a group like any other.
    """
    own = rows.select(*keys, value.cast("double").alias("_x")).where("_x is not null")
    at = lambda move: F.array(*[F.lit(min(1.0, max(0.0, q + move / ACCURACY))) for q in levels])
    sketch = own.groupBy(*keys).agg(F.percentile_approx("_x", at(-2), ACCURACY).alias("_lo"), F.percentile_approx("_x", at(2), ACCURACY).alias("_hi"), F.count("*").alias("n"))
    sketch = durable(sketch.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.arrays_zip("_lo", "_hi").alias("_b"), "n"))
    condition = F.lit(True)
    for k in keys:
        condition &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    near = own.join(sketch.drop("n"), condition) if keys else own.crossJoin(F.broadcast(sketch.drop("n")))  # without keys one row
    within = F.exists("_b", lambda s: (s["_lo"] <= F.col("_x")) & (s["_hi"] >= F.col("_x")))
    counts = near.groupBy(*keys, F.when(within, F.col("_x")).alias("_v"), F.when(~within, F.size(F.filter("_b", lambda s: s["_lo"] <= F.col("_x")))).alias("_gap")).agg(F.count("*").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    summed = running_sums(counts.drop("_v", "_gap"), keys, "_least", _upto="_c")
    # The places a row of counts covers are _upto - _c to _upto - 1; a bracket's ends may be one place beyond it, the first or last of the row next to it.
    met = summed.join(sketch.drop("_b"), condition) if keys else summed.crossJoin(F.broadcast(sketch.drop("_b")))
    covers = lambda p: (p >= F.col("_upto") - F.col("_c")) & (p < F.col("_upto"))
    held = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(levels) - 1)), lambda i: F.struct(i.alias("i"), (F.get(F.array(*map(F.lit, levels)), i) * (F.col("n") - 1)).alias("p"))), lambda s: covers(F.floor(s["p"])) | covers(F.ceil(s["p"])))
    value_of = lambda p: F.when(~covers(p), None).when(p == F.col("_upto") - F.col("_c"), F.col("_least")).otherwise(F.col("_most"))
    parts = met.select(*keys, "n", "_upto", "_c", "_least", "_most", F.explode(held).alias("_s"))
    ends = parts.groupBy(*keys, "n", F.col("_s.i").alias("_i"), F.col("_s.p").alias("_p")).agg(F.max(value_of(F.floor("_s.p"))).alias("_low"), F.max(value_of(F.ceil("_s.p"))).alias("_high"))
    exact = F.when(F.floor("_p") == F.ceil("_p"), F.col("_low")).otherwise(F.col("_low") + (F.col("_p") - F.floor("_p")) * (F.col("_high") - F.col("_low")))
    return ends.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", exact.alias("_x")))), lambda s: s["_x"]).alias(to)).select(*keys, to, "n")


def medians(rows: DataFrame, groups: list[tuple[str, ...]], columns: tuple[str, ...]) -> DataFrame:
    """The exact median of every column, a row for each group of each of ``groups``' keys; keys that a group lacks are null there, and ``grouping`` is its place in the list."""
    keys = list(dict.fromkeys(k for g in groups for k in g))
    kinds = dict(rows.dtypes)
    scopes = F.explode(F.array(*[F.struct(F.lit(i).alias("grouping"), *[(F.col(k) if k in g else F.lit(None).cast(kinds[k])).alias(f"k_{k}") for k in keys]) for i, g in enumerate(groups)]))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))
    long = rows.select(*keys, pairs.alias("_v"), *columns).select(scopes.alias("_g"), "_v").select("_g.*", "_v.*")
    found = percentiles(long, ("grouping", *[f"k_{k}" for k in keys], "column"), F.col("x"), (0.5,), "_q")
    wide = found.groupBy("grouping", *[f"k_{k}" for k in keys]).agg(*[F.max(F.when(F.col("column") == c, F.col("_q")[0])).alias(c) for c in columns])
    return wide.select("grouping", *[F.col(f"k_{k}").alias(k) for k in keys], *columns)


def running_sums(rows: DataFrame, keys: tuple[str, ...], order: str, **sums: str) -> DataFrame:
    """``rows`` with a column for each of ``sums``: the sum of that column over the rows of the same keys up to this one by rising ``order``, whose values differ within keys.

    Rows are partitioned by ranges of keys and order; sums within a partition get the totals of those before it, which are a row for each
    partition and key.  So no task holds a key's rows, however many.
    """
    placed = durable(rows.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_t_{to}") for to, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"), *[F.coalesce(F.sum(f"_t_{to}").over(earlier), F.lit(0)).alias(f"_o_{to}") for to in sums])
    own = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    condition = F.col("_part") == F.col("_k_part")
    for k in keys:
        condition &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = placed.withColumns({f"_r_{to}": F.sum(c).over(own) for to, c in sums.items()}).join(offsets, condition)
    return out.select(*rows.columns, *[(F.col(f"_r_{to}") + F.col(f"_o_{to}")).alias(to) for to in sums])


def ranked_by_value(rows: DataFrame, keys: tuple[str, ...], value: str, weight: str | None = None) -> DataFrame:
    """One row per different value of a group: keys, value, n and ``rank`` (average ranks)."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running_sums(counts, keys, value, _upto="n").withColumn("rank", F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2).drop("_upto")


def spearman(rows: DataFrame, keys: tuple[str, ...], x: str, y: str) -> DataFrame:
    """Rank correlation of x and y in each group, over rows that have both."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx, ry = ranked_by_value(both, keys, x).select(*keys, x, F.col("rank").alias("_rx")), ranked_by_value(both, keys, y).select(*keys, y, F.col("rank").alias("_ry"))
    return both.join(rx, [*keys, x]).join(ry, [*keys, y]).groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def percentile_ladder(rows: DataFrame, keys: tuple[str, ...], value: str, levels: int = 99) -> DataFrame:
    """The 1st to 99th percentile of each group in an array."""
    return percentiles(rows, keys, F.col(value), tuple(i / (levels + 1) for i in range(1, levels + 1)), "ladder").drop("n")


def percentile_of(value: Column, ladder: Column) -> Column:
    """C14: percentiles at or below a value: 0 below all, 100 at or above the last."""
    found = F.size(F.filter(ladder, lambda q: q <= value))
    return F.when(value.isNull(), None).when(found == F.size(ladder), 100).otherwise(found)


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Counts and shares of a column's values."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # over a row per different value


def crosstab_shares(rows: DataFrame, row: str, column: str, values: tuple) -> DataFrame:
    """Of each row value, the share of each column value; null where all are null."""
    return rows.groupBy(row).agg(*[F.try_divide(F.count_if(F.col(column) == v), F.count(column)).alias(str(v)) for v in values])


def calibration_error(rows: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean distance of predicted and observed rates over equal-width bins, weighted by size."""
    binned = rows.withColumn("_bin", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))).groupBy("_bin").agg(F.count("*").alias("n"), F.avg(score).alias("p"), F.avg(label).alias("y"))
    return binned.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))), F.sum("n")).alias("ece"))


def calibration_curve(rows: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Bins between quantiles with both edges in, so a row on an inner edge counts in two."""
    edges = percentiles(rows, (), F.col(score), tuple(i / bins for i in range(bins + 1)), "q").select(F.posexplode(F.arrays_zip(F.slice("q", 1, bins).alias("lo"), F.slice("q", 2, bins).alias("hi")))).select(F.col("pos").alias("bin"), "col.lo", "col.hi")
    return rows.join(F.broadcast(edges), F.col(score).between(F.col("lo"), F.col("hi"))).groupBy("bin").agg(F.avg(score).alias("predicted"), F.avg(label).alias("observed"), F.count("*").alias("n"))  # ``bins`` edges


def ranking_scores(rows: DataFrame, score: str, label: str) -> DataFrame:
    """AUROC by average ranks, average precision over falling scores (ties together) and Brier score, in one row; null where a class is absent."""
    by = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    all_ = by.agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    ranked = running_sums(by, (), score, _pos="pos", _n="n").crossJoin(F.broadcast(all_))  # one row
    ranked = ranked.withColumns({"below": F.col("_n") - F.col("n"), "tp": F.col("all_pos") - F.col("_pos") + F.col("pos"), "seen": F.col("all_n") - F.col("_n") + F.col("n")})
    totals = ranked.agg(F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q"), F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)).alias("r"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("a"))
    brier = rows.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))
    return totals.crossJoin(brier).select((F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q"))).alias("auroc"), F.try_divide("a", "p").alias("average_precision"), "brier")  # one row each


def fingerprint(rows: DataFrame) -> DataFrame:
    """A digest of all rows that does not depend on their order."""
    total = F.sum(F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]).cast("decimal(38,0)"))
    return rows.agg(F.substring(F.sha2(F.concat_ws("|", total.cast("string"), F.count("*").cast("string")), 256), 1, 16).alias("fingerprint"))


def stratified_split(rows: DataFrame, key: str, stratum: str, shares_: tuple[float, ...] = (0.7, 0.15, 0.15), names: tuple[str, ...] = ("train", "calibration", "test"), seed: int = 42) -> DataFrame:
    """Each stratum split in given shares, by the order of a hash of the key.

    The place in a stratum comes from percentiles of the hash, so no stratum is sorted in one task.
    """
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)).cast("double"))
    cuts = [sum(shares_[: i + 1]) for i in range(len(shares_) - 1)]
    bounds = hashed.groupBy(F.col(stratum).alias("_s")).agg(F.percentile_approx("_h", F.array(*map(F.lit, cuts)), 100_000).alias("_b"))
    joined = hashed.join(F.broadcast(bounds), F.col(stratum).eqNullSafe(F.col("_s")))  # a row per stratum
    out = F.lit(names[-1])
    for i in reversed(range(len(cuts))):
        out = F.when(F.col("_h") <= F.col("_b")[i], names[i]).otherwise(out)
    return joined.withColumn("split", out).drop("_h", "_s", "_b")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a hash of the key."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def bootstrap_weights(rows: DataFrame, key: str, replicates: int, size: int, total: int) -> DataFrame:
    """Each row's Poisson(size/total) count in each replicate, drawn from a hash of key and replicate."""
    u = (F.pmod(F.xxhash64(F.col(key), F.col("replicate")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    rate, term, cumulative = size / total, pow(2.718281828459045, -size / total), 0.0
    weight = F.lit(0)
    for k in range(12):
        cumulative += term
        weight = weight + (u > cumulative).cast("int")
        term *= rate / (k + 1)
    return rows.withColumn("replicate", F.explode(F.array(*map(F.lit, range(replicates))))).withColumn("weight", weight)


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two labellings, from their contingency table."""
    cells = rows.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    entropy = lambda c: -F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))
    total = cells.agg(F.sum("n").alias("t"))
    side = lambda k: cells.groupBy(k).agg(F.sum("n").alias("m")).crossJoin(total).agg(pairs("m").alias(f"p_{k}"), entropy("m").alias(f"h_{k}"))
    joint = cells.crossJoin(total).agg(pairs("n").alias("p_ab"), entropy("n").alias("h_ab"), F.max("t").alias("t"))
    row = joint.crossJoin(side(a)).crossJoin(side(b))  # one row each
    pa, pb = F.col(f"p_{a}"), F.col(f"p_{b}")
    expected, most = pa * pb / (F.col("t") * (F.col("t") - 1) / 2), (pa + pb) / 2
    mutual = F.col(f"h_{a}") + F.col(f"h_{b}") - F.col("h_ab")
    mean = (F.col(f"h_{a}") + F.col(f"h_{b}")) / 2
    return row.select(F.when(most == expected, 1.0).otherwise((F.col("p_ab") - expected) / (most - expected)).alias("ari"), F.when(mean == 0, 1.0).otherwise(mutual / mean).alias("nmi"))


def reconciliation(injected: DataFrame, detected: DataFrame, key: str, kind: str) -> DataFrame:
    """For each kind of injected fault its rows, those that were detected as that kind, their share (null where none was injected), and rows detected as
    that kind that were not injected.  A row counts once however often it is listed; keys and kinds may be null."""
    sides = [rows.select(F.col(key).alias("_key"), F.col(kind).alias(kind), F.lit(i == 0).alias("_in"), F.lit(i == 1).alias("_out")) for i, rows in enumerate((injected, detected))]
    each = sides[0].unionByName(sides[1]).groupBy("_key", kind).agg(F.max("_in").alias("_in"), F.max("_out").alias("_out"))
    made = each.groupBy(kind).agg(F.count_if("_in").alias("injected"), F.count_if(F.col("_in") & F.col("_out")).alias("detected"), F.count_if(~F.col("_in")).alias("spurious"))
    return made.withColumn("share", F.try_divide("detected", "injected"))


def insight_table(rows: DataFrame, group: str, hits: dict[str, Column]) -> DataFrame:
    """For each group and measure the number of rows, of those that hold (null is no), their per cent to one place, the difference from the whole table's,
    and the group's place among all by rate, highest first; ties by name.  A row a group and measure: groups are kinds, of which a table has few."""
    flags = [F.struct(F.lit(name).alias("measure"), F.coalesce(hit, F.lit(False)).alias("hit")) for name, hit in hits.items()]
    long = rows.select(group, F.explode(F.array(*flags)).alias("m")).select(group, "m.measure", "m.hit")
    rated = long.groupBy("measure", group).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    all_rows, by_rate = Window.partitionBy("measure"), Window.partitionBy("measure").orderBy(F.desc("_rate"), group)
    rated = rated.withColumns({"_rate": F.col("hits") / F.col("n"), "_whole": F.sum("hits").over(all_rows) / F.sum("n").over(all_rows)})
    return rated.select("measure", group, "n", "hits", F.round(F.col("_rate") * 100, 1).alias("percent"), F.round((F.col("_rate") - F.col("_whole")) * 100, 1).alias("points_off"), F.row_number().over(by_rate).alias("place"))
