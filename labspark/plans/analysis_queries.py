"""Queries on features, statistics, clustering, bands, risk and evaluation (B, C, D, E, F, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scalar as S
from ..operators import bands, cluster, features, lake, neighbours, reports, risk, stats

from ..sources.io import durable
from .base import LAKE, query, raw, relation, rounded, table
from .lake_queries import _flagged


#: Scores and labels: the labelled documents, scored by their length on a curve that both engines compute alike.
SCORED_SQL = "SELECT doc_id, lang, source, toxic, quality, CAST(n_chars % 1000 AS DOUBLE) / 1000 AS score FROM (SELECT l.doc_id, l.toxic, l.quality, d.n_chars, d.lang, d.source FROM (SELECT * FROM labels) l JOIN (SELECT * FROM documents) d ON l.doc_id = d.doc_id) x"

#: Nine markers a customer, some missing, with demographics.
WIDE_SQL = """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'M' WHEN c_custkey % 50 = 7 THEN NULL ELSE 'F' END AS sex, CAST(CASE WHEN c_custkey % 40 = 3 THEN NULL ELSE 18 + c_custkey % 70 END AS INT) AS age, c_mktsegment AS site, c_acctbal AS balance,
  """ + ", ".join(f"CASE WHEN c_custkey % {7 + i} = {i} THEN NULL ELSE CAST({lo} AS DOUBLE) + CAST((c_custkey * {13 + 4 * i}) % 101 AS DOUBLE) * {(hi - lo) / 70!r} END AS {m}" for i, (m, lo, hi) in enumerate((r[0], r[6], r[7]) for r in sorted(catalog.META, key=lambda r: catalog.MARKERS.index(r[0])))) + ", CAST((c_custkey * 7) % 11 AS INT) AS fatigue_severity FROM customer"


def wide(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, WIDE_SQL)


_BAND = "CASE WHEN age >= 0 AND age < 30 THEN 0 WHEN age >= 30 AND age < 45 THEN 1 WHEN age >= 45 AND age < 60 THEN 2 ELSE 3 END"
IMPUTED = f"""WITH w AS (SELECT *, {_BAND} AS band FROM ({WIDE_SQL})), g AS (SELECT sex, band, {", ".join(f"median({m}) AS {m}" for m in catalog.MARKERS)} FROM w GROUP BY sex, band),
  a AS (SELECT {", ".join(f"median({m}) AS {m}" for m in catalog.MARKERS)} FROM w),
  f AS (SELECT w.id, w.sex, w.age, w.band, {", ".join(f"coalesce(w.{m}, g.{m}, a.{m}) AS {m}, CAST(w.{m} IS NULL AS INT) AS {m}_missing" for m in catalog.MARKERS)} FROM w LEFT JOIN g ON g.sex = w.sex AND g.band = w.band CROSS JOIN a)"""


@query(IMPUTED + "SELECT sex, band, " + ", ".join(f"round({m}, 6) AS {m}" for m in catalog.MARKERS) + " FROM g WHERE sex IS NOT NULL UNION ALL SELECT NULL, NULL, " + ", ".join(f"round({m}, 6)" for m in catalog.MARKERS) + " FROM a")
def d9_imputation_medians(spark: SparkSession, d: str) -> DataFrame:
    rows = wide(spark, d).withColumn("band", S.age_band(F.col("age")))
    return rounded(features.fit_imputer(rows, ("sex", "band"), catalog.MARKERS).where("sex is not null or band is null"))


@query(IMPUTED + "SELECT id, " + ", ".join(f"round({m}, 6) AS {m}, {m}_missing" for m in catalog.MARKERS) + " FROM f")
def j1_imputed(spark: SparkSession, d: str) -> DataFrame:
    rows = wide(spark, d).withColumn("band", S.age_band(F.col("age")))
    made = features.impute(rows, features.fit_imputer(rows, ("sex", "band"), catalog.MARKERS), ("sex", "band"), catalog.MARKERS)
    return rounded(made.select("id", *catalog.MARKERS, *[f"{m}_missing" for m in catalog.MARKERS]))


_LN = {m: f"ln(greatest({m}, 1e-3))" for m in catalog.LOG_MARKERS}
_DERIVED = {f"log_{m}": e for m, e in _LN.items()} | {
    "ft3_ft4_ratio": "FT3 / greatest(FT4, 1e-3)", "log_ferritin_to_tsh": f"{_LN['FERRITIN']} - {_LN['TSH']}", "log_tsh_x_ft4": f"{_LN['TSH']} + {_LN['FT4']}",
    "low_iron_x_high_tsh": f"CASE WHEN FERRITIN < 30 THEN greatest({_LN['TSH']} - ln(2.5), 0.0) ELSE 0.0 END", "log_tpo_x_log_tsh": f"{_LN['TPOAB']} * {_LN['TSH']}", "log_b12_x_log_vitd": f"{_LN['B12']} * {_LN['VITD']}",
}


@query(IMPUTED + "SELECT id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _DERIVED.items()) + ", CAST(VITD < 50 AS INT) + CAST(B12 < 148 AS INT) + CAST(FERRITIN < 15 AS INT) + CAST(MG < 0.7 AS INT) + CAST(ZINC < 9.2 AS INT) AS micronutrient_deficit_count, CAST(coalesce(sex = 'F', true) AS INT) AS sex_female, coalesce(age, 45) AS age FROM f")
def j2_features(spark: SparkSession, d: str) -> DataFrame:
    rows = wide(spark, d)
    medians = features.fit_imputer(rows.withColumn("band", S.age_band(F.col("age"))), ("sex", "band"), catalog.MARKERS)
    return rounded(features.features(rows, medians).select("id", *_DERIVED, "micronutrient_deficit_count", "sex_female", "age"))


@query(f"SELECT id, CASE WHEN TSH IS NOT NULL THEN round((ln(greatest(TSH, 1e-3)) - (SELECT avg(ln(greatest(TSH, 1e-3))) FROM w WHERE TSH IS NOT NULL)) / (SELECT stddev_pop(ln(greatest(TSH, 1e-3))) FROM w WHERE TSH IS NOT NULL), 6) END AS TSH, round((MG - (SELECT avg(MG) FROM w)) / (SELECT stddev_pop(MG) FROM w), 6) AS MG FROM ({WIDE_SQL}) w".replace("FROM w ", "FROM (" + WIDE_SQL + ") v ").replace("FROM w)", "FROM (" + WIDE_SQL + ") v)"))
def j3_standardised(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.standardised(wide(spark, d).select("id", "TSH", "MG"), ("TSH", "MG"), ("TSH",)))


@query(f"SELECT band, count(*) AS n FROM (SELECT {_BAND} AS band FROM ({WIDE_SQL})) GROUP BY band")
def h10_age_bands(spark: SparkSession, d: str) -> DataFrame:
    return wide(spark, d).groupBy(S.age_band(F.col("age")).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT event_type, level, round(q, 6) AS q FROM (SELECT event_type, unnest(range(1, 100)) AS level, unnest(quantile_cont(value, [" + ", ".join(f"{i / 100}" for i in range(1, 100)) + "])) AS q FROM events GROUP BY event_type)")
def d10_percentile_ladder(spark: SparkSession, d: str) -> DataFrame:
    ladder = stats.percentile_ladder(table(spark, d, "events"), ("event_type",), "value")
    return rounded(ladder.select("event_type", F.posexplode("ladder").alias("level", "q")).withColumn("level", F.col("level") + 1))


@query("WITH q AS (SELECT event_type, quantile_cont(value, [" + ", ".join(f"{i / 100}" for i in range(1, 100)) + "]) AS l FROM events GROUP BY event_type) SELECT event_id, CASE WHEN len(list_filter(l, lambda x: x <= value)) = 99 THEN 100 ELSE len(list_filter(l, lambda x: x <= value)) END AS percentile FROM events JOIN q USING (event_type)")
def c14_percentile_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    joined = rows.join(F.broadcast(stats.percentile_ladder(rows, ("event_type",), "value")), "event_type")
    return joined.select("event_id", stats.percentile_of(F.col("value"), F.col("ladder")).alias("percentile"))


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def d12_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.shares(table(spark, d, "events"), "event_type"))


@query("SELECT o_orderpriority, " + ", ".join(f"round(count_if(o_orderstatus = '{s}') / count(*), 6) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY o_orderpriority")
def d13_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.crosstab_shares(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ("F", "O", "P")))


@query(f"WITH s AS ({SCORED_SQL}), b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS p, avg(toxic) AS y FROM s GROUP BY bin) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b")
def d16_calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.calibration_error(relation(spark, d, SCORED_SQL), "score", "toxic"))


@query(f"WITH s AS ({SCORED_SQL}), q AS (SELECT quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM s), b AS (SELECT unnest(range(0, 10)) AS bin, e FROM q) SELECT bin, round(avg(score), 6) AS predicted, round(avg(toxic), 6) AS observed, count(*) AS n FROM b JOIN s ON score BETWEEN e[bin + 1] AND e[bin + 2] GROUP BY bin")
def d17_calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.calibration_curve(relation(spark, d, SCORED_SQL), "score", "toxic"))


@query(f"""WITH s AS ({SCORED_SQL}), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk, sum(toxic) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) / count(*) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS prec FROM s)
  SELECT round((sum(toxic * rk) - sum(toxic) * (sum(toxic) + 1) / 2) / (sum(toxic) * (count(*) - sum(toxic))), 6) AS auroc, round(sum(toxic * prec) / sum(toxic), 6) AS average_precision, round(avg(pow(score - toxic, 2)), 6) AS brier FROM r""")
def d18_ranking_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.ranking_scores(relation(spark, d, SCORED_SQL), "score", "toxic"))


@query(f"SELECT coalesce(lang, 'all') AS part, count(*) AS n, round(avg(toxic), 6) AS recall, round(avg(quality), 6) AS accuracy FROM ({SCORED_SQL}) GROUP BY GROUPING SETS ((), (lang))")
def d19_subset_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = relation(spark, d, SCORED_SQL)
    return rounded(rows.groupingSets([[], ["lang"]], "lang").agg(F.count("*").alias("n"), F.avg("toxic").alias("recall"), F.avg("quality").alias("accuracy")).select(F.coalesce("lang", F.lit("all")).alias("part"), "n", "recall", "accuracy"))


@query(None)
def d20_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return stats.fingerprint(table(spark, d, "events"))


@query("SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events")
def e5_average_ranks(spark: SparkSession, d: str) -> DataFrame:
    ranked = stats.ranked_by_value(table(spark, d, "events"), ("event_type",), "value").select("event_type", "value", "rank")
    return table(spark, d, "events").join(ranked, ["event_type", "value"]).select("event_id", "event_type", "rank")


_PAIR = "SELECT event_type, value, CAST(hour(ts) AS INT) AS h FROM events"


@query(f"WITH p AS ({_PAIR}), r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY h) + (count(*) OVER (PARTITION BY event_type, h) - 1) / 2.0 AS b FROM p) SELECT event_type, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY event_type")
def c20_j20_spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.spearman(relation(spark, d, _PAIR), ("event_type",), "value", "h"))


@query(None)
def e7_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    split = stats.stratified_split(table(spark, d, "labels"), "doc_id", "toxic")
    return split.groupBy("toxic", "split").agg(F.count("*").alias("n"))


@query(None)
def f9_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return stats.seeded_sample(table(spark, d, "events"), "event_id", 100)


@query(None)
def f9_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels")
    n = rows.count()
    return stats.bootstrap_weights(rows, "doc_id", 5, n // 2, n).groupBy("replicate").agg(F.sum("weight").alias("drawn"))


@query(f"""WITH s AS (SELECT lang AS a, toxic AS b FROM ({SCORED_SQL})), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM s GROUP BY a, b), t AS (SELECT sum(n) AS t FROM c), x AS (SELECT sum(n) AS m FROM c GROUP BY a), y AS (SELECT sum(n) AS m FROM c GROUP BY b),
  z AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS pab, (SELECT sum(m * (m - 1) / 2) FROM x) AS pa, (SELECT sum(m * (m - 1) / 2) FROM y) AS pb, (SELECT -sum(n / t * ln(n / t)) FROM c, t) AS hab, (SELECT -sum(m / t * ln(m / t)) FROM x, t) AS ha, (SELECT -sum(m / t * ln(m / t)) FROM y, t) AS hb, (SELECT t * (t - 1) / 2 FROM t) AS p)
  SELECT round((pab - pa * pb / p) / ((pa + pb) / 2 - pa * pb / p), 6) AS ari, round((ha + hb - hab) / ((ha + hb) / 2), 6) AS nmi FROM z""")
def j21_agreement(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.agreement(relation(spark, d, SCORED_SQL), "lang", "toxic"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


_CENTRES = """WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT id, label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e),
  m AS (SELECT label, i, avg(x) AS c FROM u GROUP BY label, i)"""


@query(_CENTRES + ", dd AS (SELECT u.id, m.label AS k, sqrt(sum((x - c) * (x - c))) AS d FROM u JOIN m USING (i) GROUP BY u.id, m.label) SELECT id, arg_min(k, d) AS assigned, round(min(d), 6) AS distance FROM dd GROUP BY id")
def c15_j10_nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return rounded(cluster.nearest_centroid(rows, "v", cluster.centroids(rows, "v", "label"), "label").select("id", "assigned", "distance"))


@query(_CENTRES + """, w AS (SELECT id, u.label, sum((x - c) * (x - c)) AS q FROM u JOIN m ON m.label = u.label AND m.i = u.i GROUP BY id, u.label), s AS (SELECT label, avg(sqrt(q)) AS s, sum(q) AS wi, count(*) AS n FROM w GROUP BY label),
  g AS (SELECT i, avg(x) AS z FROM u GROUP BY i), b AS (SELECT m.label, sum((c - z) * (c - z)) AS q FROM m JOIN g USING (i) GROUP BY m.label), cc AS (SELECT a.label AS p, b.label AS r, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY ALL),
  db AS (SELECT p, max((x.s + y.s) / d) AS v FROM cc JOIN s x ON x.label = p JOIN s y ON y.label = r GROUP BY p)
  SELECT round((SELECT avg(v) FROM db), 6) AS davies_bouldin, round((SELECT sum(wi) FROM s), 4) AS inertia, round(((SELECT sum(n * q) FROM b JOIN s USING (label)) / ((SELECT count(*) FROM s) - 1)) / ((SELECT sum(wi) FROM s) / ((SELECT count(*) FROM e) - (SELECT count(*) FROM s))), 6) AS calinski_harabasz""")
def j8_cluster_indices(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.indices(_vectors(spark, d), "v", "label")).withColumn("inertia", F.round("inertia", 4))


@query(None)
def j8_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.silhouette(_vectors(spark, d), "id", "v", "label"))


@query(None)
def j4_kmeans(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    model, scored = cluster.choose_kmeans(rows, "v")
    from pyspark.ml.functions import array_to_vector

    return model.transform(rows.withColumn("_f", array_to_vector("v"))).groupBy("cluster").agg(F.count("*").alias("n")).withColumn("k", F.lit(max(scored, key=lambda s: s[1])[0]))


@query(None)
def j5_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Mixtures of 3 to 9 components on nine standardised markers, missing ones imputed."""
    rows = wide(spark, d).withColumn("band", S.age_band(F.col("age")))
    whole = features.impute(rows, features.fit_imputer(rows, ("sex", "band"), catalog.MARKERS), ("sex", "band"), catalog.MARKERS)
    vectors = features.standardised(whole.select("id", *catalog.MARKERS), catalog.MARKERS, catalog.LOG_MARKERS).select("id", F.array(*catalog.MARKERS).alias("v"))
    mixture, scored = cluster.choose_mixture(vectors, "id", "v")
    tried = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(b)).alias("bic")) for k, b in scored])
    return cluster.mixture_labels(vectors, "id", "v", mixture).select("id", "cluster", "certainty", F.lit(len(mixture.weights)).alias("k"), tried.alias("tried"))


@query(None)
def j6_dbscan(spark: SparkSession, d: str) -> DataFrame:
    """Clusters and noise of all vectors on their first two components: 25 neighbours within the radius that J7 finds, and the share of label 0 among noise and core."""
    rows = durable(cluster.project(_vectors(spark, d), "v", 2)[0].select("id", F.col("map").alias("v"), (F.col("label") == 0).cast("int").alias("symptom")))
    eps = cluster.neighbour_distance(rows, "id", "v", 25).first()[0]
    labelled = neighbours.density_clusters(rows, "id", "v", eps, 25).join(rows.select("id", "symptom"), "id")
    return rounded(neighbours.noise_profile(labelled, "symptom"))


@query(_CENTRES + ", p AS (SELECT a.id AS a, b.id AS b, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM u a JOIN u b ON a.i = b.i AND a.id <> b.id GROUP BY ALL), k AS (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p) SELECT round(quantile_cont(d, 0.9), 6) AS eps FROM k WHERE r = 25")
def j7_neighbour_distance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.neighbour_distance(_vectors(spark, d), "id", "v", 25, sample=None))


@query(None)
def j9_projection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.project(_vectors(spark, d), "v")[0].select("id", F.col("map")[0].alias("x"), F.col("map")[1].alias("y")))


_PROFILE = f"SELECT id, site, coalesce(TSH, 1.0) AS TSH, coalesce(MG, 0.8) AS MG, CAST(fatigue_severity >= 7 AS INT) AS tired FROM ({WIDE_SQL}) x"


@query(f"WITH p AS ({_PROFILE}), o AS (SELECT median(TSH) AS a, stddev_pop(TSH) AS b, median(MG) AS c, stddev_pop(MG) AS d, count(*) AS n FROM p) SELECT site, count(*) AS size, round(count(*) / max(n), 6) AS share, round(median(TSH), 6) AS median_TSH, round(median(MG), 6) AS median_MG, round((median(TSH) - max(a)) / max(b), 6) AS z_TSH, round((median(MG) - max(c)) / max(d), 6) AS z_MG, round(avg(tired), 6) AS rate_tired FROM p, o GROUP BY site")
def d11_profiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.profiles(relation(spark, d, _PROFILE), "site", ("TSH", "MG"), ("tired",)))


@query(f"WITH p AS ({_PROFILE}), o AS (SELECT median(TSH) AS a, stddev_pop(TSH) AS b, median(MG) AS c, stddev_pop(MG) AS d FROM p), z AS (SELECT site, (median(TSH) - max(a)) / max(b) * 10 AS t, (median(MG) - max(c)) / max(d) * 10 AS m FROM p, o GROUP BY site) SELECT site, CASE WHEN abs(t) < 0.6 AND abs(m) < 0.6 THEN 'Balanced profile' WHEN abs(m) < 0.6 THEN CASE WHEN t < 0 THEN 'Low TSH' ELSE 'High TSH' END WHEN abs(t) < 0.6 THEN CASE WHEN m < 0 THEN 'Low MG' ELSE 'High MG' END WHEN abs(t) > abs(m) THEN concat(CASE WHEN t < 0 THEN 'Low TSH' ELSE 'High TSH' END, ' / ', CASE WHEN m < 0 THEN 'Low MG' ELSE 'High MG' END) ELSE concat(CASE WHEN m < 0 THEN 'Low MG' ELSE 'High MG' END, ' / ', CASE WHEN t < 0 THEN 'Low TSH' ELSE 'High TSH' END) END AS name FROM z")
def f7_profile_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the sites' profiles, with deviations ten times as large so that some stand out."""
    rows = cluster.profiles(relation(spark, d, _PROFILE), "site", ("TSH", "MG"), ("tired",))
    return rows.select("site", cluster.profile_name({"TSH": F.col("z_TSH") * 10, "MG": F.col("z_MG") * 10}).alias("name"))


@query(f"WITH p AS ({_PROFILE}), c AS (SELECT site, count(*) / sum(count(*)) OVER () AS share, avg(tired) AS r, quantile_cont(TSH, 0.1) AS lo, quantile_cont(TSH, 0.9) AS hi FROM p GROUP BY site) SELECT site, round(lo, 6) AS band_low, round(hi, 6) AS band_high FROM c WHERE share >= 0.05 ORDER BY r, site LIMIT 1")
def d26_cluster_band(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.best_cluster_band(relation(spark, d, _PROFILE), "site", "TSH", "tired"))


_CURVE = "SELECT CAST(value / 10 AS DOUBLE) AS x, CAST(CASE WHEN abs(value - 250) > 120 AND event_id % 3 > 0 OR event_id % 11 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS y, CAST(user_id % 50 AS DOUBLE) AS age, CAST(user_id % 2 AS DOUBLE) AS female, event_id FROM events"


@query(None)
def j11_j12_risk_band(spark: SparkSession, d: str) -> DataFrame:
    """The contiguous range around the least risk of a spline model."""
    curve = bands.risk_curve(relation(spark, d, _CURVE), "x", "y", ("age", "female"))
    return rounded(bands.band(curve, "x"), 3)


@query(None)
def j13_band_interval(spark: SparkSession, d: str) -> DataFrame:
    return bands.bootstrap_edges(relation(spark, d, _CURVE), "event_id", "x", "y", ("age", "female"), replicates=20, size=15_000)


_GRID = "SELECT event_type AS marker, CAST(floor(value / 25) AS INT) AS point, avg(value) AS x, avg(CAST(event_id % 7 AS DOUBLE)) AS risk FROM events GROUP BY event_type, CAST(floor(value / 25) AS INT)"


@query(f"WITH c AS ({_GRID}), m AS (SELECT *, min(risk) OVER (PARTITION BY marker) AS lo, max(risk) OVER (PARTITION BY marker) AS hi, first_value(point) OVER (PARTITION BY marker ORDER BY risk, point) AS at FROM c), o AS (SELECT * FROM m WHERE risk > 1.25 * lo) SELECT marker, round(min(x), 6) AS band_low, round(max(x), 6) AS band_high FROM m WHERE hi >= 1.3 * lo AND NOT EXISTS (SELECT 1 FROM o WHERE o.marker = m.marker AND o.point BETWEEN least(m.at, m.point) AND greatest(m.at, m.point)) GROUP BY marker")
def e10_contiguous_band(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bands.band(relation(spark, d, _GRID), "x", ("marker",)).select("marker", "band_low", "band_high"))


_TRUTH = [("click", 30.0), ("view", 75.0), ("error", 240.0)]


@query("WITH b AS (SELECT event_type AS marker, quantile_cont(value, 0.5) AS edge, quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM events GROUP BY event_type) SELECT marker, round(abs(edge - truth) / abs(truth), 6) AS relative_error, truth BETWEEN lo AND hi AS in_interval, hi - lo < 300 AS narrower FROM b JOIN (VALUES ('click', 30.0::DOUBLE), ('view', 75.0), ('error', 240.0)) t(marker, truth) USING (marker)")
def j22_band_errors(spark: SparkSession, d: str) -> DataFrame:
    quartiles = stats.percentiles(table(spark, d, "events").withColumnRenamed("event_type", "marker"), ("marker",), F.col("value"), (0.25, 0.5, 0.75), "q")
    found = quartiles.select("marker", F.col("q")[1].alias("edge"), F.col("q")[0].alias("ci_low"), F.col("q")[2].alias("ci_high"), (F.col("q")[2] - F.col("q")[0]).alias("width"), F.lit(300.0).alias("reference_width"))
    return rounded(bands.band_errors(found, F.broadcast(spark.createDataFrame(_TRUTH, "marker string, truth double"))))


_MODEL = f"SELECT id, coalesce(TSH, 1.0) AS TSH, coalesce(MG, 0.8) AS MG, coalesce(VITD, 60.0) AS VITD, CAST(coalesce(age, 45) AS DOUBLE) AS age, CASE WHEN coalesce(TSH, 1.0) > 3.2 OR coalesce(VITD, 60.0) < 62 THEN 1 ELSE 0 END AS y FROM ({WIDE_SQL}) x"
_COLUMNS = ("TSH", "MG", "VITD", "age")


#: Three targets that the markers and age decide, but for a share of the rows.
_TARGETS = ("fatigue", "brain_fog", "hair_loss")
_TARGET_SQL = {"fatigue": "TSH > 2.8 AND id % 9 > 0 OR id % 10 = 0", "brain_fog": "VITD * 0.02 + B12 * 0.003 < 2.6 AND id % 8 > 0 OR id % 11 = 0", "hair_loss": "(FERRITIN < 60 OR ZINC < 13) AND id % 7 > 0 OR id % 12 = 0"}


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    """J2's features of all customers with the three targets."""
    rows = wide(spark, d)
    medians = features.fit_imputer(rows.withColumn("band", S.age_band(F.col("age"))), ("sex", "band"), catalog.MARKERS)
    made = features.features(rows, medians).withColumns({t: F.expr(f"CAST(coalesce({e}, false) AS INT)") for t, e in _TARGET_SQL.items()})
    return made.select("id", *features.MODEL_COLUMNS, *_TARGETS)


@query(None)
def j14_j15_j18_risk_scores(spark: SparkSession, d: str) -> DataFrame:
    """All customers scored for three targets: trees stopped early in up to 1,500 rounds, calibrated."""
    rows = durable(_cohort(spark, d))
    models = risk.train_targets(rows, features.MODEL_COLUMNS, _TARGETS, "id")
    out = None
    for t, model in models.items():
        made = risk.gated(risk.score(rows, model), catalog.MARKERS).select("id", F.lit(t).alias("target"), "probability", "level", "prevalence", "note")
        out = made if out is None else out.unionByName(made)
    return rounded(out)


@query(None)
def j16_logistic_baseline(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = relation(spark, d, _MODEL)
    made = risk.baseline(rows, _COLUMNS, "y").transform(rows).select("id", "y", vector_to_array("probability")[1].alias("p"))
    return rounded(stats.ranking_scores(made, "p", "y"))


@query(None)
def j17_f4_d24_j23_drivers(spark: SparkSession, d: str) -> DataFrame:
    """Each row's strongest contributions by marker, a derived feature's share split over the markers it comes from."""
    rows = durable(_cohort(spark, d))
    made = risk.contributions(rows, risk.train(rows, features.MODEL_COLUMNS, "fatigue", "id", iterations=20), "id")
    marked = risk.by_marker(made, "id", features.MODEL_COLUMNS, features.SOURCES | {f"{m}_missing": (m,) for m in catalog.MARKERS})
    return risk.top_drivers(marked, "id").select("id", F.size("drivers").alias("n"), F.col("drivers")[0]["marker"].alias("first"))


_CONTRIB = "SELECT event_id, event_type AS marker, value - 245 AS contribution FROM events"


@query(f"SELECT marker, round(avg(abs(contribution)), 6) AS importance FROM ({_CONTRIB}) GROUP BY marker")
def d24_importance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.importance(relation(spark, d, _CONTRIB)))


@query(f"SELECT round(sum(CASE WHEN marker IN ('click', 'view') THEN abs(contribution) ELSE 0 END) / sum(abs(contribution)), 6) AS demographic_share FROM ({_CONTRIB})")
def j23_demographic_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.demographic_share(relation(spark, d, _CONTRIB), ("click", "view")))


_KNOTS = [(0.0, 0.05), (100.0, 0.1), (250.0, 0.4), (400.0, 0.9)]


@query("SELECT event_id, round(p, 6) AS p, CASE WHEN p < 0.15 THEN 'low' WHEN p < 0.35 THEN 'moderate' ELSE 'elevated' END AS level, round(1 / (1 + exp(-value / 100)), 6) AS s FROM (SELECT event_id, value, CASE WHEN value <= 0 THEN 0.05 WHEN value < 100 THEN 0.05 + 0.05 * value / 100 WHEN value < 250 THEN 0.1 + 0.3 * (value - 100) / 150 WHEN value < 400 THEN 0.4 + 0.5 * (value - 250) / 150 ELSE 0.9 END AS p FROM events)")
def h11_h12_h13_calibrated(spark: SparkSession, d: str) -> DataFrame:
    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _KNOTS])
    rows = table(spark, d, "events").withColumn("p", S.interpolate(F.col("value"), knots))
    return rounded(rows.select("event_id", "p", S.risk_level(F.col("p")).alias("level"), S.sigmoid(F.col("value") / 100).alias("s")))


@query("WITH l AS (SELECT event_type AS marker, quantile_cont(value, [" + ", ".join(f"{i / 100}" for i in range(1, 100)) + "]) AS q, quantile_cont(value, 0.3) AS lo, quantile_cont(value, 0.6) AS hi FROM events GROUP BY event_type), p AS (SELECT event_id, CASE WHEN value < 50 THEN 'below' WHEN value > 400 THEN 'above' ELSE 'within' END AS reference_status, CASE WHEN value < lo THEN 'below' WHEN marker <> 'view' AND value > hi THEN 'above' ELSE 'within' END AS functional_status, CASE WHEN len(list_filter(q, lambda x: x <= value)) = 99 THEN 100 ELSE len(list_filter(q, lambda x: x <= value)) END AS percentile, round((value - 50) / 350, 6) AS reference_position FROM events JOIN l ON marker = event_type) SELECT *, CASE WHEN reference_status = 'below' THEN 'low' WHEN reference_status = 'above' THEN 'high' WHEN functional_status <> 'within' THEN 'borderline' ELSE 'in_range' END AS status FROM p")
def h14_h15_h16_j19_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("marker"), "value", F.lit(50.0).alias("low"), F.lit(400.0).alias("high"))
    ladder = stats.percentile_ladder(rows, ("marker",), "value")
    found = ladder.select("marker", "ladder", F.col("ladder")[29].alias("band_low"), F.col("ladder")[59].alias("band_high")).withColumns({"low_limited": F.lit(False), "high_limited": F.col("marker") == "view"})
    made = reports.band_positions(rows, found)
    return rounded(made.select("event_id", "reference_status", "functional_status", "percentile", "status", S.reference_position(F.col("value"), F.col("low"), F.col("high")).alias("reference_position")))


@query("SELECT marker, round(m, 6) AS log_mean, round(s, 6) AS log_sd, round(m - 0.674 * s, 6) AS log_q1, round(m + 0.674 * s, 6) AS log_q3, n FROM (SELECT marker, (ln(greatest(lo, 1e-3)) + ln(greatest(hi, 1e-3))) / 2 AS m, (ln(greatest(hi, 1e-3)) - ln(greatest(lo, 1e-3))) / 3.92 * 2 AS s, n FROM (SELECT event_type AS marker, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, count(*) AS n FROM events GROUP BY event_type))")
def h27_prior_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.percentiles(table(spark, d, "events").withColumnRenamed("event_type", "marker"), ("marker",), F.col("value"), (0.025, 0.975), "q")
    return rounded(rows.select("marker", *[e.alias(n) for n, e in S.prior_stats(F.col("q")[0], F.col("q")[1]).items()], "n"))


@query(LAKE + ", i AS (SELECT DISTINCT event_id, 'misread' AS kind FROM raw WHERE event_id % 97 = 0 UNION SELECT DISTINCT event_id, 'not a number' FROM raw WHERE event_id % 193 = 0 UNION SELECT DISTINCT event_id, 'no unit' FROM raw WHERE event_id % 13 = 0), o AS (SELECT DISTINCT CAST(event_id AS BIGINT) AS event_id, 'misread' AS kind FROM flagged WHERE decimal_misread_suspect UNION SELECT DISTINCT CAST(event_id AS BIGINT), 'not a number' FROM flagged WHERE unparseable UNION SELECT DISTINCT CAST(event_id AS BIGINT), 'no unit' FROM flagged WHERE unit_inferred) SELECT kind, count(i.event_id) AS injected, count(CASE WHEN i.event_id IS NOT NULL AND o.event_id IS NOT NULL THEN 1 END) AS detected, count(CASE WHEN i.event_id IS NULL THEN 1 END) AS spurious, round(count(CASE WHEN i.event_id IS NOT NULL AND o.event_id IS NOT NULL THEN 1 END) / nullif(count(i.event_id), 0), 6) AS share FROM i FULL JOIN o USING (event_id, kind) GROUP BY kind")
def d14_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """The faults that the raw rows were made with, by their numbers, against what the flags of the lake say of them."""
    kinds = {"misread": "event_id % 97 = 0", "not a number": "event_id % 193 = 0", "no unit": "event_id % 13 = 0"}
    events, rows = table(spark, d, "events"), _flagged(spark, d).withColumn("event_id", F.col("event_id").cast("long"))
    found = {"misread": F.col("decimal_misread_suspect"), "not a number": F.col("unparseable"), "no unit": F.col("unit_inferred")}
    many = lambda t, conditions: t.select("event_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]))).alias("kind"))
    return rounded(stats.reconciliation(many(events, {k: F.expr(c) for k, c in kinds.items()}), many(rows, found), "event_id", "kind"))


@query(LAKE + "SELECT CAST(c.event_id AS BIGINT) AS event_id, abs(c.value_si - t.milli / 1000) <= 0.01 * t.milli / 1000 AS hit FROM (SELECT DISTINCT event_id, value_si FROM converted WHERE value_si IS NOT NULL) c JOIN (SELECT event_id, CASE event_type WHEN 'signup' THEN floor(round(value * 100) / 5) WHEN 'error' THEN round(value * 100) WHEN 'click' THEN round(value * 100) * 10 WHEN 'view' THEN round(value * 100) * 5 ELSE floor(round(value * 100) / 15) END AS milli FROM events) t USING (event_id)")
def c18_truth_match(spark: SparkSession, d: str) -> DataFrame:
    """Converted values against the ones that the rows were made from, within one per cent."""
    truth = table(spark, d, "events").select("event_id", F.expr("CASE event_type WHEN 'signup' THEN floor(round(value * 100) / 5) WHEN 'error' THEN round(value * 100) WHEN 'click' THEN round(value * 100) * 10 WHEN 'view' THEN round(value * 100) * 5 ELSE floor(round(value * 100) / 15) END / 1000").alias("t"))
    found = lake.converted(raw(spark, d)).where("value_si is not null").select("event_id", "value_si").distinct()
    return found.join(truth, "event_id").select("event_id", (F.abs(F.col("value_si") - F.col("t")) <= 0.01 * F.col("t")).alias("hit"))


@query(LAKE + "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM converted WHERE value_si IS NOT NULL)")
def g3_missing_fields(spark: SparkSession, d: str) -> DataFrame:
    found = lake.converted(raw(spark, d)).where("value_si is not null").select("event_id").distinct()
    return table(spark, d, "events").select("event_id").join(found, "event_id", "left_anti")


@query(f"SELECT lang, label, count(*) AS n FROM ({SCORED_SQL}) s JOIN embeddings e ON e.vec_id = s.doc_id GROUP BY ALL")
def c17_labels_join(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, SCORED_SQL).join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id")).groupBy("lang", "label").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT event_type, 'high' AS measure, coalesce(value > 300, false) AS hit FROM events UNION ALL SELECT event_type, 'low', coalesce(value < 20, false) FROM events), r AS (SELECT measure, event_type, count(*) AS n, count_if(hit) AS hits FROM m GROUP BY ALL), w AS (SELECT *, hits / n AS rate, sum(hits) OVER (PARTITION BY measure) / sum(n) OVER (PARTITION BY measure) AS whole FROM r) SELECT measure, event_type, n, hits, round(rate * 100, 1) AS percent, round((rate - whole) * 100, 1) + 0.0 AS points_off, row_number() OVER (PARTITION BY measure ORDER BY rate DESC, event_type) AS place FROM w")
def j24_insight_table(spark: SparkSession, d: str) -> DataFrame:
    return stats.insight_table(table(spark, d, "events"), "event_type", {"high": F.col("value") > 300, "low": F.col("value") < 20})
