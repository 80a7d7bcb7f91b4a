"""Queries on the lake chain: scans, matching, conversion, flags, audits, pivots (A, B, C, D, E, G, H, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scalar as S
from ..operators import features, graph, lake, normalize, quality, text
from ..sources import io
from .base import LAKE, MARKERS, RAW_SQL, forms, patients, query, raw, rounded, table


def _flagged(spark: SparkSession, d: str, compat: bool = False) -> DataFrame:
    """Converted rows are written once: statistics and flags both read them, so reading, matching and conversion run once.

    Of duplicates that the rank's order leaves equal, the earlier event comes first: the twins leave this open, and give other rows from run to run.
    """
    base = io.durable(lake.converted(raw(spark, d)))
    return lake.flagged(base, quality.population_stats(base, where=lake.plausible()), compat, ties=("event_id",))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return lake.gold(lake.silver(_flagged(spark, d)), patients(spark, d), lake.questionnaires(forms(spark, d)), MARKERS)


_GOLD = ", ".join([f"round({m}, 6) AS {m}" for m in MARKERS] + [f"{m}_low_quality" for m in MARKERS])


@query(LAKE + f"SELECT report_id, patient_id, lab_provider, CAST(collected_at AS VARCHAR) AS collected_at, {_GOLD}, n_reports, rk, sex, age, fatigue_severity, brain_fog_frequency, hair_loss FROM gold")
def i15_lake_gold(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain, raw rows to patient features."""
    return rounded(_gold(spark, d))


@query(LAKE + "SELECT report_id, patient_id, lab_provider, collected_at, marker, loinc, panel, round(value_si, 6) AS value_si, unit AS unit_si, qualifier, round(label_confidence, 6) AS label_confidence, match_method, unit_inferred, implausible, decimal_misread_suspect, round(z_log, 6) AS z_log, iqr_outlier FROM silver")
def b7_silver(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lake.silver(_flagged(spark, d)))


@query(f"SELECT report_id, patient_id, lab_provider, collected_at, raw_label, raw_value, raw_unit, raw_reference, flag FROM ({RAW_SQL})")
def b1_g1_bronze(spark: SparkSession, d: str) -> DataFrame:
    """Five sources conformed and united."""
    rows = raw(spark, d)
    return lake.bronze(*[rows.where(f"lab_provider = 'lab{i}'") for i in range(5)])


@query(LAKE + "SELECT label, marker, round(label_confidence, 6) AS confidence, match_method FROM label_map WHERE label IN (SELECT raw_label FROM raw)")
def i1_i2_label_match(spark: SparkSession, d: str) -> DataFrame:
    return rounded(normalize.match_labels(raw(spark, d)))


@query("SELECT event_type AS marker, concat('e-', event_type) AS loinc, 'events' AS panel, 'u/l' AS unit, round(min(value), 6) AS ref_low, round(max(value), 6) AS ref_high, round(min(value) / 10, 6) AS plaus_low, round(max(value) * 10, 6) AS plaus_high, 'mu/l,u/l' AS units, array_to_string(list_sort([event_type, concat('the ', event_type)]), ',') AS aliases, round(max(CASE WHEN user_id % 2 = 0 THEN value END), 6) AS female_high, CASE WHEN count(*) > 100 THEN 'urgent' ELSE 'priority' END AS level FROM events GROUP BY event_type")
def a14_catalog_document(spark: SparkSession, d: str) -> DataFrame:
    """A catalog document written from the event types' ranges, read into its dimension tables, and these joined."""
    path = io.scratch(spark, "catalog")
    bounds = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    low, high, kind = F.min("value"), F.max("value"), F.col("event_type")
    markers = table(spark, d, "events").groupBy(kind).agg(low.alias("low"), high.alias("high"), F.max(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("female"), F.count("*").alias("n")).select(F.struct(
        kind.alias("marker"), F.concat(F.lit("e-"), kind).alias("loinc"), F.lit("events").alias("panel"), F.lit("u/l").alias("unit"), F.array(kind, F.concat(F.lit("the "), kind)).alias("aliases"), F.create_map(F.lit("u/l"), F.lit(1.0), F.lit("mu/l"), F.lit(0.001)).alias("units"),
        bounds(F.col("low"), F.col("high")).alias("reference"), F.create_map(F.lit("F"), bounds(F.col("low"), F.col("female"))).alias("reference_by_sex"), bounds(F.col("low") / 10, F.col("high") * 10).alias("plausible"),
        F.array(F.struct(F.lit(">").alias("op"), F.col("high").alias("bound"), F.when(F.col("n") > 100, "urgent").otherwise("priority").alias("level"), F.lit("high").alias("reason"))).alias("escalation"),
    ).alias("m"))
    markers.agg(F.lit("v1").alias("version"), F.collect_list("m").alias("markers")).write.json(path)  # a row for each of a few event types
    t = io.read_catalog(spark, path)
    listed = lambda name, column: t[name].groupBy("marker").agg(F.array_join(F.sort_array(F.collect_list(column)), ",").alias(name))
    whole = t["meta"].join(listed("units", "unit_clean"), "marker").join(listed("aliases", "alias"), "marker").join(t["sex_references"].where("sex = 'F'").select("marker", F.col("sex_high").alias("female_high")), "marker").join(t["escalation"].select("marker", "level"), "marker")
    return rounded(whole)


@query(None)
def i1_label_match_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return rounded(normalize.match_labels(raw(spark, d), method="levenshtein"))


@query(f"SELECT DISTINCT coalesce(raw_label, '') AS raw_label FROM ({RAW_SQL})")
def d7_distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select(F.coalesce("raw_label", F.lit("")).alias("raw_label")).distinct()


@query(LAKE + "SELECT event_id, marker, loinc, panel, match_method, count(*) AS copies FROM parsed GROUP BY ALL")
def c1_c2_mapped_rows(spark: SparkSession, d: str) -> DataFrame:
    return lake.converted(raw(spark, d)).groupBy("event_id", "marker", "loinc", "panel", "match_method").agg(F.count("*").alias("copies"))


@query(LAKE + "SELECT DISTINCT p.event_id, u.unit_clean, round(p.number * u.factor, 6) AS v FROM parsed p JOIN units u ON u.marker = p.marker")
def c3_unit_expansion(spark: SparkSession, d: str) -> DataFrame:
    rows = lake.converted(raw(spark, d)).select("event_id", "marker", "number")
    return rounded(rows.join(F.broadcast(catalog.units(spark)), "marker").select("event_id", "unit_clean", (F.col("number") * F.col("factor")).alias("v")).distinct())


@query(LAKE + "SELECT DISTINCT p.event_id, p.marker, p.unit_clean FROM parsed p LEFT JOIN units k ON k.marker = p.marker AND k.unit_clean = p.unit_clean WHERE k.factor IS NULL")
def c4_unknown_units(spark: SparkSession, d: str) -> DataFrame:
    rows = lake.converted(raw(spark, d)).select("event_id", "marker", "unit_clean").distinct()
    return rows.join(F.broadcast(catalog.units(spark)), ["marker", "unit_clean"], "left_anti")


@query(LAKE + "SELECT DISTINCT p.event_id, p.marker, k.factor FROM parsed p LEFT JOIN units k ON k.marker = p.marker AND k.unit_clean = p.unit_clean")
def c5_unit_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = lake.converted(raw(spark, d)).select("event_id", "marker", "unit_clean").distinct()
    return rows.join(F.broadcast(catalog.units(spark)), ["marker", "unit_clean"], "left").select("event_id", "marker", "factor")


@query(LAKE + "SELECT event_id, marker, round(value_si, 6) AS value_si, unit_inferred, count(*) AS copies FROM converted GROUP BY ALL")
def c6_e1_i3_conversion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lake.converted(raw(spark, d)).groupBy("event_id", "marker", "value_si", "unit_inferred").agg(F.count("*").alias("copies")))


@query(LAKE + "SELECT marker, round(log_mean, 6) AS log_mean, round(log_sd, 6) AS log_sd, round(log_q1, 6) AS log_q1, round(log_q3, 6) AS log_q3, n FROM pop_stats")
def d1_population_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.population_stats(io.durable(lake.converted(raw(spark, d))), where=lake.plausible()))


@query(LAKE + "SELECT event_id, marker, unparseable, implausible, round(z_log, 6) AS z_log, iqr_outlier, decimal_misread_suspect, count(*) AS copies FROM flagged GROUP BY ALL")
def b6_c7_i6_i9_flags(spark: SparkSession, d: str) -> DataFrame:
    cols = ["event_id", "marker", "unparseable", "implausible", "z_log", "iqr_outlier", "decimal_misread_suspect"]
    return rounded(_flagged(spark, d).groupBy(*cols).agg(F.count("*").alias("copies")))


@query(LAKE + "SELECT count(*) AS n, sum(CAST(abs((ln(greatest(value_si, 1e-6)) - log_mean) / log_sd) > 4 AS INT)) AS outliers FROM flagged1")
def i7_compat_outliers(spark: SparkSession, d: str) -> DataFrame:
    """The mode in which an unreadable value passes the floor and counts as an outlier."""
    return _flagged(spark, d, compat=True).agg(F.count("*").alias("n"), F.count_if(F.abs("z_log") > 4).alias("outliers"))


@query(LAKE + "SELECT report_id, marker, count(*) AS n, max(dup_rank) AS worst, round(max(CASE WHEN dup_rank = 1 THEN value_si END), 6) AS kept FROM flagged GROUP BY report_id, marker")
def e2_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_flagged(spark, d).groupBy("report_id", "marker").agg(F.count("*").alias("n"), F.max("dup_rank").alias("worst"), F.max(F.when(F.col("dup_rank") == 1, F.col("value_si"))).alias("kept")))


_AUDIT = "count(*) AS rows_total, count_if(unparseable) AS unparseable, count_if(unit_inferred) AS units_inferred, count_if(implausible) AS implausible, count_if(decimal_misread_suspect) AS decimal_misread_suspects, count_if(abs(z_log) > 4) AS zscore_outliers, count_if(iqr_outlier) AS iqr_outliers, count_if(dup_rank > 1) AS duplicates, count_if(match_method = 'fuzzy') AS fuzzy_labels, count_if(qualifier IS NOT NULL) AS qualified"


@query(LAKE + f"SELECT lab_provider, {_AUDIT} FROM flagged GROUP BY lab_provider")
def d2_audit(spark: SparkSession, d: str) -> DataFrame:
    return lake.audit(_flagged(spark, d))


@query(LAKE + "SELECT lab_provider, count(*) AS unmapped_rows FROM raw WHERE coalesce(raw_label, '') NOT IN (SELECT label FROM label_map) GROUP BY lab_provider")
def d3_unmapped(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d)
    return lake.unmapped(rows, normalize.match_labels(rows))


@query(LAKE + f"SELECT a.*, coalesce(u.unmapped_rows, 0) AS unmapped_rows FROM (SELECT lab_provider, {_AUDIT} FROM flagged GROUP BY lab_provider) a LEFT JOIN (SELECT lab_provider, count(*) AS unmapped_rows FROM raw WHERE coalesce(raw_label, '') NOT IN (SELECT label FROM label_map) GROUP BY lab_provider) u USING (lab_provider)")
def c16_full_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d)
    return lake.full_audit(lake.audit(_flagged(spark, d)), lake.unmapped(rows, normalize.match_labels(rows)))


@query(LAKE + "SELECT count(*) AS rows_total, count_if(unit_inferred) AS units_inferred, count_if(dup_rank > 1) AS duplicates, (SELECT count(*) FROM label_map WHERE label IN (SELECT raw_label FROM raw)) AS labels_mapped FROM flagged")
def d8_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = lake.run(raw(spark, d), forms(spark, d), patients(spark, d))
    return lake.summary(rows).select("rows_total", "units_inferred", "duplicates", "labels_mapped")


@query(LAKE + f"SELECT report_id, patient_id, lab_provider, CAST(collected_at AS VARCHAR) AS collected_at, {_GOLD} FROM report_wide")
def d4_d5_d6_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lake.report_wide(lake.silver(_flagged(spark, d)), MARKERS))


@query(LAKE + "SELECT patient_id, report_id, n_reports FROM latest")
def e3_e4_latest(spark: SparkSession, d: str) -> DataFrame:
    return lake.latest(lake.report_wide(lake.silver(_flagged(spark, d)), MARKERS)).select("patient_id", "report_id", "n_reports")


@query(LAKE + "SELECT report_id, patient_id, fatigue_severity, brain_fog_frequency, hair_loss FROM proms")
def b2_b5_h7_questionnaires(spark: SparkSession, d: str) -> DataFrame:
    return lake.questionnaires(forms(spark, d))


@query(LAKE + "SELECT patient_id, age, sex, fatigue_severity FROM gold")
def c8_c9_h8_demographics(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).select("patient_id", "age", "sex", "fatigue_severity")


@query(LAKE + "SELECT event_id, marker, round(value_si, 6) AS value_si FROM converted WHERE value_si BETWEEN plaus_low AND plaus_high AND marker IS NOT NULL")
def b3_b4_range_filter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lake.converted(raw(spark, d)).where(F.col("marker").isNotNull() & lake.plausible()).select("event_id", "marker", "value_si"))


@query(LAKE + "SELECT patient_id FROM gold WHERE CAST(TSH IS NOT NULL AS INT) + CAST(FT4 IS NOT NULL AS INT) + CAST(VITD IS NOT NULL AS INT) + CAST(FERRITIN IS NOT NULL AS INT) + CAST(MG IS NOT NULL AS INT) >= 2 AND fatigue_severity IS NOT NULL AND brain_fog_frequency IS NOT NULL AND hair_loss IS NOT NULL")
def b8_eligible(spark: SparkSession, d: str) -> DataFrame:
    return features.eligible(_gold(spark, d), MARKERS, 2).select("patient_id")


@query(LAKE + "SELECT report_id, CAST(fatigue_severity >= 7 AS INT) AS fatigue, CAST(brain_fog_frequency IN ('often', 'always') AS INT) AS brain_fog, CAST(hair_loss IN ('moderate', 'severe') AS INT) AS hair_loss_target, list_position(['never', 'rarely', 'sometimes', 'often', 'always'], brain_fog_frequency) - 1 AS fog_code, CASE hair_loss WHEN 'none' THEN 0 WHEN 'mild' THEN 1 WHEN 'moderate' THEN 2 WHEN 'severe' THEN 3 END AS hair_code FROM proms")
def b9_b10_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = lake.questionnaires(forms(spark, d))
    return rows.select("report_id", *[e.alias(n) for n, e in features.targets().items()], features.ordinal_code(F.col("brain_fog_frequency"), catalog.FOG_LEVELS).alias("fog_code"), features.ordinal_code(F.col("hair_loss"), catalog.HAIR_LEVELS).alias("hair_code"))


@query(LAKE + "SELECT report_id, concat_ws(',', CASE WHEN fatigue_severity IS NULL THEN 'fatigue_severity' END, CASE WHEN brain_fog_frequency IS NULL THEN 'brain_fog_frequency' END, CASE WHEN hair_loss IS NULL THEN 'hair_loss' END) AS reasons FROM proms")
def b11_validation(spark: SparkSession, d: str) -> DataFrame:
    return features.validated(lake.questionnaires(forms(spark, d))).select("report_id", F.concat_ws(",", "reasons").alias("reasons"))


@query(LAKE + "SELECT event_id, level, reason FROM silver s JOIN " + catalog.sql_values(catalog.ESCALATION, "rm, op, bound, level, reason") + " r ON s.marker = r.rm AND ((op = '<' AND value_si < bound) OR (op = '>' AND value_si > bound))")
def c10_escalation_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = _flagged(spark, d).where("dup_rank = 1 and not unparseable").select("event_id", "marker", "value_si")
    return graph.triggered(rows, catalog.escalation_rules(spark), value="value_si").select("event_id", "level", "reason")


@query(LAKE + "SELECT s.event_id, coalesce(x.lo, s.ref_low) AS low, coalesce(x.hi, s.ref_high) AS high FROM silver s JOIN patients p USING (patient_id) LEFT JOIN " + catalog.sql_values(catalog.SEX_REFERENCES, "m, sx, lo, hi") + " x ON x.m = s.marker AND x.sx = p.sex")
def c22_sex_reference(spark: SparkSession, d: str) -> DataFrame:
    rows = _flagged(spark, d).where("dup_rank = 1 and not unparseable").join(patients(spark, d).select("patient_id", "sex"), "patient_id")
    return normalize.references(rows).select("event_id", "low", "high")


@query(LAKE + "SELECT marker, loinc, unit, ref_low, ref_high, count(*) AS labels FROM label_map JOIN meta USING (marker) WHERE label IN (SELECT raw_label FROM raw) GROUP BY ALL")
def c23_reference_cards(spark: SparkSession, d: str) -> DataFrame:
    cards = normalize.reference_card(raw(spark, d).select(F.col("raw_label").alias("name")))
    read = F.from_json("card", "marker string, loinc string, unit string, ref_low double, ref_high double")
    return cards.select(read.alias("c")).select("c.*").groupBy("marker", "loinc", "unit", "ref_low", "ref_high").agg(F.count("*").alias("labels"))


@query(LAKE + "SELECT report_id, string_agg(marker, ',' ORDER BY marker) AS missing FROM (SELECT r.report_id, m.marker FROM (SELECT DISTINCT report_id FROM silver) r CROSS JOIN (SELECT unnest(['TSH', 'FT4', 'VITD', 'FERRITIN', 'MG']) AS marker) m ANTI JOIN silver s ON s.report_id = r.report_id AND s.marker = m.marker) GROUP BY report_id")
def g2_missing_markers(spark: SparkSession, d: str) -> DataFrame:
    rows = lake.silver(_flagged(spark, d)).groupBy("report_id").agg(F.array_except(F.array(*map(F.lit, sorted(MARKERS))), F.collect_set("marker")).alias("m"))
    return rows.where(F.size("m") > 0).select("report_id", F.concat_ws(",", F.sort_array("m")).alias("missing"))


@query(LAKE + "SELECT lab_provider, panel, count(*) AS n FROM silver GROUP BY ALL")
def a4_a6_partitioned_zone(spark: SparkSession, d: str) -> DataFrame:
    """Silver written by panel, and read again with partition discovery."""
    path = io.scratch(spark, "silver")
    io.write_zone(lake.silver(_flagged(spark, d)), path, "panel")
    return io.read_zone(spark, path).groupBy("lab_provider", "panel").agg(F.count("*").alias("n"))


@query(f"SELECT lab_provider, count(*) AS n, count(raw_unit) AS units, min(raw_value) AS least FROM ({RAW_SQL}) GROUP BY lab_provider")
def a1_csv_sources(spark: SparkSession, d: str) -> DataFrame:
    """Four sources written as CSV with headers, one of them with other column order, and read again as text."""
    rows, path = raw(spark, d).select(*lake.LAB_COLUMNS), io.scratch(spark, "raw")
    for i in range(5):
        cols = lake.LAB_COLUMNS if i % 2 else lake.LAB_COLUMNS[::-1]
        rows.where(f"lab_provider = 'lab{i}'").select(*cols).write.option("header", True).csv(f"{path}/lab{i}")
    return io.read_lab_csv(spark, *[f"{path}/lab{i}" for i in range(5)]).groupBy("lab_provider").agg(F.count("*").alias("n"), F.count("raw_unit").alias("units"), F.min("raw_value").alias("least"))


@query(f"SELECT lab_provider, count(*) AS n, count(raw_unit) AS units, min(raw_value) AS least FROM ({RAW_SQL}) GROUP BY lab_provider")
def a2_jsonl_source(spark: SparkSession, d: str) -> DataFrame:
    path = io.scratch(spark, "raw")
    raw(spark, d).select(*lake.LAB_COLUMNS).write.json(path)
    return io.read_lab_jsonl(spark, path).groupBy("lab_provider").agg(F.count("*").alias("n"), F.count("raw_unit").alias("units"), F.min("raw_value").alias("least"))


@query(LAKE + "SELECT fatigue, brain_fog, count(*) AS n FROM forms GROUP BY ALL")
def a3_nested_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = io.scratch(spark, "forms")
    forms(spark, d).select("form_id", "report_id", "patient_id", "submitted_at", "answers").write.json(path)
    return io.read_intake(spark, path).groupBy("answers.fatigue", "answers.brain_fog").agg(F.count("*").alias("n"))


@query("SELECT event_type, label FROM (SELECT DISTINCT event_type FROM events) JOIN (VALUES ('click', 'FERRITIN'), ('view', 'VITD')) t(event_type, label) USING (event_type)")
def a5_dimension_upload(spark: SparkSession, d: str) -> DataFrame:
    small = spark.createDataFrame([("click", "FERRITIN"), ("view", "VITD")], "event_type string, label string")
    return table(spark, d, "events").select("event_type").distinct().join(F.broadcast(small), "event_type")


@query(LAKE + f"SELECT lab_provider, count(*) AS rows_total FROM flagged GROUP BY lab_provider")
def a7_audit_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Audit, statistics and summary written as files; the audit read again."""
    run, path = lake.run(raw(spark, d), forms(spark, d), patients(spark, d)), io.scratch(spark, "audit")
    io.write_audit(run.audit, run.stats, lake.summary(run), path)
    return spark.read.option("header", True).csv(f"{path}/audit").select("lab_provider", F.col("rows_total").cast("long").alias("rows_total"))


@query("SELECT page_id, strlen(coalesce(html, '')) + 1 AS bytes, sha256(concat(coalesce(html, ''), chr(10))) AS sha256 FROM pages")
def a8_document_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every page written as a file of its own and scanned as a document."""
    path = io.scratch(spark, "documents")
    io.write_documents(table(spark, d, "pages"), "page_id", "html", path)
    return io.scan_documents(spark, path, io.FOLDER).select(F.col("report_id").cast("long").alias("page_id"), "bytes", "sha256")


@query("SELECT 'events' AS view, count(*) AS n FROM events")
def a9_a10_named_view(spark: SparkSession, d: str) -> DataFrame:
    io.named(table(spark, d, "events"), "labspark_events")
    return spark.sql("SELECT 'events' AS view, count(*) AS n FROM labspark_events")


@query(LAKE + "SELECT report_id, marker, loinc, raw_label, raw_value, raw_unit, round(value_si, 6) AS value_si, unit AS unit_si, round(label_confidence, 6) AS confidence, match_method AS ocr_method FROM silver")
def a11_extracted_rows(spark: SparkSession, d: str) -> DataFrame:
    path = io.scratch(spark, "extracted")
    io.write_zone(_flagged(spark, d).where("dup_rank = 1 and not unparseable").select("report_id", "marker", "loinc", "raw_label", "raw_value", "raw_unit", "value_si", F.col("unit").alias("unit_si"), F.col("label_confidence").alias("confidence"), F.col("match_method").alias("ocr_method")), path)
    return rounded(io.read_zone(spark, path))


@query(None)
def a12_a13_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of written artifacts, and those of them that another manifest would reject."""
    from ..operators import stats

    path = io.scratch(spark, "models")
    rows = lake.converted(raw(spark, d))
    io.write_zone(quality.population_stats(rows, where=lake.plausible()), f"{path}/stats")
    print_ = stats.fingerprint(rows.select("report_id", "marker", "value_si")).first()[0]
    made = io.manifest(spark, path, print_)
    broken = made.withColumn("sha256", F.when(F.col("kind") == "parquet", F.lit("0")).otherwise(F.col("sha256")))
    return made.groupBy("kind").agg(F.count("*").alias("files")).join(io.unavailable(spark, broken, path).groupBy(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("kind")).agg(F.count("*").alias("rejected")), "kind", "left")


@query(LAKE + "SELECT DISTINCT event_id, nullif(regexp_extract(raw_value, '^ *([<>]=?)', 1), '') AS qualifier, TRY_CAST(replace(regexp_replace(raw_value, '[^0-9.,]', '', 'g'), ',', '.') AS DOUBLE) AS number, replace(replace(replace(replace(translate(lower(trim(coalesce(raw_unit, ''))), 'µμ', 'uu'), 'mcg', 'ug'), ' ', ''), 'litre', 'l'), 'liter', 'l') AS unit_clean FROM raw")
def h1_h4_h6_parsing(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("event_id", S.qualifier(F.col("raw_value")).alias("qualifier"), S.lenient_number(F.col("raw_value")).alias("number"), S.clean_unit(F.col("raw_unit")).alias("unit_clean")).distinct()


@query(LAKE + r"SELECT DISTINCT event_id, TRY_CAST(replace(regexp_extract(raw_value, '^\s*([<>]=?|≤|≥)?\s*(-?\d+(?:[.,]\d+)?)\s*$', 2), ',', '.') AS DOUBLE) AS number, nullif(regexp_extract(raw_value, '^\s*([<>]=?|≤|≥)?\s*(-?\d+(?:[.,]\d+)?)\s*$', 1), '') AS qualifier, trim(regexp_replace(lower(raw_label), '[^a-z0-9]+', ' ', 'g')) AS label FROM raw")
def h2_h3_h5_strict_parsing(spark: SparkSession, d: str) -> DataFrame:
    number, sign = S.parse_value(F.col("raw_value"))
    return raw(spark, d).select("event_id", number.alias("number"), sign.alias("qualifier"), catalog.clean_label(F.col("raw_label")).alias("label")).distinct()



@query(LAKE + r""", strict AS (SELECT event_id, marker, unit_clean, ref_low, ref_high, plaus_low, plaus_high, label_confidence, rid, TRY_CAST(replace(regexp_extract(raw_value, '^\s*([<>]=?|≤|≥)?\s*(-?\d+(?:[.,]\d+)?)\s*$', 2), ',', '.') AS DOUBLE) AS number FROM parsed),
    cand AS (SELECT s.rid, s.number * u.factor AS v, u.factor, CASE WHEN s.number * u.factor BETWEEN ref_low AND ref_high THEN 0 ELSE least(abs(ln(greatest(s.number * u.factor, 1e-3)) - ln(greatest(ref_low, 1e-3))), abs(ln(greatest(s.number * u.factor, 1e-3)) - ln(greatest(ref_high, 1e-3)))) END AS dist
      FROM strict s JOIN units u ON u.marker = s.marker WHERE s.number * u.factor BETWEEN plaus_low AND plaus_high),
    best AS (SELECT rid, arg_min(v, (dist, factor)) AS v, count(DISTINCT CASE WHEN dist = 0 THEN factor END) AS inside FROM cand GROUP BY rid)
    SELECT DISTINCT s.event_id, s.marker, round(coalesce(s.number * k.factor, b.v, s.number), 6) AS value_si, k.factor IS NULL AS unit_inferred, CASE WHEN k.factor IS NOT NULL THEN 1.0 WHEN b.v IS NULL THEN 0.2 WHEN b.inside > 1 THEN 0.45 ELSE 0.6 END::DOUBLE AS unit_confidence
    FROM strict s LEFT JOIN units k ON k.marker = s.marker AND k.unit_clean = s.unit_clean LEFT JOIN best b ON b.rid = s.rid WHERE s.number IS NOT NULL""")
def i4_report_conversion(spark: SparkSession, d: str) -> DataFrame:
    rows = lake.converted(raw(spark, d)).drop("unit_inferred", "value_si")
    rows = rows.join(F.broadcast(catalog.unit_arrays(spark)), "marker").withColumn("n", S.parse_value(F.col("raw_value"))[0]).where("n is not null")
    made = normalize.convert_report(F.col("n"), S.clean_unit_report(F.col("raw_unit")), F.col("units"), F.col("ref_low"), F.col("ref_high"), F.col("plaus_low"), F.col("plaus_high"))
    return rounded(rows.select("event_id", "marker", made.alias("c")).select("event_id", "marker", "c.value_si", "c.unit_inferred", "c.unit_confidence").distinct())


def _report_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d)
    return rows.select("event_id", "report_id", F.col("raw_label").alias("label"), F.col("raw_value").alias("value"), F.col("raw_unit").alias("unit"), F.col("raw_reference").alias("reference_text"), "flag", F.when(F.col("event_id") % 3 == 0, "M").otherwise("F").alias("sex"), F.lit(0.9).alias("ocr_confidence"))


@query(LAKE + r"SELECT reason AS reject_reason, count(*) AS n FROM (SELECT CASE WHEN l.marker IS NULL THEN 'unknown_marker' WHEN NOT regexp_matches(raw_value, '^\s*([<>]=?|≤|≥)?\s*(-?\d+(?:[.,]\d+)?)\s*$') THEN 'not_numeric' END AS reason FROM raw r LEFT JOIN label_map l ON l.label = coalesce(r.raw_label, '')) GROUP BY reason")
def i5_i17_normalised_rows(spark: SparkSession, d: str) -> DataFrame:
    return normalize.normalise_rows(_report_rows(spark, d)).groupBy("reject_reason").agg(F.count("*").alias("n"))


_DOCUMENT_SQL = "SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id"


@query(f"SELECT coalesce(error, 'none') AS error, count(*) AS documents FROM (SELECT CASE user_id % 7 WHEN 3 THEN 'not UTF-8 text' WHEN 5 THEN 'no text' WHEN 6 THEN 'no result rows' END AS error FROM ({_DOCUMENT_SQL})) GROUP BY 1")
def i16_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Report files, one a patient and some of them broken, read as one batch: a broken one is a row with its reason."""
    path = io.scratch(spark, "reports")
    line = F.concat_ws("    ", F.coalesce("raw_label", F.lit("TSH")), F.lit("2.5"), F.lit("mIU/L"), F.lit("0.40 - 4.00"))
    whole = raw(spark, d).groupBy(F.col("patient_id").alias("report_id")).agg(F.array_join(F.sort_array(F.collect_set(line)), "\n").alias("text"))
    kind = F.col("report_id").cast("long") % 7
    broken = F.when(kind == 3, F.unhex(F.lit("89504E470DFF")).cast("string")).when(kind == 5, " ").when(kind == 6, "Thank you for your visit.").otherwise(F.col("text"))
    io.write_documents(whole.withColumn("text", broken), "report_id", "text", path)
    rows, documents = text.ingest(io.read_documents(spark, path, io.FOLDER))
    good, bad = io.quarantined(documents)
    return good.unionByName(bad).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("documents"))


def _issues(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = normalize.normalise_rows(_report_rows(spark, d)).where("reject_reason is null").withColumn("line_no", F.col("event_id"))
    # Written once: the statistics' passes, the findings and the rollup all read these rows.
    rows = io.durable(rows.join(F.broadcast(catalog.meta(spark).select("marker", "ref_low", "ref_high", "plaus_low", "plaus_high")), "marker"))
    rows = rows.join(F.broadcast(quality.population_stats(rows, where=lake.plausible())), "marker")
    return rows, quality.report_issues(rows)


@query(None)
def i10_i14_issues(spark: SparkSession, d: str) -> DataFrame:
    """Findings of every check by code and severity."""
    return _issues(spark, d)[1].groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(None)
def d15_report_rollup(spark: SparkSession, d: str) -> DataFrame:
    return quality.report_rollup(*_issues(spark, d)).select("report_id", "completeness", F.concat_ws(",", "missing_markers").alias("missing"), F.size("issues").alias("issues"), "needs_clinician_attention")


@query(LAKE + "SELECT event_id, flag IS NOT NULL AND value_si <= 4.0 AS mismatch FROM silver WHERE flag IS NOT NULL")
def i12_flag_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = _flagged(spark, d).where("dup_rank = 1 and not unparseable and flag is not null")
    return rows.select("event_id", quality.flag_mismatch(F.col("value_si"), F.col("raw_reference"), F.col("flag")).alias("mismatch"))


@query(LAKE + "SELECT event_id, CASE WHEN NOT value_si BETWEEN ref_low AND ref_high THEN CASE WHEN value_si * 0.1 BETWEEN ref_low AND ref_high THEN 0.1 WHEN value_si * 0.01 BETWEEN ref_low AND ref_high THEN 0.01 WHEN value_si * 10 BETWEEN ref_low AND ref_high THEN 10 WHEN value_si * 100 BETWEEN ref_low AND ref_high THEN 100 END END::DOUBLE AS shift FROM silver")
def i10_decimal_shift(spark: SparkSession, d: str) -> DataFrame:
    rows = _flagged(spark, d).where("dup_rank = 1 and not unparseable")
    return rows.select("event_id", quality.decimal_shift(F.col("value_si"), F.col("ref_low"), F.col("ref_high")).alias("shift"))


@query(LAKE + "SELECT report_id, marker, count(*) - 1 AS extra, sum(CAST(abs(value_si - best) <= 0.05 * greatest(abs(value_si), abs(best)) AS INT)) - 1 AS near FROM (SELECT *, first_value(value_si) OVER (PARTITION BY report_id, marker ORDER BY label_confidence DESC, event_id) AS best FROM converted WHERE value_si IS NOT NULL) GROUP BY report_id, marker HAVING count(*) > 1")
def e11_i13_conflicts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    best = F.first("value_si").over(Window.partitionBy("report_id", "marker").orderBy(F.desc("label_confidence"), "event_id"))
    rows = lake.converted(raw(spark, d)).where("value_si is not null").withColumn("best", best)
    near = (F.abs(F.col("value_si") - F.col("best")) <= 0.05 * F.greatest(F.abs("value_si"), F.abs("best"))).cast("int")
    return rows.groupBy("report_id", "marker").agg((F.count("*") - 1).alias("extra"), (F.sum(near) - 1).alias("near")).where("extra > 0")
