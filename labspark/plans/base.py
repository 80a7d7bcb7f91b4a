"""Bindings of the operators to the given tables, and the registry of queries."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import catalog
from ..session import importable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its DuckDB twin if SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[name or f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Result rows as laboratories would send them, made from ``events``; the text runs in both engines.
#: ``event_id`` decides what is wrong with a row: spelling of labels, units left out, decimal commas, qualifiers, misread
#: points, text instead of a number, rows sent twice.
RESULTS_SQL = """
  SELECT event_id, ts, user_id, event_type,
    CASE event_type WHEN 'signup' THEN CAST(floor(cents / 5) AS BIGINT) WHEN 'error' THEN cents WHEN 'click' THEN cents * 10 WHEN 'view' THEN cents * 5 ELSE CAST(floor(cents / 15) AS BIGINT) END AS milli
  FROM (SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events) e"""
_UNITS = f"""
  SELECT *, CASE WHEN event_id % 2 = 0 THEN milli WHEN event_type = 'error' THEN CAST(round(milli / CAST(12.87 AS DOUBLE)) AS BIGINT) WHEN event_type = 'view' THEN CAST(round(milli / CAST(2.496 AS DOUBLE)) AS BIGINT)
      WHEN event_type = 'purchase' THEN CAST(round(milli / CAST(0.4114 AS DOUBLE)) AS BIGINT) ELSE milli END * CASE WHEN event_id % 97 = 0 THEN 10 ELSE 1 END AS shown,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 2 = 0 THEN CASE event_type WHEN 'signup' THEN ' mIU / L ' WHEN 'error' THEN 'pmol/L' WHEN 'click' THEN 'mcg/L' WHEN 'view' THEN 'nmol/litre' ELSE 'mmol/L' END
      ELSE CASE event_type WHEN 'signup' THEN 'µIU/mL' WHEN 'error' THEN 'ng/dL' WHEN 'click' THEN 'NG/ML' WHEN 'view' THEN 'ng/mL' ELSE 'mg/dL' END END AS raw_unit
  FROM ({RESULTS_SQL}) r"""
_TEXT = f"""
  SELECT *, CASE WHEN event_id % 193 = 0 THEN 'n/a' ELSE concat(CASE WHEN event_id % 11 = 0 THEN '<' ELSE '' END, CAST(CAST(floor(shown / 1000) AS BIGINT) AS STRING), CASE WHEN event_id % 7 = 0 THEN ',' ELSE '.' END, lpad(CAST(shown % 1000 AS STRING), 3, '0')) END AS raw_value
  FROM ({_UNITS}) u"""
_LABELS = {
    "signup": ("TSH", "TSH 3rd Generation", "Thyrotropn"), "error": ("Free T4", "Free Thyroxine (FT4)", "Free Thyroxne"), "click": ("Ferritin", "Ferritin, Serum", "Ferritn"),
    "view": ("Vitamin D", "25-OH Vitamin D", "Vitamin-D Totl"), "purchase": ("S. Magnesium", "Magnesium level (fasting)", "Magnesum"),
}
_CASES = " ".join(f"WHEN '{t}' THEN CASE WHEN event_id % 31 = 0 THEN '{bad}' WHEN event_id % 3 = 1 THEN '{b}' ELSE '{a}' END" for t, (a, b, bad) in _LABELS.items())
_ROWS = f"""
  SELECT event_id, concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS report_id, CAST(user_id AS STRING) AS patient_id, concat('lab', CAST(event_id % 5 AS STRING)) AS lab_provider,
    CAST(CAST(ts AS DATE) AS STRING) AS collected_at, CASE WHEN event_id % 41 = 0 THEN 'Hemoglobin' WHEN event_id % 211 = 0 THEN NULL ELSE CASE event_type {_CASES} END END AS raw_label,
    raw_value, raw_unit, '0.4 - 4.0' AS raw_reference, CASE WHEN event_id % 9 = 0 THEN 'H' END AS flag
  FROM ({_TEXT}) t"""
RAW_SQL = f"SELECT * FROM ({_ROWS}) a UNION ALL SELECT * FROM ({_ROWS}) b WHERE event_id % 101 = 0"

#: Intake forms from the same events.
FORMS_SQL = """
  SELECT concat('f', CAST(event_id AS STRING)) AS form_id, concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS report_id, CAST(user_id AS STRING) AS patient_id, CAST(ts AS STRING) AS submitted_at,
    CASE event_id % 4 WHEN 0 THEN CAST(1 + event_id % 11 AS STRING) WHEN 1 THEN concat(CAST(1 + event_id % 11 AS STRING), '/10') WHEN 2 THEN concat(CAST(1 + event_id % 11 AS STRING), ' out of 10') END AS fatigue,
    CASE event_id % 7 WHEN 0 THEN 'never' WHEN 1 THEN ' Seldom' WHEN 2 THEN 'occasionally' WHEN 3 THEN 'Most days' WHEN 4 THEN 'every day' WHEN 5 THEN 'unsure' END AS brain_fog,
    CASE event_id % 5 WHEN 0 THEN 'No' WHEN 1 THEN 'a little' WHEN 2 THEN 'moderate' WHEN 3 THEN 'a lot ' END AS hair_loss
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS nth FROM events) e WHERE nth = 1"""

PATIENTS_SQL = "SELECT CAST(c_custkey AS STRING) AS patient_id, CASE WHEN c_custkey % 3 = 0 THEN 'M' ELSE 'F' END AS sex, CAST(1940 + c_custkey % 70 AS INT) AS birth_year, c_mktsegment AS site FROM customer"

MARKERS = ("TSH", "FT4", "VITD", "FERRITIN", "MG")


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived relation over the given tables: the table's name in the text becomes its Parquet files."""
    return importable(spark).sql(re.sub(r"\bFROM (events|customer|orders|lineitem|documents|pages|benchmark|labels|conversations|embeddings|nation|region|supplier|part)\b", lambda m: f"FROM parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, RAW_SQL)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return relation(spark, sf_dir, FORMS_SQL).withColumn("answers", F.struct("fatigue", "brain_fog", "hair_loss"))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, PATIENTS_SQL)


def _clean(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def _label_rows() -> tuple:
    """The expected map of the labels that occur, by the standard library's matcher."""
    index = {_clean(a): m[0] for m in catalog.META for a in (*catalog.ALIASES[m[0]], m[3], m[4])}
    rows = []
    for label in [v for own in _LABELS.values() for v in own]:
        clean = _clean(label)
        begun = [a for a in index if len(a) >= 3 and (clean + " ").startswith(a + " ")]
        if clean in index:
            rows.append((label, index[clean], 1.0, "exact"))
        elif begun:
            rows.append((label, index[max(begun, key=len)], 0.95, "contains"))
        else:
            ratio, _, marker = max((difflib.SequenceMatcher(None, a, clean).ratio(), a, m) for a, m in index.items())
            if ratio >= 0.84:
                rows.append((label, marker, 0.9 * ratio, "fuzzy"))
    return tuple(rows)


LABEL_MAP = catalog.sql_values(_label_rows(), "label, marker, label_confidence, match_method")
META = catalog.sql_values(catalog.META, "marker, loinc, panel, display, long_name, unit, ref_low, ref_high, plaus_low, plaus_high")
UNITS = catalog.sql_values(catalog.UNITS, "marker, unit_clean, factor")
RULES = catalog.sql_values(catalog.ESCALATION, "marker, op, bound, level, reason")

#: The lake chain in DuckDB SQL, in the joined form that the operators replace by expressions in the row.
LAKE = f"""
WITH raw AS ({RAW_SQL}), label_map AS {LABEL_MAP}, meta AS {META}, units AS {UNITS},
parsed AS (
  SELECT r.*, l.marker, l.label_confidence, l.match_method, m.loinc, m.panel, m.unit, m.ref_low, m.ref_high, m.plaus_low, m.plaus_high,
    nullif(regexp_extract(raw_value, '^ *([<>]=?)', 1), '') AS qualifier, TRY_CAST(replace(regexp_replace(raw_value, '[^0-9.,]', '', 'g'), ',', '.') AS DOUBLE) AS number,
    replace(replace(replace(replace(translate(lower(trim(coalesce(raw_unit, ''))), 'µμ', 'uu'), 'mcg', 'ug'), ' ', ''), 'litre', 'l'), 'liter', 'l') AS unit_clean,
    row_number() OVER () AS rid
  FROM raw r JOIN label_map l ON coalesce(r.raw_label, '') = l.label JOIN meta m ON m.marker = l.marker),
candidates AS (
  SELECT p.rid, p.number * u.factor AS v, row_number() OVER (PARTITION BY p.rid ORDER BY abs(ln(greatest(p.number * u.factor, 1e-6)) - ln((ref_low + ref_high) / 2)), u.factor) AS rn
  FROM parsed p JOIN units u ON u.marker = p.marker LEFT JOIN units k ON k.marker = p.marker AND k.unit_clean = p.unit_clean
  WHERE k.factor IS NULL AND p.number * u.factor BETWEEN plaus_low AND plaus_high),
converted AS (
  SELECT p.*, coalesce(p.number * k.factor, c.v) AS value_si, k.factor IS NULL AND c.v IS NOT NULL AS unit_inferred
  FROM parsed p LEFT JOIN units k ON k.marker = p.marker AND k.unit_clean = p.unit_clean LEFT JOIN (SELECT * FROM candidates WHERE rn = 1) c ON c.rid = p.rid),
pop_stats AS (
  SELECT marker, avg(x) AS log_mean, stddev_samp(x) AS log_sd, quantile_cont(x, 0.25) AS log_q1, quantile_cont(x, 0.75) AS log_q3, count(*) AS n
  FROM (SELECT marker, ln(greatest(value_si, 1e-6)) AS x FROM converted WHERE value_si BETWEEN plaus_low AND plaus_high) GROUP BY marker),
flagged1 AS (
  SELECT c.*, s.log_mean, s.log_sd, s.log_q1, s.log_q3, value_si IS NULL AS unparseable, NOT (value_si BETWEEN plaus_low AND plaus_high) AS implausible,
    CASE WHEN value_si IS NULL THEN NULL WHEN log_sd = 0 THEN 0 ELSE (ln(greatest(value_si, 1e-6)) - log_mean) / log_sd END AS z_log,
    CASE WHEN value_si IS NOT NULL THEN ln(greatest(value_si, 1e-6)) < log_q1 - 3 * (log_q3 - log_q1) OR ln(greatest(value_si, 1e-6)) > log_q3 + 3 * (log_q3 - log_q1) END AS iqr_outlier
  FROM converted c LEFT JOIN pop_stats s USING (marker)),
flagged AS (
  SELECT *, (implausible OR abs(z_log) > 4) AND (value_si / 10 BETWEEN ref_low AND ref_high OR value_si / 100 BETWEEN ref_low AND ref_high OR value_si * 10 BETWEEN ref_low AND ref_high) AS decimal_misread_suspect,
    row_number() OVER (PARTITION BY report_id, marker ORDER BY implausible NULLS LAST, unparseable, label_confidence DESC, unit_inferred, raw_value NULLS FIRST, raw_unit NULLS FIRST, raw_label NULLS FIRST) AS dup_rank
  FROM flagged1),
silver AS (SELECT * FROM flagged WHERE dup_rank = 1 AND NOT unparseable),
forms AS ({FORMS_SQL}),
proms AS (
  SELECT report_id, patient_id, CASE WHEN sev BETWEEN 1 AND 10 THEN sev END AS fatigue_severity,
    CASE WHEN f IN ('never', 'not at all') THEN 'never' WHEN f IN ('rarely', 'seldom') THEN 'rarely' WHEN f IN ('sometimes', 'occasionally') THEN 'sometimes' WHEN f IN ('often', 'frequently', 'most days') THEN 'often' WHEN f IN ('always', 'constantly', 'every day') THEN 'always' END AS brain_fog_frequency,
    CASE WHEN h IN ('none', 'no') THEN 'none' WHEN h IN ('mild', 'a little') THEN 'mild' WHEN h = 'moderate' THEN 'moderate' WHEN h IN ('severe', 'a lot') THEN 'severe' END AS hair_loss
  FROM (SELECT *, TRY_CAST(regexp_extract(fatigue, '([0-9]+)', 1) AS INT) AS sev, lower(trim(brain_fog)) AS f, lower(trim(hair_loss)) AS h FROM forms)),
patients AS ({PATIENTS_SQL}),
report_wide AS (
  SELECT report_id, patient_id, min(lab_provider) AS lab_provider, CAST(min(collected_at) AS DATE) AS collected_at,
    {", ".join(f"max(CASE WHEN marker = '{m}' AND NOT implausible THEN value_si END) AS {m}" for m in MARKERS)},
    {", ".join(f"coalesce(max(CASE WHEN marker = '{m}' THEN CAST(unit_inferred OR decimal_misread_suspect OR label_confidence < 0.9 AS INT) END), 0) AS {m}_low_quality" for m in MARKERS)}
  FROM silver GROUP BY report_id, patient_id),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY collected_at DESC, report_id DESC) AS rk, count(*) OVER (PARTITION BY patient_id) AS n_reports FROM report_wide) WHERE rk = 1),
gold AS (SELECT l.*, p.sex, CAST(year(l.collected_at) - p.birth_year AS INT) AS age, a.fatigue_severity, a.brain_fog_frequency, a.hair_loss FROM latest l JOIN patients p USING (patient_id) LEFT JOIN proms a USING (report_id))
"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, dates as text: what the comparison of two engines can bear."""
    from pyspark.sql import functions as F

    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c).cast("string").alias(c) if t in ("date", "timestamp") else F.col(c) for c, t in df.dtypes])
