"""The lake: bronze rows to silver measurements, audits, questionnaires and gold patient features (I15 and its parts)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scalar as S
from ..sources.io import durable
from . import normalize, quality

LAB_COLUMNS = ("report_id", "patient_id", "lab_provider", "collected_at", "raw_label", "raw_value", "raw_unit", "raw_reference", "flag")


def bronze(*sources: DataFrame) -> DataFrame:
    """B1, G1: sources conformed to one list of string columns; a column that a source lacks is null."""
    def conform(df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in LAB_COLUMNS])

    out = conform(sources[0])
    for s in sources[1:]:
        out = out.unionByName(conform(s))
    return out


def converted(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Mapped rows with numbers in the catalog's units (C1, C2, H4, H6, I3).  Unmapped rows are left out; see ``unmapped``."""
    names = labels if labels is not None else normalize.match_labels(rows)
    names = names.select(F.col("label").alias("_label"), "marker", F.col("confidence").alias("label_confidence"), "match_method")
    mapped = rows.join(names, F.coalesce("raw_label", F.lit("")) == F.col("_label")).drop("_label")
    mapped = normalize.with_catalog(mapped).withColumns({"qualifier": S.qualifier(F.col("raw_value")), "number": S.lenient_number(F.col("raw_value")), "unit_clean": S.clean_unit(F.col("raw_unit"))})
    made = normalize.convert_batch(F.col("number"), F.col("unit_clean"), F.col("units"), F.col("ref_low"), F.col("ref_high"), F.col("plaus_low"), F.col("plaus_high"))
    return mapped.withColumn("_c", made).withColumns({"value_si": F.col("_c.value_si"), "unit_inferred": F.col("_c.unit_inferred"), "collected_at": F.col("collected_at").try_cast("date")}).drop("_c", "units")


def plausible() -> Column:
    return F.col("value_si").between(F.col("plaus_low"), F.col("plaus_high"))


def flagged(rows: DataFrame, stats: DataFrame, compat: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Flags and duplicate rank.  ``compat`` lets an unreadable value count as a far outlier, as a floor without
    a null guard does.  ``ties``: columns whose rising order decides between rows that the rank's own order leaves equal."""
    value = F.col("value_si")
    floor = F.greatest(value, F.lit(1e-6)) if compat else value
    rows = rows.join(F.broadcast(stats), "marker", "left")  # a row per marker
    z = quality.z_log(floor, F.col("log_mean"), F.col("log_sd"))
    rows = rows.withColumns({"unparseable": value.isNull(), "implausible": ~plausible(), "z_log": z, "iqr_outlier": quality.beyond_fences(floor, F.col("log_q1"), F.col("log_q3"))})
    rows = rows.withColumn("decimal_misread_suspect", quality.misread_suspect(value, F.col("implausible"), F.col("z_log"), F.col("ref_low"), F.col("ref_high")))
    order = [F.col("implausible").asc_nulls_last(), F.col("unparseable").asc(), F.desc("label_confidence"), F.col("unit_inferred").asc(), "raw_value", "raw_unit", "raw_label", *ties]
    return rows.withColumn("dup_rank", F.row_number().over(Window.partitionBy("report_id", "marker").orderBy(*order)))


def silver(rows: DataFrame) -> DataFrame:
    """The best readable row of each report and marker."""
    return rows.where("dup_rank = 1 and not unparseable").select("report_id", "patient_id", "lab_provider", "collected_at", "marker", "loinc", "panel", "value_si", F.col("unit").alias("unit_si"), "qualifier", "label_confidence", "match_method", "unit_inferred", "implausible", "decimal_misread_suspect", "z_log", "iqr_outlier")


def audit(rows: DataFrame, key: str = "lab_provider") -> DataFrame:
    """Ten conditional counts per source."""
    return rows.groupBy(key).agg(
        F.count("*").alias("rows_total"), F.count_if("unparseable").alias("unparseable"), F.count_if("unit_inferred").alias("units_inferred"), F.count_if("implausible").alias("implausible"),
        F.count_if("decimal_misread_suspect").alias("decimal_misread_suspects"), F.count_if(F.abs("z_log") > 4).alias("zscore_outliers"), F.count_if("iqr_outlier").alias("iqr_outliers"), F.count_if(F.col("dup_rank") > 1).alias("duplicates"),
        F.count_if(F.col("match_method") == "fuzzy").alias("fuzzy_labels"), F.count_if(F.col("qualifier").isNotNull()).alias("qualified"),
    )


def unmapped(rows: DataFrame, labels: DataFrame, key: str = "lab_provider") -> DataFrame:
    """D3: rows without a marker per source; rows without a label count."""
    names = labels.select(F.col("label").alias("_label"))
    return rows.join(names, F.coalesce("raw_label", F.lit("")) == F.col("_label"), "left_anti").groupBy(key).agg(F.count("*").alias("unmapped_rows"))


def full_audit(audited: DataFrame, lost: DataFrame, key: str = "lab_provider") -> DataFrame:
    """Both audits, 0 where a source lost nothing."""
    return audited.join(lost, key, "left").fillna({"unmapped_rows": 0})


def synonyms(column: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """A spelling's level, null for any other text."""
    text, out = F.lower(F.trim(column)), None
    for level, spellings in table.items():
        out = F.when(text.isin(*spellings), level) if out is None else out.when(text.isin(*spellings), level)
    return out


def questionnaires(forms: DataFrame) -> DataFrame:
    """Silver answers from intake forms (B2, B5, H7); a severity outside 1 to 10 is null."""
    severity = S.first_integer(F.col("answers.fatigue"))
    return forms.select("report_id", "patient_id", F.when(severity.between(1, 10), severity).alias("fatigue_severity"), synonyms(F.col("answers.brain_fog"), catalog.FOG_SYNONYMS).alias("brain_fog_frequency"), synonyms(F.col("answers.hair_loss"), catalog.HAIR_SYNONYMS).alias("hair_loss"))


def report_wide(rows: DataFrame, markers: tuple[str, ...] = catalog.MARKERS) -> DataFrame:
    """A row per report: each marker's largest plausible value and whether it is of low quality.

    The marker list is given, so the pivot is one aggregation without a pass to find its columns.
    """
    low = F.col("unit_inferred") | F.col("decimal_misread_suspect") | (F.col("label_confidence") < 0.9)
    values = [F.max(F.when((F.col("marker") == m) & ~F.col("implausible"), F.col("value_si"))).alias(m) for m in markers]
    doubts = [F.coalesce(F.max(F.when(F.col("marker") == m, low.cast("int"))), F.lit(0)).alias(f"{m}_low_quality") for m in markers]
    return rows.groupBy("report_id", "patient_id").agg(F.min("lab_provider").alias("lab_provider"), F.min("collected_at").alias("collected_at"), *values, *doubts)


def latest(reports: DataFrame, patient: str = "patient_id") -> DataFrame:
    """The latest report of each patient, with the number of all of them."""
    own = Window.partitionBy(patient)
    ranked = reports.withColumns({"rk": F.row_number().over(own.orderBy(F.desc("collected_at"), F.desc("report_id"))), "n_reports": F.count("*").over(own)})
    return ranked.where("rk = 1")


def gold(silver_rows: DataFrame, patients: DataFrame, answers: DataFrame, markers: tuple[str, ...] = catalog.MARKERS) -> DataFrame:
    """One row per patient with demographics and answers."""
    wide = latest(report_wide(silver_rows, markers))
    joined = wide.join(patients.select("patient_id", "sex", "birth_year"), "patient_id").join(answers.drop("patient_id"), "report_id", "left")
    return joined.withColumn("age", S.age_at(F.col("collected_at"), F.col("birth_year"))).drop("birth_year")


@dataclass
class Lake:
    silver: DataFrame
    answers: DataFrame
    gold: DataFrame
    audit: DataFrame
    stats: DataFrame
    labels: DataFrame


def run(rows: DataFrame, forms: DataFrame, patients: DataFrame, compat: bool = False, ties: tuple[str, ...] = ()) -> Lake:
    """The whole lake.  Labels and converted rows, which statistics, flags and audits share, are written once."""
    labels = durable(normalize.match_labels(rows))
    base = durable(converted(rows, labels))
    stats = quality.population_stats(base, where=plausible())
    marked = flagged(base, stats, compat, ties)
    kept, answers = silver(marked), questionnaires(forms)
    return Lake(kept, answers, gold(kept, patients, answers), full_audit(audit(marked), unmapped(rows, labels)), stats, labels)


def summary(run_: Lake) -> DataFrame:
    """Totals of the run in one row."""
    totals = run_.audit.agg(*[F.sum(c).alias(c) for c in run_.audit.columns if c != "lab_provider"])
    mapped = run_.labels.agg(F.count("*").alias("labels_mapped"), F.count_if(F.col("match_method") == "fuzzy").alias("labels_fuzzy"))
    return totals.crossJoin(mapped)  # one row each
