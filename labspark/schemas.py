"""Schemas of the lake's zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

LAB = "report_id string, patient_id string, lab_provider string, collected_at string, raw_label string, raw_value string, raw_unit string, raw_reference string, flag string"
INTAKE = "form_id string, report_id string, patient_id string, submitted_at string, answers struct<fatigue: string, brain_fog: string, hair_loss: string>"
PATIENTS = "patient_id string, sex string, birth_year int, site string"
CATALOG = "version string, markers array<struct<marker: string, loinc: string, panel: string, unit: string, aliases: array<string>, units: map<string, double>, reference: struct<low: double, high: double>, reference_by_sex: map<string, struct<low: double, high: double>>, plausible: struct<low: double, high: double>, escalation: array<struct<op: string, bound: double, level: string, reason: string>>>>"
SILVER = "report_id string, patient_id string, lab_provider string, collected_at date, marker string, loinc string, panel string, value_si double, unit_si string, qualifier string, label_confidence double, match_method string, unit_inferred boolean, implausible boolean, decimal_misread_suspect boolean, z_log double, iqr_outlier boolean"


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns and types of a zone; a missing column raises."""
    wanted = T.StructType.fromDDL(ddl)
    lost = [f.name for f in wanted if f.name not in df.columns]
    if lost:
        raise ValueError(f"columns missing: {lost}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in wanted])
