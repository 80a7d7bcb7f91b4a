"""Cohorts, targets, imputation and derived features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scalar as S
from . import stats

EPS = 1e-3
MICRO = ("VITD", "B12", "FERRITIN", "MG", "ZINC")
REFERENCE_LOW = {m[0]: m[6] for m in catalog.META}


def eligible(gold: DataFrame, markers: tuple[str, ...] = catalog.MARKERS, least: int = 7, answers: tuple[str, ...] = ("fatigue_severity", "brain_fog_frequency", "hair_loss")) -> DataFrame:
    """Rows with enough markers and all answers."""
    present = sum((F.col(m).isNotNull().cast("int") for m in markers), F.lit(0))
    condition = present >= least
    for a in answers:
        condition &= F.col(a).isNotNull()
    return gold.where(condition)


def targets() -> dict[str, Column]:
    """B9."""
    return {"fatigue": (F.col("fatigue_severity") >= 7).cast("int"), "brain_fog": F.col("brain_fog_frequency").isin("often", "always").cast("int"), "hair_loss_target": F.col("hair_loss").isin("moderate", "severe").cast("int")}


def ordinal_code(column: Column, levels: tuple[str, ...]) -> Column:
    """A level's place from 0, null for other text."""
    place = F.array_position(F.array(*map(F.lit, levels)), column)
    return F.when(place > 0, (place - 1).cast("int"))


def validated(answers: DataFrame) -> DataFrame:
    """``reasons`` lists what is wrong with a row of answers; empty for valid ones."""
    checks = [
        (F.col("fatigue_severity").isNull() | ~F.col("fatigue_severity").between(1, 10), "fatigue_severity"),
        (F.col("brain_fog_frequency").isNull() | ~F.col("brain_fog_frequency").isin(*catalog.FOG_LEVELS), "brain_fog_frequency"),
        (F.col("hair_loss").isNull() | ~F.col("hair_loss").isin(*catalog.HAIR_LEVELS), "hair_loss"),
    ]
    return answers.withColumn("reasons", F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda x: x.isNotNull()))


def fit_imputer(rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Exact medians per group and, under null keys, of all rows; no task holds a group's values (``stats.medians``).  Without rows all is null.

    A group whose keys are all null is not told from the whole in the result; ``impute`` gives rows with a null key the whole's median.
    """
    found = stats.medians(rows, [tuple(keys), ()], columns)
    whole = found.where("grouping = 1").drop("grouping")
    empty = rows.sparkSession.range(1).select(*[F.lit(None).cast(t).alias(k) for k, t in whole.dtypes])
    return found.where("grouping = 0").where(" or ".join(f"{k} is not null" for k in keys)).drop("grouping").unionByName(whole.unionByName(empty).limit(1))


def impute(rows: DataFrame, medians: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """A missing value becomes its group's median, else the global one; ``<column>_missing`` says where.

    The medians have a row per group (sex and age band), so they are broadcast.
    """
    group = F.broadcast(medians.where(" and ".join(f"{k} is not null" for k in keys)).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_g_{c}") for c in columns]))
    whole = F.broadcast(medians.where(" and ".join(f"{k} is null" for k in keys)).select(*[F.col(c).alias(f"_a_{c}") for c in columns]))
    condition = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    joined = rows.join(group, condition, "left").crossJoin(whole)  # the global medians are one row
    filled = {c: F.coalesce(c, f"_g_{c}", f"_a_{c}") for c in columns}
    missing = {f"{c}_missing": F.col(c).isNull().cast("int") for c in columns}
    return joined.withColumns(missing).withColumns(filled).select(*rows.columns, *missing)


def derived(female: Column, age: Column) -> dict[str, Column]:
    """Features of one patient from its nine markers; the same expressions serve batches and streams."""
    ln = {m: F.log(F.greatest(F.col(m), F.lit(EPS))) for m in catalog.LOG_MARKERS}
    deficit = sum(((F.col(m) < REFERENCE_LOW[m]).cast("int") for m in MICRO), F.lit(0))
    return {f"log_{m}": e for m, e in ln.items()} | {
        "ft3_ft4_ratio": F.col("FT3") / F.greatest(F.col("FT4"), F.lit(EPS)),
        "log_ferritin_to_tsh": ln["FERRITIN"] - ln["TSH"],
        "log_tsh_x_ft4": ln["TSH"] + ln["FT4"],
        "low_iron_x_high_tsh": F.when(F.col("FERRITIN") < 30, F.greatest(ln["TSH"] - F.log(F.lit(2.5)), F.lit(0.0))).otherwise(0.0),
        "log_tpo_x_log_tsh": ln["TPOAB"] * ln["TSH"],
        "log_b12_x_log_vitd": ln["B12"] * ln["VITD"],
        "micronutrient_deficit_count": deficit,
        "sex_female": female.cast("int"),
        "age": age,
    }


def features(rows: DataFrame, medians: DataFrame) -> DataFrame:
    """J1 and J2 on gold rows (columns sex, age and the markers)."""
    banded = rows.withColumn("band", S.age_band(F.col("age")))
    filled = impute(banded, medians, ("sex", "band"), catalog.MARKERS)
    return filled.withColumns(derived(F.coalesce(F.col("sex") == "F", F.lit(True)), F.coalesce("age", F.lit(45))))


def standardised(rows: DataFrame, columns: tuple[str, ...], logs: tuple[str, ...] = ()) -> DataFrame:
    """Columns minus their mean over their population deviation, those of ``logs`` as logarithms; a constant one becomes 0, null stays."""
    value = {c: F.when(F.col(c).isNotNull(), F.log(F.greatest(F.col(c), F.lit(EPS)))) if c in logs else F.col(c) for c in columns}
    stats = rows.agg(*[f(e).alias(f"_{p}_{c}") for c, e in value.items() for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = rows.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: F.when((F.col(f"_s_{c}") == 0) & e.isNotNull(), 0.0).otherwise((e - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c, e in value.items()}).select(*rows.columns)


#: The markers that each derived feature comes from; other columns are their own.
SOURCES = {f"log_{m}": (m,) for m in catalog.LOG_MARKERS} | {
    "ft3_ft4_ratio": ("FT3", "FT4"), "log_ferritin_to_tsh": ("FERRITIN", "TSH"), "log_tsh_x_ft4": ("TSH", "FT4"), "low_iron_x_high_tsh": ("FERRITIN", "TSH"),
    "log_tpo_x_log_tsh": ("TPOAB", "TSH"), "log_b12_x_log_vitd": ("B12", "VITD"), "micronutrient_deficit_count": MICRO, "sex_female": ("sex",),
}
#: The columns that models see.
MODEL_COLUMNS = (*catalog.MARKERS, *[f"{m}_missing" for m in catalog.MARKERS], *SOURCES, "age")
