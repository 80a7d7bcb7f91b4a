"""The marker catalog and its dimension tables: a few dozen rows each, broadcast in every join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0.0"
PIPELINE = "labspark-1"
LABEL = "synthetic"

# Marker keys in feature order.
MARKERS = ("TSH", "FT3", "FT4", "TPOAB", "VITD", "B12", "FERRITIN", "MG", "ZINC")
LOG_MARKERS = MARKERS[:7]

# Key, code, panel, display name, long name, unit, reference low and high, plausible low and high.
META = (
    ("TSH", "3016-3", "thyroid", "TSH", "Thyroid-stimulating hormone", "mIU/L", 0.4, 4.0, 0.001, 200.0),
    ("FT4", "3024-7", "thyroid", "Free T4", "Free thyroxine", "pmol/L", 10.0, 23.0, 1.0, 155.0),
    ("FT3", "3051-0", "thyroid", "Free T3", "Free triiodothyronine", "pmol/L", 3.1, 6.8, 0.5, 50.0),
    ("TPOAB", "8099-4", "thyroid", "Anti-TPO", "Thyroid peroxidase antibodies", "IU/mL", 0.0, 35.0, 0.0, 10000.0),
    ("VITD", "62292-8", "micronutrient", "Vitamin D (25-OH)", "25-hydroxyvitamin D", "nmol/L", 50.0, 125.0, 2.5, 625.0),
    ("B12", "2132-9", "micronutrient", "Vitamin B12", "Cobalamin (vitamin B12)", "pmol/L", 148.0, 664.0, 30.0, 2000.0),
    ("FERRITIN", "2276-4", "micronutrient", "Ferritin", "Serum ferritin", "ug/L", 15.0, 300.0, 1.0, 10000.0),
    ("MG", "19123-9", "micronutrient", "Magnesium", "Serum magnesium", "mmol/L", 0.7, 1.0, 0.1, 4.0),
    ("ZINC", "5763-8", "micronutrient", "Zinc", "Serum zinc", "umol/L", 9.2, 18.4, 1.0, 60.0),
)

# Units of a marker, cleaned, with the factor to the catalog's unit.
UNITS = (
    ("TSH", "miu/l", 1.0), ("TSH", "uiu/ml", 1.0), ("TSH", "mu/l", 1.0), ("TSH", "uu/ml", 1.0),
    ("FT4", "pmol/l", 1.0), ("FT4", "ng/dl", 12.87), ("FT4", "ng/l", 1.287), ("FT4", "pg/ml", 1.287),
    ("FT3", "pmol/l", 1.0), ("FT3", "pg/ml", 1.536), ("FT3", "pg/dl", 0.01536), ("FT3", "ng/l", 1.536), ("FT3", "ng/dl", 15.36),
    ("TPOAB", "iu/ml", 1.0), ("TPOAB", "kiu/l", 1.0), ("TPOAB", "u/ml", 1.0), ("TPOAB", "ku/l", 1.0),
    ("VITD", "nmol/l", 1.0), ("VITD", "ng/ml", 2.496), ("VITD", "ug/l", 2.496),
    ("B12", "pmol/l", 1.0), ("B12", "pg/ml", 0.7378), ("B12", "ng/l", 0.7378),
    ("FERRITIN", "ug/l", 1.0), ("FERRITIN", "ng/ml", 1.0), ("FERRITIN", "pmol/l", 0.445),
    ("MG", "mmol/l", 1.0), ("MG", "mg/dl", 0.4114), ("MG", "meq/l", 0.5), ("MG", "mg/l", 0.04114),
    ("ZINC", "umol/l", 1.0), ("ZINC", "ug/dl", 0.153), ("ZINC", "mg/l", 15.3), ("ZINC", "ug/l", 0.0153),
)

# Other names of a marker.
ALIASES = {
    "TSH": ("tsh", "thyroid stimulating hormone", "thyroid-stimulating hormone", "thyrotropin", "thyrotrophin", "tsh 3rd generation", "tsh third generation", "ultrasensitive tsh", "us tsh", "s tsh", "serum tsh", "tsh ultrasensitive", "tsh serum"),
    "FT4": ("free t4", "ft4", "f t4", "free thyroxine", "thyroxine free", "t4 free", "fti4", "free thyroxine t4", "thyroxine t4 free", "t4 free direct", "free t4 direct"),
    "FT3": ("free t3", "ft3", "f t3", "free triiodothyronine", "triiodothyronine free", "t3 free", "free triiodothyronine t3", "triiodothyronine t3 free", "free t3 direct"),
    "TPOAB": ("anti tpo", "anti-tpo", "tpo ab", "tpoab", "tpo antibody", "tpo antibodies", "thyroid peroxidase antibodies", "thyroid peroxidase antibody", "anti thyroid peroxidase", "anti-thyroid peroxidase", "antithyroperoxidase", "thyroperoxidase ab", "anti tpo antibodies", "thyroid peroxidase ab", "atpo"),
    "VITD": ("vitamin d", "vit d", "25 oh vitamin d", "25-oh vitamin d", "25 hydroxyvitamin d", "25-hydroxyvitamin d", "25 hydroxy vitamin d", "25 oh d", "25ohd", "25 oh vit d", "vitamin d 25 hydroxy", "vitamin d 25 oh", "vitamin d total", "total vitamin d", "calcidiol", "vitamin d3 25 oh", "25 hydroxy vitamin d total", "vit d 25 oh", "vitamin d 25 hydroxy total"),
    "B12": ("vitamin b12", "vit b12", "b12", "cobalamin", "cyanocobalamin", "vitamin b 12", "serum b12", "b12 serum", "vitamin b12 serum", "cobalamin vitamin b12", "vitb12"),
    "FERRITIN": ("ferritin", "serum ferritin", "s ferritin", "ferritin serum", "plasma ferritin", "ferritin level"),
    "MG": ("magnesium", "serum magnesium", "magnesium serum", "s magnesium", "plasma magnesium", "mg serum", "serum mg", "magnesium level"),
    "ZINC": ("zinc", "serum zinc", "zinc serum", "plasma zinc", "zn", "s zinc", "zinc level", "zinc plasma"),
}

# References of one sex.
SEX_REFERENCES = (("FERRITIN", "F", 15.0, 150.0), ("FERRITIN", "M", 30.0, 400.0))

# Marker, operator, bound, level, reason.
ESCALATION = (
    ("TSH", "<", 0.1, "priority", "Suppressed TSH"), ("TSH", ">", 10.0, "priority", "Markedly raised TSH"), ("TSH", ">", 50.0, "urgent", "Very high TSH"),
    ("FT4", "<", 5.0, "urgent", "Very low free T4"), ("FT4", ">", 50.0, "urgent", "Very high free T4"), ("FT3", ">", 20.0, "urgent", "Very high free T3"),
    ("TPOAB", ">", 500.0, "priority", "Strongly positive thyroid antibodies"), ("VITD", "<", 30.0, "priority", "Vitamin D in the deficient range"),
    ("VITD", ">", 375.0, "urgent", "Vitamin D in a potentially toxic range"), ("B12", "<", 111.0, "priority", "Vitamin B12 clearly low"),
    ("FERRITIN", "<", 10.0, "priority", "Very low iron stores"), ("FERRITIN", ">", 1000.0, "urgent", "Very high ferritin"),
    ("MG", "<", 0.5, "urgent", "Very low magnesium"), ("MG", ">", 1.5, "urgent", "High magnesium"), ("ZINC", "<", 7.6, "priority", "Low zinc"),
)

# Ordered levels.
LEVELS = ("routine", "priority", "urgent", "emergency")
FOG_LEVELS = ("never", "rarely", "sometimes", "often", "always")
HAIR_LEVELS = ("none", "mild", "moderate", "severe")
# Spellings of answers.
FOG_SYNONYMS = {"never": ("never", "not at all"), "rarely": ("rarely", "seldom"), "sometimes": ("sometimes", "occasionally"), "often": ("often", "frequently", "most days"), "always": ("always", "constantly", "every day")}
HAIR_SYNONYMS = {"none": ("none", "no"), "mild": ("mild", "a little"), "moderate": ("moderate",), "severe": ("severe", "a lot")}


def clean_label(column: Column) -> Column:
    """Lower case, Greek mu as u, other than letters and digits as single spaces (H3)."""
    return F.trim(F.regexp_replace(F.translate(F.lower(column), "µμ", "uu"), "[^a-z0-9]+", " "))


def meta(spark: SparkSession) -> DataFrame:
    """One row per marker."""
    return spark.createDataFrame(META, "marker string, loinc string, panel string, display string, long_name string, unit string, ref_low double, ref_high double, plaus_low double, plaus_high double")


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNITS, "marker string, unit_clean string, factor double")


def unit_arrays(spark: SparkSession) -> DataFrame:
    """One row per marker with all its units in an array, so that a row can weigh them without a join per unit."""
    return units(spark).groupBy("marker").agg(F.sort_array(F.collect_list(F.struct("factor", "unit_clean"))).alias("units"))


def aliases(spark: SparkSession) -> DataFrame:
    """alias (cleaned), marker: aliases, display and long names; of equal ones the last marker in catalog order wins."""
    rows = [(a, k, i) for i, (k, _, _, display, long, *_) in enumerate(META) for a in (*ALIASES[k], display, long)]
    named = spark.createDataFrame(rows, "alias string, marker string, place int").withColumn("alias", clean_label(F.col("alias")))
    return named.groupBy("alias").agg(F.max_by("marker", "place").alias("marker"))


def sex_references(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEX_REFERENCES, "marker string, sex string, sex_low double, sex_high double")


def escalation_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ESCALATION, "marker string, op string, bound double, level string, reason string")


def from_document(catalog: DataFrame) -> dict[str, DataFrame]:
    """Dimension tables from a catalog document read as one row with an array ``markers`` (A14): meta, units, aliases,
    references by sex and escalation rules."""
    m = catalog.select(F.explode("markers").alias("m")).select("m.*")
    return {
        "meta": m.select("marker", "loinc", "panel", "unit", F.col("reference.low").alias("ref_low"), F.col("reference.high").alias("ref_high"), F.col("plausible.low").alias("plaus_low"), F.col("plausible.high").alias("plaus_high")),
        "units": m.select("marker", F.explode("units").alias("unit_clean", "factor")),
        "aliases": m.select("marker", F.explode("aliases").alias("alias")),
        "sex_references": m.select("marker", F.explode("reference_by_sex").alias("sex", "r")).select("marker", "sex", F.col("r.low").alias("sex_low"), F.col("r.high").alias("sex_high")),
        "escalation": m.select("marker", F.explode("escalation").alias("e")).select("marker", "e.*"),
    }


def sql_values(rows: tuple, names: str) -> str:
    """Rows as a VALUES relation that both engines read alike."""
    show = lambda v: f"CAST({v} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") AS t({names}))"
