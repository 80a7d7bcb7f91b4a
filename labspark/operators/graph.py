"""Knowledge-graph tables and evidence chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog

# Evidence levels from strongest to weakest, and those that count as verified.
EVIDENCE = ("guideline", "authoritative_review", "observational", "expert_consensus", "synthetic_derived", "unverified")
VERIFIED = EVIDENCE[:4]

# Threshold id, marker, operator, bound.
THRESHOLDS = (
    ("ferritin_lt_15", "FERRITIN", "<", 15.0), ("ferritin_lt_30", "FERRITIN", "<", 30.0), ("tsh_gt_4", "TSH", ">", 4.0), ("tsh_gt_10", "TSH", ">", 10.0), ("tsh_lt_0_4", "TSH", "<", 0.4),
    ("ft4_lt_10", "FT4", "<", 10.0), ("ft4_gt_23", "FT4", ">", 23.0), ("ft3_lt_3_1", "FT3", "<", 3.1), ("tpo_gt_35", "TPOAB", ">", 35.0), ("vitd_lt_30", "VITD", "<", 30.0), ("vitd_lt_50", "VITD", "<", 50.0),
    ("b12_lt_148", "B12", "<", 148.0), ("mg_lt_0_7", "MG", "<", 0.7), ("zinc_lt_9_2", "ZINC", "<", 9.2),
)
# Threshold, relation, condition, source, evidence level, required marker and what is required of it.
INDICATIONS = (
    ("ferritin_lt_15", "INDICATES", "iron_deficiency", "who_ferritin_2020", "guideline", "", "", 0.0),
    ("ferritin_lt_30", "INDICATES", "iron_deficiency", "who_ferritin_2020", "expert_consensus", "", "", 0.0),
    ("ferritin_lt_30", "AMPLIFIES", "subclinical_hypothyroidism", "curated_hypothesis", "unverified", "", "", 0.0),
    ("tsh_gt_4", "INDICATES", "subclinical_hypothyroidism", "ata_aace_2012", "guideline", "FT4", "within", 0.0),
    ("tsh_gt_10", "INDICATES", "hypothyroidism", "ata_aace_2012", "guideline", "", "", 0.0),
    ("ft4_lt_10", "INDICATES", "hypothyroidism", "ata_aace_2012", "guideline", "TSH", "above", 4.0),
    ("tsh_lt_0_4", "INDICATES", "hyperthyroidism", "ata_patient", "authoritative_review", "", "", 0.0),
    ("ft4_gt_23", "INDICATES", "hyperthyroidism", "ata_patient", "authoritative_review", "", "", 0.0),
    ("tpo_gt_35", "INDICATES", "autoimmune_thyroiditis", "ata_aace_2012", "guideline", "", "", 0.0),
    ("tpo_gt_35", "AMPLIFIES", "subclinical_hypothyroidism", "ata_aace_2012", "guideline", "", "", 0.0),
    ("vitd_lt_30", "INDICATES", "vitamin_d_deficiency", "nih_ods_vitd", "authoritative_review", "", "", 0.0),
    ("vitd_lt_50", "INDICATES", "vitamin_d_deficiency", "nih_ods_vitd", "authoritative_review", "", "", 0.0),
    ("b12_lt_148", "INDICATES", "b12_deficiency", "nih_ods_b12", "authoritative_review", "", "", 0.0),
    ("mg_lt_0_7", "INDICATES", "hypomagnesemia", "nih_ods_mg", "authoritative_review", "", "", 0.0),
    ("zinc_lt_9_2", "INDICATES", "zinc_deficiency", "nih_ods_zinc", "unverified", "", "", 0.0),
    ("ft3_lt_3_1", "AMPLIFIES", "hypothyroidism", "curated_hypothesis", "unverified", "", "", 0.0),
)
# Condition, symptom, source, evidence level.
SYMPTOMS = (
    ("iron_deficiency", "fatigue", "who_ferritin_2020", "authoritative_review"), ("iron_deficiency", "hair_loss", "curated_hypothesis", "unverified"), ("iron_deficiency", "brain_fog", "curated_hypothesis", "unverified"),
    ("hypothyroidism", "fatigue", "ata_patient", "authoritative_review"), ("hypothyroidism", "brain_fog", "ata_patient", "authoritative_review"), ("hypothyroidism", "hair_loss", "ata_patient", "authoritative_review"),
    ("subclinical_hypothyroidism", "fatigue", "ata_aace_2012", "observational"), ("subclinical_hypothyroidism", "brain_fog", "curated_hypothesis", "unverified"), ("hyperthyroidism", "fatigue", "ata_patient", "authoritative_review"),
    ("hyperthyroidism", "hair_loss", "ata_patient", "authoritative_review"), ("autoimmune_thyroiditis", "fatigue", "curated_hypothesis", "unverified"), ("vitamin_d_deficiency", "fatigue", "curated_hypothesis", "unverified"),
    ("b12_deficiency", "fatigue", "nih_ods_b12", "authoritative_review"), ("b12_deficiency", "brain_fog", "nih_ods_b12", "authoritative_review"), ("hypomagnesemia", "fatigue", "nih_ods_mg", "authoritative_review"), ("zinc_deficiency", "hair_loss", "nih_ods_zinc", "authoritative_review"),
)
# Source id, title.
SOURCES = (
    ("who_ferritin_2020", "WHO guideline on use of ferritin concentrations to assess iron status"), ("nih_ods_vitd", "Vitamin D - Fact Sheet for Health Professionals"), ("nih_ods_b12", "Vitamin B12 - Fact Sheet for Health Professionals"),
    ("nih_ods_mg", "Magnesium - Fact Sheet for Health Professionals"), ("nih_ods_zinc", "Zinc - Fact Sheet for Health Professionals"), ("ata_aace_2012", "Clinical Practice Guidelines for Hypothyroidism in Adults"), ("ata_patient", "Hypothyroidism patient information"),
)


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THRESHOLDS, "threshold string, marker string, op string, bound double")


def indications(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(INDICATIONS)]
    return spark.createDataFrame(rows, "edge_no int, threshold string, relation string, condition string, source string, evidence_level string, required string, requirement string, required_bound double")


def symptom_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYMPTOMS, "condition string, symptom string, source string, evidence_level string")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source string, source_title string")


def nodes(spark: SparkSession) -> DataFrame:
    """Id and label of every node of the seed."""
    made = [("Biomarker", m) for m in catalog.MARKERS] + [("Code", m[1]) for m in catalog.META] + [("FunctionalRange", t[0]) for t in THRESHOLDS] + [("Source", s[0]) for s in SOURCES]
    made += [("Condition", c) for c in dict.fromkeys(i[2] for i in INDICATIONS)] + [("Symptom", s) for s in dict.fromkeys(s[1] for s in SYMPTOMS)]
    return spark.createDataFrame(made, "label string, id string")


def edges(spark: SparkSession) -> DataFrame:
    made = [(m[0], "CODED_AS", m[1], None, None) for m in catalog.META] + [(t[1], "HAS_RANGE", t[0], None, None) for t in THRESHOLDS]
    made += [(i[0], i[1], i[2], i[3], i[4]) for i in INDICATIONS] + [(s[0], "PRESENTS_WITH", s[1], s[2], s[3]) for s in SYMPTOMS]
    return spark.createDataFrame(made, "from_id string, type string, to_id string, source string, evidence_level string")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those with equal keys; doing it twice changes nothing more."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes.dropDuplicates(keys), allowMissingColumns=True)


def fires(value: Column, op: Column, bound: Column) -> Column:
    """The theta predicate of C10 and C11."""
    return F.when(op == "<", value < bound).when(op == ">", value > bound).otherwise(False)


def triggered(values: DataFrame, rules: DataFrame, marker: str = "marker", value: str = "value") -> DataFrame:
    """Values joined with the rules that they trigger; an equality on the marker carries the join, and the rules (some dozen
    rows) are broadcast."""
    return values.join(F.broadcast(rules), marker).where(fires(F.col(value), F.col("op"), F.col("bound")))


def evidence_rank(level: Column) -> Column:
    """1 for the strongest level."""
    return F.array_position(F.array(*map(F.lit, EVIDENCE)), level)


def reported_symptoms() -> Column:
    """Symptoms that a row of answers reports."""
    checks = [(F.col("fatigue_severity") >= 5, "fatigue"), (F.col("brain_fog_frequency").isin("sometimes", "often", "always"), "brain_fog"), (F.col("hair_loss").isin("mild", "moderate", "severe"), "hair_loss")]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda x: x.isNotNull())


def fired_edges(findings: DataFrame, owner: str = "patient_id") -> DataFrame:
    """Findings (owner, marker, value) with the indications of the thresholds they cross, less those whose co-marker
    contradicts; a missing co-marker passes.

    The owner's markers travel as one map (at most a value per marker), so co-markers need no second join of the facts.
    """
    spark = findings.sparkSession
    own = findings.groupBy(owner).agg(F.map_from_entries(F.collect_list(F.struct("marker", "value"))).alias("_all"))
    rules = thresholds(spark).join(indications(spark), "threshold")
    reference = F.broadcast(catalog.meta(spark).select(F.col("marker").alias("_rm"), "ref_low", "ref_high"))
    rows = own.select(owner, "_all", F.explode("_all").alias("marker", "value")).join(F.broadcast(rules), "marker").where(fires(F.col("value"), F.col("op"), F.col("bound")))
    rows = rows.join(reference, F.col("required") == F.col("_rm"), "left").withColumn("_co", F.try_element_at("_all", F.col("required")))
    met = F.when((F.col("required") == "") | F.col("_co").isNull(), True).when(F.col("requirement") == "within", F.col("_co").between(F.col("ref_low"), F.col("ref_high"))).otherwise(F.col("_co") > F.col("required_bound"))
    return rows.where(met).drop("_all", "_co", "_rm", "ref_low", "ref_high")


def evidence_chains(findings: DataFrame, reported: DataFrame, owner: str = "patient_id", limit: int = 8) -> DataFrame:
    """The ``limit`` best chains of each owner, ranked, with the number of all.

    ``reported``: owner, symptoms array.  One chain per marker, relation and condition, by its strongest edge (the first of equals); its symptoms
    are those of the condition.  Order: symptoms that are reported, INDICATES first, evidence, marker, condition.
    """
    spark = findings.sparkSession
    rows = fired_edges(findings, owner).withColumn("_e", evidence_rank(F.col("evidence_level")))
    best = Window.partitionBy(owner, "marker", "relation", "condition").orderBy("_e", "edge_no")
    rows = rows.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    linked = symptom_edges(spark).groupBy("condition").agg(F.sort_array(F.collect_set("symptom")).alias("symptoms"))
    rows = rows.join(F.broadcast(linked), "condition", "left").join(F.broadcast(sources(spark)), "source", "left").join(reported.select(owner, F.col("symptoms").alias("_reported")), owner, "left")
    matched = F.size(F.array_intersect(F.coalesce("symptoms", F.array().cast("array<string>")), F.coalesce("_reported", F.array().cast("array<string>"))))
    rows = rows.withColumns({"matched": matched, "source_title": F.coalesce("source_title", "source"), "verified": F.col("evidence_level").isin(*VERIFIED)})
    order = Window.partitionBy(owner).orderBy(F.desc("matched"), (F.col("relation") != "INDICATES").cast("int"), "_e", "marker", "condition")
    ranked = rows.withColumns({"rank": F.row_number().over(order), "chains": F.count("*").over(Window.partitionBy(owner))}).where(F.col("rank") <= limit)
    return ranked.select(owner, "rank", "chains", "marker", "value", "threshold", "relation", "condition", "evidence_level", "verified", "source_title", "symptoms", "matched")


def edge_problems(edges_: DataFrame, sources_: DataFrame) -> DataFrame:
    """L3: sourced edges whose source or level is unknown."""
    sourced = edges_.where("source is not null")
    unknown = sourced.join(F.broadcast(sources_), "source", "left_anti").withColumn("problem", F.lit("unknown source"))
    return unknown.unionByName(sourced.where(~F.col("evidence_level").isin(*EVIDENCE)).withColumn("problem", F.lit("unknown level")))


def health(nodes_: DataFrame) -> DataFrame:
    """L2."""
    return nodes_.groupBy("label").agg(F.count("*").alias("nodes"))


def level_rank(level: Column) -> Column:
    """routine 1, priority 2, urgent 3, emergency 4."""
    return F.array_position(F.array(*map(F.lit, catalog.LEVELS)), level)


def strongest(reasons: DataFrame, owner: str) -> DataFrame:
    """The highest level of each owner's reasons (owner, level, reason), with all of them."""
    top = reasons.groupBy(owner).agg(F.max(level_rank(F.col("level"))).alias("_r"), F.sort_array(F.collect_set(F.struct("level", "reason"))).alias("reasons"))
    return top.select(owner, F.get(F.array(*map(F.lit, catalog.LEVELS)), (F.col("_r") - 1).cast("int")).alias("level"), "reasons")


def escalation_recall(wanted: DataFrame, assigned: DataFrame, owner: str) -> DataFrame:
    """Owners for whom a level is ``wanted``, and the share whose assigned level is at least that; no assigned level is below all."""
    rank = level_rank(F.col("level"))
    both = wanted.select(owner, rank.alias("_w")).join(assigned.select(owner, rank.alias("_a")), owner, "left")
    return both.agg(F.count("*").alias("patients"), F.avg((F.coalesce("_a", F.lit(0)) >= F.col("_w")).cast("int")).alias("recall"))


def escalation(values: DataFrame, answers: DataFrame, issues: DataFrame, texts: DataFrame, owner: str) -> DataFrame:
    """The level that markers, answers, quality errors and messages call for; owners without reasons are not listed."""
    from .text import red_flag

    by_marker = triggered(values, catalog.escalation_rules(values.sparkSession)).select(owner, "level", "reason")
    high = answers.where("fatigue_severity >= 9").select(owner, F.lit("priority").alias("level"), F.lit("very high fatigue").alias("reason"))
    both = answers.where("brain_fog_frequency = 'always' and hair_loss = 'severe'").select(owner, F.lit("priority").alias("level"), F.lit("severe symptoms").alias("reason"))
    errors = issues.where("severity = 'error'").select(owner, F.lit("priority").alias("level"), F.lit("quality error").alias("reason")).distinct()
    urgent = texts.where(red_flag(F.col("text"))).select(owner, F.lit("emergency").alias("level"), F.lit("red flag in message").alias("reason")).distinct()
    return strongest(by_marker.unionByName(high).unionByName(both).unionByName(errors).unionByName(urgent), owner)
