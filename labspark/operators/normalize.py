"""Labels to markers, units to the catalog's, raw rows to normalised ones."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scalar as S
from ..sources.io import durable

FUZZY_CUTOFF = 0.84


def close_aliases(labels: DataFrame, known: DataFrame, method: str = "ratio", cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """label, clean, alias, marker: the pairs that may reach ``cutoff``, by an index on pairs of neighbouring letters; none that reaches it is left out.

    Each pair of letters carries its number among equal ones, so that texts are sets.  Texts of a and b letters whose matching blocks hold m letters have
    a + b - 2m others, so at most one block more than that, and share 3m - (a + b) - 1 pairs at least; an edit spoils two pairs at most.  Count filter: so many
    pairs are shared.  Prefix filter: with t to be shared, one of the first n - t + 1 of n pairs is, in any order that both sides keep; from z to a, rare first
    letters come first.  A pair of texts leaves the join once, at the first entry shared.  Texts of one letter are only like themselves; equal texts are found, too.
    """
    a, b = F.length("clean"), F.length("alias")
    if method == "levenshtein":
        share, least = 2 * cutoff - 1, F.greatest(a, b) - 1 - 2 * F.floor((1 - cutoff) * F.greatest(a, b) + 1e-9)
    else:
        share, least = (3 * cutoff - 2) / (2 - cutoff), 3 * F.ceil(cutoff * (a + b) / 2 - 1e-9) - (a + b) - 1

    def indexed(rows: DataFrame, text: str, side: str) -> DataFrame:
        n = F.length(text)
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(F.col(text), i, F.lit(2)))
        numbered = F.transform("_p", lambda g, i: F.concat(g, (i + 1 - F.array_position("_p", g)).cast("string")))
        head = (n - F.greatest(F.lit(1), F.ceil(share * n - 1 - 1e-9))).cast("int")
        made = rows.where(n > 1).withColumn("_p", F.sort_array(pairs, asc=False)).withColumn(f"_{side}", numbered).drop("_p").withColumn(f"_{side}_head", F.slice(f"_{side}", 1, head))
        return made.withColumn("_entry", F.explode(f"_{side}_head"))

    met = indexed(labels.select("label", "clean"), "clean", "l").join(indexed(known.select("alias", "marker"), "alias", "k"), "_entry")
    first = F.col("_entry") == F.element_at(F.array_intersect("_l_head", "_k_head"), 1)
    return met.where(first & (F.size(F.array_intersect("_l", "_k")) >= least)).select("label", "clean", "alias", "marker")


def match_labels(labels: DataFrame, column: str = "raw_label", method: str = "ratio", aliases: DataFrame | None = None) -> DataFrame:
    """One row per different label that has a marker: label, marker, confidence, match_method.

    Exact alias (1.0), then the longest alias of three letters or more that begins the label at a word's end (0.95), then the most
    similar alias from 0.84 on (0.9 times the similarity; ``method`` "ratio" is that of matching blocks, "levenshtein" a native
    edit similarity).  Works on distinct labels only, and only aliases that share enough pairs of letters are compared
    (``close_aliases``); null counts as the empty label, which matches nothing.
    """
    spark = labels.sparkSession
    known = aliases if aliases is not None else F.broadcast(catalog.aliases(spark))  # the catalog's is a fixed table of some hundred rows
    raw = labels.select(F.coalesce(F.col(column), F.lit("")).alias("label")).distinct().withColumn("clean", catalog.clean_label(F.col("label")))
    raw = raw if labels.isStreaming else durable(raw)  # the three ways of matching read the labels, not the rows again
    exact = raw.join(known, F.col("clean") == F.col("alias")).select("label", "marker", F.lit(1.0).alias("confidence"), F.lit("exact").alias("match_method"))
    rest = raw.join(known.select("alias"), F.col("clean") == F.col("alias"), "left_anti").where("clean <> ''")
    # Both sides are read in bounded form: a label's beginnings have at most the words of the longest alias, and no longer label can be similar.
    longest, words = known.agg(F.coalesce(F.max(F.length("alias")), F.lit(0)), F.coalesce(F.max(F.size(F.split("alias", " "))), F.lit(1))).first()
    pieces = rest.withColumn("_w", F.split("clean", " "))
    begins = F.transform(F.sequence(F.lit(1), F.least(F.size("_w"), F.lit(words))), lambda i: F.array_join(F.slice("_w", 1, i), " "))
    heads = pieces.select("label", "clean", F.explode(begins).alias("_head"))
    # Only beginnings that are an alias leave the join; whether a label has one is asked only of those short enough to be similar to an alias.
    prefix = heads.join(known, (F.col("_head") == F.col("alias")) & (F.length("alias") >= 3)).groupBy("label").agg(F.max_by("marker", F.struct(F.length("alias"), F.col("alias"))).alias("marker"))
    prefix = prefix.select("label", "marker", F.lit(0.95).alias("confidence"), F.lit("contains").alias("match_method"))
    short = F.length("clean") <= longest * (2 - FUZZY_CUTOFF) / FUZZY_CUTOFF + 1e-9
    begun = heads.where(short).join(known, (F.col("_head") == F.col("alias")) & (F.length("alias") >= 3), "left_semi").select("label")
    remaining = rest.where(short).join(begun, "label", "left_anti").select("label", "clean")
    close = close_aliases(remaining, known, method)
    if method == "levenshtein":
        pairs = close.withColumn("ratio", 1 - F.levenshtein("clean", "alias") / F.greatest(F.length("clean"), F.length("alias")))
    else:

        @F.pandas_udf("double")
        def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for a, b in batches:
                yield pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

        pairs = close.withColumn("ratio", ratio("clean", "alias"))
    best = pairs.where(F.col("ratio") >= FUZZY_CUTOFF).groupBy("label").agg(F.max(F.struct("ratio", "alias", "marker")).alias("b"))
    fuzzy = best.select("label", "b.marker", (0.9 * F.col("b.ratio")).alias("confidence"), F.lit("fuzzy").alias("match_method"))
    return exact.unionByName(prefix).unionByName(fuzzy)


def convert_batch(value: Column, unit_clean: Column, units: Column, low: Column, high: Column, plaus_low: Column, plaus_high: Column) -> Column:
    """I3 as a struct value_si, unit_inferred: by the named unit, else by the plausible unit whose value lies nearest to the
    reference's middle on the log scale (ties to the smaller factor); null where none is plausible.

    ``units`` is the marker's array of (factor, unit_clean): candidates are weighed within the row, without a join.
    """
    named = F.get(F.filter(units, lambda u: u["unit_clean"] == unit_clean), F.lit(0))["factor"]
    middle = F.log((low + high) / 2)
    plausible = F.filter(units, lambda u: (value * u["factor"]).between(plaus_low, plaus_high))
    best = F.array_min(F.transform(plausible, lambda u: F.struct(S.log_distance(value * u["factor"], middle).alias("d"), u["factor"].alias("factor"))))
    return F.struct(F.coalesce(value * named, value * best["factor"]).alias("value_si"), (named.isNull() & best.isNotNull()).alias("unit_inferred"))


def convert_report(value: Column, unit_clean: Column, units: Column, low: Column, high: Column, plaus_low: Column, plaus_high: Column) -> Column:
    """I4 as a struct value_si, unit_inferred, unit_confidence: a named unit counts fully; otherwise the plausible unit nearest to
    the reference, 0 inside it (0.6, or 0.45 if several lie inside); none keeps the value at 0.2."""
    named = F.get(F.filter(units, lambda u: u["unit_clean"] == unit_clean), F.lit(0))["factor"]

    def distance(v: Column) -> Column:
        floor = F.lit(1e-3)
        edge = F.least(F.abs(F.log(F.greatest(v, floor)) - F.log(F.greatest(low, floor))), F.abs(F.log(F.greatest(v, floor)) - F.log(F.greatest(high, floor))))
        return F.when(v.between(low, high), 0.0).otherwise(edge)

    plausible = F.filter(units, lambda u: (value * u["factor"]).between(plaus_low, plaus_high))
    scored = F.transform(plausible, lambda u: F.struct(distance(value * u["factor"]).alias("d"), u["factor"].alias("factor")))
    inside = F.size(F.array_distinct(F.transform(F.filter(scored, lambda s: s["d"] == 0), lambda s: s["factor"])))
    best = F.array_min(scored)
    confidence = F.when(named.isNotNull(), 1.0).when(best.isNull(), 0.2).when(inside > 1, 0.45).otherwise(0.6)
    return F.struct(F.coalesce(value * named, value * best["factor"], value).alias("value_si"), named.isNull().alias("unit_inferred"), confidence.alias("unit_confidence"))


def with_catalog(rows: DataFrame, marker: str = "marker") -> DataFrame:
    """``rows`` with the marker's columns and its array of units; both sides of the joins have nine rows and are broadcast."""
    spark = rows.sparkSession
    meta = catalog.meta(spark).withColumnRenamed("marker", "_m").join(catalog.unit_arrays(spark).withColumnRenamed("marker", "_n"), F.col("_m") == F.col("_n")).drop("_n")
    return rows.join(F.broadcast(meta), F.col(marker) == F.col("_m")).drop("_m")


def references(rows: DataFrame, sex: str = "sex", marker: str = "marker") -> DataFrame:
    """Columns low and high, those of the row's sex where the catalog has them, else the general ones."""
    own = F.broadcast(catalog.sex_references(rows.sparkSession).select(F.col("marker").alias("_m"), F.col("sex").alias("_s"), "sex_low", "sex_high"))
    joined = rows.join(own, (F.col(marker) == F.col("_m")) & (F.upper(F.substring(F.col(sex), 1, 1)) == F.col("_s")), "left")
    return joined.withColumns({"low": F.coalesce("sex_low", "ref_low"), "high": F.coalesce("sex_high", "ref_high")}).drop("_m", "_s", "sex_low", "sex_high")


def normalise_rows(rows: DataFrame) -> DataFrame:
    """Raw rows (label, value, unit, sex, ocr_confidence) with value_si, confidence and ``reject_reason``; nothing is
    dropped.  Confidence is that of the name times unit times recognition, to three places."""
    names = match_labels(rows, "label").select(F.col("label").alias("_label"), "marker", F.col("confidence").alias("name_confidence"), "match_method")
    joined = rows.join(names, F.coalesce("label", F.lit("")) == F.col("_label"), "left").drop("_label")
    meta = catalog.meta(rows.sparkSession).withColumnRenamed("marker", "_m").withColumnRenamed("unit", "unit_si")
    units = catalog.unit_arrays(rows.sparkSession).withColumnRenamed("marker", "_n")
    joined = joined.join(F.broadcast(meta), F.col("marker") == F.col("_m"), "left").join(F.broadcast(units), F.col("marker") == F.col("_n"), "left").drop("_m", "_n")
    number, sign = S.parse_value(F.col("value"))
    joined = references(joined.withColumns({"number": number, "qualifier": sign}))
    made = convert_report(F.col("number"), S.clean_unit_report(F.col("unit")), F.col("units"), F.col("ref_low"), F.col("ref_high"), F.col("plaus_low"), F.col("plaus_high"))
    reason = F.when(F.col("marker").isNull(), "unknown_marker").when(F.col("number").isNull(), "not_numeric")
    joined = joined.withColumn("_c", made).withColumn("reject_reason", reason)
    return joined.select(
        *rows.columns, "marker", "loinc", "match_method", "qualifier", F.when(reason.isNull(), F.col("_c.value_si")).alias("value_si"), "unit_si", F.when(reason.isNull(), F.col("_c.unit_inferred")).alias("unit_inferred"), "low", "high",
        F.when(reason.isNull(), F.round(F.col("name_confidence") * F.col("_c.unit_confidence") * F.col("ocr_confidence"), 3)).alias("confidence"), "reject_reason",
    )


def reference_card(names: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """A marker's code, unit, range and band, looked up by any of its names or by its code; one JSON card a row."""
    spark = names.sparkSession
    meta = catalog.meta(spark)
    by_name = match_labels(names, "name").select(F.col("label").alias("name"), "marker")
    by_code = names.join(F.broadcast(meta), F.col("name") == F.col("loinc")).select("name", "marker").distinct()
    found = by_name.unionByName(by_code).join(F.broadcast(meta), "marker")
    if bands is not None:
        found = found.join(F.broadcast(bands.select("marker", "band_low", "band_high")), "marker", "left")
    return found.select("name", "marker", F.to_json(F.struct(*[c for c in found.columns if c != "name"])).alias("card"))
