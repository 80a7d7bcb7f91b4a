"""Queues, visibility, summaries and life cycles of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .graph import level_rank

STEPS = {"processing": ("pending_review", "failed"), "pending_review": ("approved", "rejected"), "approved": (), "rejected": (), "failed": ()}


def review_queue(reports: DataFrame, limit: int = 200) -> DataFrame:
    """The oldest ``limit`` pending reports, then by falling level and age.  The first order is a bounded top-k."""
    return reports.where("status = 'pending_review'").orderBy("created_at", "report_id").limit(limit).orderBy(F.desc(level_rank(F.col("level"))), "created_at", "report_id")


def visible(reports: DataFrame) -> DataFrame:
    """The interpretation only of approved reports, the clinician's edit before the generated text."""
    return reports.withColumn("interpretation", F.when(F.col("status") == "approved", F.coalesce("edited", "generated"))).drop("edited", "generated")


def is_object_id(text: Column) -> Column:
    """B16."""
    return F.coalesce(F.lower(F.trim(text)).rlike("^[0-9a-f]{24}$"), F.lit(False))


def latest_of(rows: DataFrame, owner: str, at: str, tie: str) -> DataFrame:
    """Each owner's latest row."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(at), F.desc(tie)))).where("_r = 1").drop("_r")


def recent(rows: DataFrame, owner: str, at: str, tie: str, n: int) -> DataFrame:
    """Each owner's ``n`` most recent rows, numbered from the newest."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(at), F.desc(tie)))).where(F.col("place") <= n)


def transitions(events: DataFrame, report: str = "report_id", at: str = "at", status: str = "status", tie: str = "event_id") -> DataFrame:
    """Status changes with the one before and whether the life cycle allows them."""
    before = F.lag(status).over(Window.partitionBy(report).orderBy(at, tie))
    allowed = F.col("before").isNull() & (F.col(status) == "processing")
    for a, following in STEPS.items():
        allowed = allowed | ((F.col("before") == a) & F.col(status).isin(*following))
    return events.withColumn("before", before).withColumn("legal", F.coalesce(allowed, F.lit(False)))


def status_counts(events: DataFrame, report: str = "report_id", at: str = "at", status: str = "status", tie: str = "event_id") -> DataFrame:
    """Reports by their latest status."""
    last = events.groupBy(report).agg(F.max_by(status, F.struct(at, tie)).alias("status"))
    return last.groupBy("status").agg(F.count("*").alias("reports"))


def band_positions(values: DataFrame, bands: DataFrame) -> DataFrame:
    """Rows (marker, value, low, high) against bands (marker, band_low, band_high, low_limited, high_limited, ladder): reference and functional
    position, status and percentile.  A band's edge at the limit of the data is open; bands have a row per marker."""
    rows = values.join(F.broadcast(bands), "marker", "left")
    functional = S.position(F.col("value"), F.when(~F.col("low_limited"), F.col("band_low")), F.when(~F.col("high_limited"), F.col("band_high")))
    rows = rows.withColumns({"reference_status": S.position(F.col("value"), F.col("low"), F.col("high")), "functional_status": F.when(F.col("band_low").isNotNull() | F.col("band_high").isNotNull(), functional)})
    found = F.size(F.filter("ladder", lambda q: q <= F.col("value")))
    return rows.withColumns({"status": S.status(F.col("reference_status"), F.col("functional_status")), "percentile": F.when(F.col("ladder").isNotNull(), F.when(found == F.size("ladder"), 100).otherwise(found))}).drop("ladder")


def template_summary(positions: DataFrame, owner: str) -> DataFrame:
    """Sentences on an owner's markers, those out of range first, then the list of those in range and a closing line.

    ``positions``: rows of ``band_positions`` with display and unit.
    """
    value = F.concat_ws(" ", S.show_number(F.col("value")), "unit")
    word = F.when(F.col("reference_status") == "below", "lower").otherwise("higher")
    out = F.concat("display", F.lit(" is "), value, F.lit(". That is "), word, F.lit(" than the usual lab range of "), S.show_number(F.col("low")), F.lit(" to "), S.show_number(F.col("high")), F.lit("."))
    edge = F.concat("display", F.lit(" is "), value, F.lit(". It is in the usual lab range, but near its edge."))
    sentence = F.when(F.col("reference_status") != "within", out).when(F.col("functional_status").isin("below", "above"), edge)
    rows = positions.withColumn("sentence", sentence).groupBy(owner).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("sentence").isNotNull(), F.struct((F.col("reference_status") == "within").alias("o"), "marker", "sentence")))), lambda s: s["sentence"]).alias("lines"),
        F.sort_array(F.collect_list(F.when(F.col("sentence").isNull(), F.col("display")))).alias("fine"),
    )
    return rows.select(owner, F.concat_ws("\n\n", F.array_join(F.concat(F.array(F.lit("Here is a plain summary of your lab report.")), "lines"), " "), F.when(F.size("fine") > 0, F.concat(F.lit("These results are in the usual range: "), S.listed(F.col("fine")), F.lit("."))), F.lit("Use the question list below to talk with your clinician.")).alias("summary"))


def appointment_guide(positions: DataFrame, levels: DataFrame, owner: str, limit: int = 8) -> DataFrame:
    """At most ``limit`` questions, an urgent one first."""
    ask = F.when(F.col("reference_status") != "within", F.concat(F.lit("My "), "display", F.lit(" was "), F.when(F.col("reference_status") == "below", "low").otherwise("high"), F.lit(". What could explain this, and should it be re-tested?"))).when(
        F.col("functional_status").isin("below", "above"), F.concat(F.lit("My "), "display", F.lit(" is in range but near the edge. Is that worth watching?"))
    )
    rows = positions.withColumn("q", ask).groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("q").isNotNull(), F.struct("marker", "q")))), lambda s: s["q"]).alias("own")).join(levels.select(owner, "level"), owner, "left")
    first = F.when(F.col("level").isin("urgent", "emergency"), F.array(F.lit("Some results were flagged for prompt review. What should I do next, and how soon?"))).otherwise(F.array().cast("array<string>"))
    return rows.select(owner, F.slice(F.concat(first, "own", F.array(F.lit("Are there other tests or follow-up steps you would suggest?"))), 1, limit).alias("questions"))


def throughput(jobs: DataFrame, elapsed: str = "seconds") -> DataFrame:
    """Job rows (error, rows, method, ``elapsed`` of one worker) in one row: documents, errors, result rows, documents by method, and documents a second.

    A document without an error counts for its method; the rate is null where no time was spent.
    """
    done = F.col("error").isNull()
    by = jobs.where(done).groupBy("method").agg(F.count("*").alias("c")).agg(F.sort_array(F.collect_list(F.concat_ws(":", "method", "c"))).alias("methods"))  # a row per method
    totals = jobs.agg(F.count("*").alias("documents"), F.count_if(~done).alias("errors"), F.coalesce(F.sum(F.when(done, F.col("rows"))), F.lit(0)).alias("rows"), F.sum(elapsed).alias("_s"))
    return totals.crossJoin(by).select("documents", "errors", "rows", F.array_join("methods", ",").alias("methods"), F.when(F.col("_s") > 0, F.round(F.col("documents") / F.col("_s"), 2)).alias("docs_per_second"))


def interpretation(reports: DataFrame, owner: str, **parts: DataFrame) -> DataFrame:
    """L4: a report's bands, clusters, risks, chains, level and summary in one row; each part is a table with the owner's key, nested under its
    name as an array, empty where the owner has none."""
    out = reports
    for name, part in parts.items():
        fields = [c for c in part.columns if c != owner]
        out = out.join(part.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name)), owner, "left")
    return out


#: What counts as a number in a text, and the whole numbers that any text may name (percentiles, "out of 100").
NUMBER, COMMON = r"(?<![\w.])\d+(?:\.\d+)?", 100


def printed_forms(numbers: Column) -> Column:
    """The ways in which texts may print numbers: rounded to none, one and two places, as hundredths, and without ending zeros."""
    def forms(n: Column) -> Column:
        x = n.cast("double")
        made = F.array(n, *[F.format_string(f"%.{k}f", x) for k in (0, 1, 2, 6)], F.format_string("%.0f", x * 100))
        return F.concat(made, F.transform(made, lambda t: F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)))

    return F.array_distinct(F.flatten(F.transform(numbers, forms)))


def ungrounded(text: Column, facts: Column) -> Column:
    """The different numbers of a text that its report's own facts (any nested column) do not hold in a printed form, in order; null text has none."""
    allowed = printed_forms(F.array_distinct(F.regexp_extract_all(F.to_json(facts), F.lit(NUMBER), F.lit(0))))
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)))
    common = F.transform(F.sequence(F.lit(0), F.lit(COMMON)), lambda i: i.cast("string"))
    return F.sort_array(F.array_except(F.array_except(found, common), F.coalesce(allowed, F.array().cast("array<string>"))))
