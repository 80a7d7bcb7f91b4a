"""Scalar column functions (H1 to H29).  All are native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "how", "i", "in", "is", "it", "my", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "with")
# The patterns of words and sentence ends that readability counts by.
WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
SENTENCE_BREAK = r"""(?<=[.!?])\s+(?=[A-Z0-9"'(\[])|\n+"""


def clean_unit(unit: Column) -> Column:
    """H1: lower case, mu as u, mcg as ug, no blanks, litre spelt l; null as empty."""
    text = F.translate(F.lower(F.trim(F.coalesce(unit, F.lit("")))), "µμ", "uu")
    for old, new in (("mcg", "ug"), (" ", ""), ("litre", "l"), ("liter", "l")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_unit_report(unit: Column) -> Column:
    """H2: as H1, with "per" as a slash and without a trailing full stop."""
    return F.regexp_replace(F.replace(clean_unit(unit), F.lit("per"), F.lit("/")), r"\.+$", "")


def qualifier(value: Column) -> Column:
    """H4: a leading < > <= >=, else null."""
    return F.nullif(F.regexp_extract(value, r"^ *([<>]=?)", 1), F.lit(""))


def parse_value(value: Column) -> tuple[Column, Column]:
    """H5: (number, qualifier) of a whole value, with decimal comma and ≤ ≥; both null where it is none."""
    pattern = r"^\s*([<>]=?|≤|≥)?\s*(-?\d+(?:[.,]\d+)?)\s*$"
    sign = F.nullif(F.regexp_extract(value, pattern, 1), F.lit(""))
    number = F.replace(F.regexp_extract(value, pattern, 2), F.lit(","), F.lit(".")).try_cast("double")
    return number, F.when(sign == "≤", "<=").when(sign == "≥", ">=").otherwise(sign)


def lenient_number(value: Column) -> Column:
    """H6: digits, full stops and commas only, then a number or null."""
    return F.replace(F.regexp_replace(value, "[^0-9.,]", ""), F.lit(","), F.lit(".")).try_cast("double")


def first_integer(text: Column) -> Column:
    """H7: the first run of digits as int, else null."""
    return F.regexp_extract(text, "([0-9]+)", 1).try_cast("int")


def age_at(date: Column, birth_year: Column) -> Column:
    """H8."""
    return F.year(date) - birth_year


def log_distance(value: Column, target: Column, floor: float = 1e-6) -> Column:
    """H9: distance of logarithms, with a floor under the value."""
    return F.abs(F.log(F.greatest(value, F.lit(floor))) - target)


def age_band(age: Column) -> Column:
    """0, 1, 2, 3 for ages from 0, 30, 45, 60; other ages and null count as the last."""
    return F.when((age >= 0) & (age < 30), 0).when((age >= 30) & (age < 45), 1).when((age >= 45) & (age < 60), 2).otherwise(3)


def interpolate(x: Column, knots: Column) -> Column:
    """Piecewise linear through knots (array of struct x, y, sorted), constant outside."""
    left, right = F.filter(knots, lambda k: k["x"] <= x), F.filter(knots, lambda k: k["x"] > x)
    a, b = F.get(left, F.size(left) - 1), F.get(right, F.lit(0))
    between = a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / (b["x"] - a["x"])
    return F.when(x.isNull(), None).when(F.size(left) == 0, F.element_at(knots, 1)["y"]).when(F.size(right) == 0, F.element_at(knots, -1)["y"]).otherwise(between)


def sigmoid(margin: Column) -> Column:
    """H12."""
    return 1 / (1 + F.exp(-margin))


def risk_level(p: Column) -> Column:
    """H13."""
    return F.when(p < 0.15, "low").when(p < 0.35, "moderate").when(p.isNotNull(), "elevated")


def position(value: Column, low: Column, high: Column) -> Column:
    """Below, within or above; open where a bound is null."""
    return F.when(value.isNull(), None).when(low.isNotNull() & (value < low), "below").when(high.isNotNull() & (value > high), "above").otherwise("within")


def status(reference: Column, functional: Column) -> Column:
    """Of two positions."""
    return F.when(reference.isNull(), "unknown").when(reference == "below", "low").when(reference == "above", "high").when(functional.isin("below", "above"), "borderline").otherwise("in_range")


def reference_position(value: Column, low: Column, high: Column) -> Column:
    """0 at the low end, 1 at the high end; null where the span is not positive."""
    return F.when(high > low, (value - low) / (high - low))


def show_number(v: Column) -> Column:
    """No decimals from 100, one from 10, else two, without trailing zeros."""
    text = F.when(F.abs(v) >= 100, F.format_string("%.0f", v)).when(F.abs(v) >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 11th."""
    last = n % 10
    return F.concat(n.cast("string"), F.when((n % 100).between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Runs of ASCII letters and digits in lower case, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*stop_words))


def sentences(text: Column) -> Column:
    """Trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, SENTENCE_BREAK), lambda s: F.trim(s)), lambda s: s != "")  # F.trim itself would take the place in the array as the characters to trim


def syllables(word: Column) -> Column:
    """Vowel groups without a silent ending; at least one."""
    w = F.lower(word)
    stem = F.regexp_replace(F.regexp_replace(w, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(stem, F.lit("[aeiouy]+"))))


def all_syllables(words: Column) -> Column:
    """The sum of ``syllables`` over an array of words, by a few passes over the words joined up instead of three patterns a word."""
    long = F.filter(words, lambda w: F.length(w) > 3)
    joined = F.lower(F.array_join(F.concat(F.array(F.lit("")), long), " "))  # a blank before each
    stems = F.regexp_replace(F.regexp_replace(joined, "(?:[^laeiouy ]es|ed|[^laeiouy ]e)(?= |$)", ""), "(?<= )y", "")
    # A stem without a vowel counts as one.
    groups = once(stems, lambda s: F.regexp_count(s, F.lit("[aeiouy]+")) + F.regexp_count(s, F.lit(" [^aeiouy ]*+(?= |$)")))
    return F.size(F.filter(words, lambda w: F.length(w) <= 3)) + groups


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def reading_grade(text: Column, own: Column | None = None) -> Column:
    """Flesch-Kincaid grade, 0 without words.  ``own``: the text's ``sentences``, where they are at hand."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    count = F.size(F.filter(sentences(text) if own is None else own, lambda s: s.rlike("[A-Za-z]")))

    def grade(t: Column) -> Column:
        n = F.size(t["words"])
        made = 0.39 * (n / t["count"]) + 11.8 * (all_syllables(t["words"]) / n) - 15.59
        return F.when((t["count"] == 0) | (n == 0), 0.0).otherwise(F.round(made, 2))

    return once(F.struct(words.alias("words"), count.alias("count")), grade)


def squeezed(text: Column) -> Column:
    """Lower case with single blanks."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def short_hash(text: Column) -> Column:
    """16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def appended(trail: Column, entry: Column) -> Column:
    """An audit array with one more entry; null counts as empty."""
    return F.when(trail.isNull(), F.array(entry)).otherwise(F.array_append(trail, entry))


def prior_stats(low: Column, high: Column) -> dict[str, Column]:
    """Log-normal statistics that a reference interval implies, with twice the spread."""
    a, b = F.log(F.greatest(low, F.lit(1e-3))), F.log(F.greatest(high, F.lit(1e-3)))
    mean, sd = (a + b) / 2, (b - a) / 3.92 * 2
    return {"log_mean": mean, "log_sd": sd, "log_q1": mean - 0.674 * sd, "log_q3": mean + 0.674 * sd}


def listed(items: Column) -> Column:
    """Comma-separated with "and" before the last."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.get(items, n - 1)))


def value_text(value: Column, unit: Column, raw_value: Column, raw_unit: Column) -> Column:
    """As reported, with the converted value in brackets where the unit was another."""
    own = F.concat_ws(" ", show_number(value), unit)
    return F.when(raw_value.isNull() | raw_unit.eqNullSafe(unit), own).otherwise(F.concat(F.concat_ws(" ", raw_value, raw_unit), F.lit(" ("), own, F.lit(")")))
