"""Label matching against plain Python over all pairs of labels and aliases, and its plan over many labels."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from labspark import catalog
from labspark.operators import normalize


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def best(clean, known, method):
    """marker, confidence and method of a cleaned label by the stated rule."""
    if clean in known:
        return known[clean], 1.0, "exact"
    begins = [a for a in known if len(a) >= 3 and f"{clean} ".startswith(f"{a} ")]
    if begins:
        return known[max(begins, key=lambda a: (len(a), a))], 0.95, "contains"
    reach = [a for a in known if clean and 2 * min(len(a), len(clean)) > 0.8 * (len(a) + len(clean))]  # no other comes near 0.84
    scored = [(difflib.SequenceMatcher(None, a, clean).ratio() if method == "ratio" else 1 - edits(a, clean) / max(len(a), len(clean)), a) for a in reach]
    ratio, alias = max(scored, default=(0.0, ""))
    return (known[alias], 0.9 * ratio, "fuzzy") if ratio >= 0.84 else None


def misspelt(rng, alias):
    letters = list(alias)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(letters) + 1)
        letters[at : at + rng.randint(0, 2)] = rng.choices("abetr 0", k=rng.randint(0, 2))
    return "".join(letters)


@pytest.mark.parametrize("method", ["ratio", "levenshtein"])
def test_all_pairs(spark, method):
    rng = random.Random(7)
    made = {"".join(rng.choices("ab e1", k=rng.randint(1, 12))).strip() for _ in range(60)}
    known = {r.alias: r.marker for r in catalog.aliases(spark).collect()} | {" ".join(a.split()): f"m{i}" for i, a in enumerate(sorted(made)) if a}
    aliases = spark.createDataFrame(sorted(known.items()), "alias string, marker string")
    labels = {misspelt(rng, a) for a in known for _ in range(15)} | {"", "a", "aa", "aaaaaaaaaaaa", "x" * 5000, "tsh " * 2000}
    rows = spark.createDataFrame([(x,) for x in sorted(labels)], "raw_label string")
    clean = {r.raw_label: r.c for r in rows.select("raw_label", catalog.clean_label(F.col("raw_label")).alias("c")).collect()}
    want = {x: w for x, c in clean.items() if (w := best(c, known, method))}
    got = {r.label: (r.marker, r.confidence, r.match_method) for r in normalize.match_labels(rows, method=method, aliases=aliases).collect()}
    assert set(got) == set(want) and sum(w[2] == "fuzzy" for w in want.values()) > 100
    for x, (marker, confidence, how) in want.items():
        assert got[x][0] == marker and got[x][2] == how and got[x][1] == pytest.approx(confidence, abs=1e-12)


def test_no_aliases(spark):
    rows = spark.createDataFrame([("TSH",), (None,)], "raw_label string")
    assert normalize.match_labels(rows, aliases=spark.createDataFrame([], "alias string, marker string")).count() == 0


def test_many_labels(spark):
    """Of 100,000 different labels and all aliases few pairs are compared, none of them met in a nested loop."""
    rows = spark.range(100_000).select(F.concat(F.lit("ferritn "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 1 + (F.col("id") % 11).cast("int"))).alias("label"), "id")
    labels = rows.groupBy("label").agg(F.min("id").alias("id")).select("label", F.col("label").alias("clean"))
    known = catalog.aliases(spark)
    pairs = normalize.close_aliases(labels, known)
    assert pairs.count() < 0.02 * labels.count() * known.count()
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in pairs._jdf.queryExecution().executedPlan().toString()
