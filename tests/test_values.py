"""Queries that SQL can't express, against plain Python over the same rows; and the distributed statistics against numpy."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labspark.functions import scalar as S
from labspark.operators import quality, retrieval, risk, stats, text
from labspark.plans import analysis_queries, base, lake_queries, text_queries


def _sentences(t):
    return [s.strip() for s in re.split(S.SENTENCE_BREAK, t) if s.strip()]


_NAMES = list(dict.fromkeys(c for c, _ in (*text.RULES, *text.INJECTION)))


def _broken(sentence):
    """Categories that a sentence breaks, by Python's regular expressions."""
    hit = {c for c, p in (*text.RULES, *text.INJECTION) if re.search(p, sentence, re.I)}
    if "prescriptive_advice" in hit and "dosage" not in hit and re.search(text.DEFERS, sentence, re.I):
        hit.discard("prescriptive_advice")
    return hit


@pytest.fixture(scope="module")
def messages(spark, sf_dir):
    return text_queries._messages(spark, sf_dir).collect()


def test_violations(spark, sf_dir, messages):
    want = Counter(c for m in messages for s in _sentences(m.text) for c in _broken(s))
    assert {r.category: r.n for r in text_queries.k6_k7_violations(spark, sf_dir).collect()} == want and len(want) >= 4


def test_rule_recall(spark, sf_dir, messages):
    hit = {m.id: any(_broken(s) for s in _sentences(m.text)) for m in messages}
    kind = {k: "unsafe" if (int(k.split("-")[0]) + int(k.split("-")[1])) % 24 < 5 else "safe" for k in hit}
    for r in text_queries.d21_rule_recall(spark, sf_dir).collect():
        own = [hit[k] for k in hit if kind[k] == r.category]
        assert (r.n, r.caught) == (len(own), pytest.approx(sum(own) / len(own), abs=1e-6))


def test_finalised_texts(spark, sf_dir, messages):
    got = {r.id: r for r in text_queries.k10_k12_finalised(spark, sf_dir).collect()}
    notice = "If you feel very unwell, call your local emergency number now."
    for m in messages:
        kept = [" ".join(s for s in _sentences(p) if not _broken(s)) for p in re.split(r"\n\s*\n", m.text)]
        body, private = "\n\n".join(p for p in kept if p), 0
        for pattern in text.PRIVATE:
            body, n = re.subn(pattern, "[removed]", body, flags=re.I)
            private += n
        flagged = any(re.search(p, m.text, re.I) for p in text.RED_FLAGS)
        whole = "\n\n".join([*([notice] if flagged else []), *([body] if body else []), "This summary is information, not medical advice.", f"Data: {text.catalog.LABEL}."])
        own = _sentences(m.text)
        assert (got[m.id].digest, got[m.id].sentences_removed, got[m.id].private_removed) == (hashlib.sha256(whole.encode()).hexdigest(), sum(bool(_broken(s)) for s in own), private), m.id


def test_draft_check(spark, sf_dir, messages):
    got = {r.id: r for r in text_queries.k11_draft_check(spark, sf_dir).collect()}
    for m in messages:
        bad = sum(bool(_broken(s)) for s in _sentences(m.text))
        assert got[m.id].violations == bad and got[m.id].acceptable == (bad == 0 and got[m.id].grade <= 8)


def test_report_rows_and_counts(spark, sf_dir):
    """What was printed on the report lines is what comes back."""
    lines = text_queries._report_lines(spark, sf_dir)
    marker, method = ({r[0]: r[i] for r in base._label_rows()} for i in (1, 3))
    raw = base.raw(spark, sf_dir).where("raw_label is not null").dropDuplicates(["event_id"]).collect()
    want = {}
    for r in raw:
        if r.raw_label in marker and r.raw_value != "n/a":
            unit = re.match(r"[A-Za-zµμ%]+\s*/\s*[A-Za-z]+", (r.raw_unit or "").strip())
            want[r.report_id, r.event_id + 10] = (marker[r.raw_label], r.raw_value.lstrip("<"), "<" if r.raw_value[0] == "<" else None, re.sub(r"\s+", "", unit[0]) if unit else None, "0.40 - 4.00", r.flag)
        elif r.raw_label in marker and method[r.raw_label] != "fuzzy":  # the range's first number is then the only one that a label stands before
            want[r.report_id, r.event_id + 10] = (marker[r.raw_label], "0.40", None, None, None, None)
    rows, lost, counts = text.parse_reports(lines)
    assert {(r.doc_id, r.line_no): (r.marker, r.value, r.qualifier, r.raw_unit, r.reference_text, r.flag) for r in rows.collect()} == want
    own = lines.collect()
    assert {(r.doc_id, r.line_no) for r in lost.collect()} == {(r.doc_id, r.line_no) for r in own} - set(want)
    total, found = Counter(r.doc_id for r in own), Counter(k for k, _ in want)
    got = {r.doc_id: r for r in text_queries.k3_report_counts(spark, sf_dir).collect()}
    assert {k: (r.line_count, r.row_count, r.unmatched) for k, r in got.items()} == {k: (n, found[k], n - found[k] or None) for k, n in total.items()}
    grouped = Counter((v[0], v[5], v[4]) for v in want.values())
    assert {(r.marker, r.flag, r.reference_text): r.n for r in text_queries.k1_e6_report_rows(spark, sf_dir).collect()} == grouped


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_error_rates_of_whole_passages(spark, sf_dir):
    texts = {r.item_id: r.text for r in base.table(spark, sf_dir, "benchmark").collect()}
    got = {r.item_id: r for r in text_queries.k19_error_rates(spark, sf_dir).collect()}
    assert got.keys() == {i for i in texts if i + 1 in texts} and any(len(t) > 300 for t in texts.values())
    for i, r in got.items():
        a, b = texts[i], texts[i + 1]
        assert r.cer == pytest.approx(_edits(a, b) / len(a), abs=1e-6) and r.wer == pytest.approx(_edits(a.split(), b.split()) / len(a.split()), abs=1e-6)


def test_paragraph_chunks(spark, sf_dir):
    got = defaultdict(list)
    for r in text_queries.k14_paragraph_chunks(spark, sf_dir).orderBy("doc_id", "chunk_no").collect():
        got[r.doc_id].append((r.section, r.length))
    for r in base.table(spark, sf_dir, "documents").collect():
        want, current, section, heading = [], "", r.lang, r.lang
        for p in (p.strip(" ") for p in (r.text or "").replace("\n", "\n\n").split("\n\n")):
            if p:
                heading = (p.lstrip("# ") or heading) if p.startswith("#") else heading
                if current and len(current) + len(p) > 700:
                    want.append((section, len(current)))
                    current = ""
                current, section = (current + "\n\n" + p, section) if current else (p, heading)
        if current:
            want.append((section, len(current)))
        assert got[r.doc_id] == want, r.doc_id


def test_passage_holders(spark, sf_dir):
    docs, asked = base.table(spark, sf_dir, "documents").select("doc_id", "text"), text_queries._asked(spark, sf_dir)
    want = {(q.item_id, r.doc_id) for q in asked.collect() for r in docs.collect() if r.text and q.query in r.text}
    assert {(r.item_id, r.doc_id) for r in retrieval.holders(docs, asked, "doc_id", "item_id").collect()} == want and want


def test_issues_and_rollup(spark, sf_dir):
    """Each report's roll-up says what its issues and rows say."""
    issues = lake_queries.i10_i14_issues(spark, sf_dir).collect()
    assert issues and all(r.n > 0 for r in issues)
    for r in lake_queries.d15_report_rollup(spark, sf_dir).collect():
        assert 0 <= r.completeness <= 1


def test_percentiles_and_ranks(spark):
    """Exact at every size and skew, with ties, nulls and infinities left to the order of numbers."""
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=30_000), "b": np.round(rng.normal(size=20_000), 1), "c": np.array([5.0]), "d": np.full(500, 2.0), "e": np.concatenate((np.zeros(9_000), rng.random(1_000)))} | {f"n{n}": rng.random(n) for n in (2, 3, 7, 199, 201, 202, 9_999, 10_001)}
    rows = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("f", None)], "k string, x double").repartition(7)
    levels = tuple(i / 100 for i in range(1, 100))
    for own in ((0.25, 0.75), (0.0, 0.5, 1.0), levels):
        got = {r.k: r for r in stats.percentiles(rows, ("k",), F.col("x"), own).collect()}
        assert got.keys() == data.keys()
        for k, v in data.items():
            assert got[k].n == len(v) and np.allclose(got[k].quantiles, np.quantile(v, own), rtol=1e-12, atol=1e-12), k
    whole = np.concatenate(list(data.values()))
    assert np.allclose(stats.percentiles(rows, (), F.col("x"), (0.1, 0.9)).first().quantiles, np.quantile(whole, (0.1, 0.9)))
    for r in stats.ranked_by_value(rows.where("k = 'b'"), ("k",), "x").collect():
        assert r.rank == (data["b"] < r.x).sum() + (r.n + 1) / 2 and r.n == (data["b"] == r.x).sum()


def test_population_stats(spark):
    rng = np.random.default_rng(5)
    values = np.exp(rng.normal(1, 0.4, 5000))
    rows = spark.createDataFrame([("m", float(v)) for v in values], "marker string, value_si double")
    exact, rough = (quality.population_stats(rows, exact=e).first() for e in (True, False))
    logs = np.log(values)
    assert (exact.log_mean, exact.log_sd, exact.log_q1, exact.log_q3, exact.n) == (pytest.approx(logs.mean()), pytest.approx(logs.std(ddof=1)), pytest.approx(np.quantile(logs, 0.25)), pytest.approx(np.quantile(logs, 0.75)), 5000)
    assert abs(rough.log_q1 - exact.log_q1) < 0.01


def test_shapley_values_by_all_orders():
    """A tree's contributions against the average over all orders of the features, under its own path weights."""
    #        x0 <= 1        / x1 <= 2 \\        x0 <= 3
    tree = tuple(np.array(x, t) for x, t in (([0, 1, 0, -1, -1, -1, -1], int), ([1.0, 2.0, 3.0, 0, 0, 0, 0], float), ([1, 3, 5, 0, 0, 0, 0], int), ([2, 4, 6, 0, 0, 0, 0], int), ([0, 0, 0, 1.0, 4.0, -2.0, 7.0], float), ([100, 40, 60, 10, 30, 45, 15], float)))
    feature, threshold, left, right, value, weight = tree

    def mean(row, known, k=0):
        if feature[k] < 0:
            return value[k]
        if feature[k] in known:
            return mean(row, known, left[k] if row[feature[k]] <= threshold[k] else right[k])
        return sum(weight[c] / weight[k] * mean(row, known, c) for c in (left[k], right[k]))

    x = np.array([[a, b, c] for a in (0.5, 2.0, 5.0) for b in (1.0, 3.0) for c in (0.0, 1.0)])
    got = risk.shapley(risk.leaf_paths(tree), x)
    for row, own in zip(x, got, strict=True):
        want, orders = np.zeros(3), list(itertools.permutations(range(3)))
        for order in orders:
            for i, f in enumerate(order):
                want[f] += (mean(row, {*order[: i + 1]}) - mean(row, {*order[:i]})) / len(orders)
        assert np.allclose(own, want)


def test_splits_samples_and_digests(spark, sf_dir):
    rows = base.table(spark, sf_dir, "events").withColumn("s", F.col("event_id") % 3)
    split = stats.stratified_split(rows, "event_id", "s").collect()
    assert len(split) == rows.count()
    for s in range(3):
        own = Counter(r.split for r in split if r.s == s)
        assert all(abs(own[n] / own.total() - share) < 0.02 for n, share in (("train", 0.7), ("calibration", 0.15), ("test", 0.15)))
    again = {r.event_id: r.split for r in stats.stratified_split(rows.repartition(5), "event_id", "s").collect()}
    assert again == {r.event_id: r.split for r in split}
    one, other = stats.seeded_sample(rows, "event_id", 50), stats.seeded_sample(rows.repartition(9), "event_id", 50)
    assert {r.event_id for r in one.collect()} == {r.event_id for r in other.collect()} and one.count() == 50
    digest = stats.fingerprint(rows).first().fingerprint
    assert digest == stats.fingerprint(rows.repartition(11)).first().fingerprint != stats.fingerprint(rows.where("event_id > 0").limit(10)).first().fingerprint
    weights = stats.bootstrap_weights(rows, "event_id", 4, 500, rows.count()).groupBy("replicate").agg(F.sum("weight").alias("n")).collect()
    assert len(weights) == 4 and all(abs(r.n - 500) < 5 * math.sqrt(500) for r in weights)


def test_words_to_lines_of_passages(spark, sf_dir):
    got = {(r.doc_id, r.line): r for r in text_queries.k4_e9_words_to_lines(spark, sf_dir).collect()}
    for r in base.table(spark, sf_dir, "benchmark").collect():
        words = re.split(r"[ \t\n\x0b\f\r]+", r.text)
        for line in range(-(-len(words) // 8)):
            own = [w for w in words[8 * line : 8 * line + 8] if w.strip()]
            left = [90 * i + (400 if i >= 4 else 0) for i, w in enumerate(words[8 * line : 8 * line + 8]) if w.strip()]
            width = [min(8 * len(w), 80) for w in own]
            gaps = [b - a - w for a, b, w in zip(left, left[1:], width, strict=False)]
            limit = max(2.5 * float(np.median([max(w, 1) / len(x) for w, x in zip(width, own, strict=True)])), 3 * (sorted(gaps)[len(gaps) // 4] if gaps else 0))
            want = own[0] if own else ""
            for gap, w in zip(gaps, own[1:], strict=True):
                want += ("    " if gap > limit else " ") + w
            assert not own or got[r.item_id, line].text == want


def test_interpretations_hold_their_parts(spark, sf_dir):
    positions = text_queries._positions(spark, sf_dir).collect()
    bands = Counter(r.patient_id for r in positions)
    got = {r.patient_id: r for r in text_queries.l4_interpretation(spark, sf_dir).collect()}
    assert {k: r.bands for k, r in got.items()} == bands
    summary = {r.patient_id: r.summary for r in text_queries.k21_summaries(spark, sf_dir).collect()}
    assert {k: r.summary_length for k, r in got.items()} == {k: len(t) for k, t in summary.items()}
    shown = defaultdict(list)
    for r in positions:
        if r.reference_status != "within":
            shown[r.patient_id].append(r.display)
    assert all(all(f"{n} is " in summary[k] for n in names) for k, names in shown.items())
    questions = {r.patient_id: r for r in text_queries.k22_questions(spark, sf_dir).collect()}
    assert all(1 <= r.n <= 8 for r in questions.values()) and questions.keys() == summary.keys()


def test_owner_search_stays_with_its_owner(spark, sf_dir):
    docs = {r.doc_id: r for r in base.table(spark, sf_dir, "documents").collect()}
    asked = {r.item_id: r.query for r in text_queries._asked(spark, sf_dir).collect()}
    stop = set(S.STOP_WORDS)
    terms = lambda t: [w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in stop]
    own = defaultdict(dict)
    for k, r in docs.items():
        own[r.source][k] = Counter(terms(r.text))
    got = {(r.source, r.item_id): r.doc_id for r in text_queries.k18_owner_search(spark, sf_dir).where("rank = 1").collect()}
    assert {(docs[i].source, i) for i in asked if i in docs} >= got.keys() and got
    for source, items in itertools.islice(itertools.groupby(sorted(got), key=lambda k: k[0]), 3):
        n, average = len(own[source]), sum(c.total() for c in own[source].values()) / len(own[source])
        df = Counter(w for c in own[source].values() for w in c)
        for _, item in items:
            q = Counter(terms(asked[item]))
            score = {k: sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.4 / (c[w] + 1.4 * (0.25 + 0.75 * c.total() / average)) for w, m in q.items() if c[w]) for k, c in own[source].items()}
            best = max(score, key=lambda k: (round(score[k], 9), k))
            assert got[source, item] == best or abs(score[got[source, item]] - score[best]) < 1e-6


def test_order_of_ordered_output(spark, sf_dir):
    rows = [(r.s_nationkey, r.s_suppkey) for r in text_queries.f1_ordered_output(spark, sf_dir).collect()]
    assert rows == sorted(rows)


def test_models_rank_what_they_were_fitted_on(spark, sf_dir):
    scores = analysis_queries.j16_logistic_baseline(spark, sf_dir).first()
    assert scores.auroc > 0.6 and 0 < scores.brier < 0.25
    rows = analysis_queries.j14_j15_j18_risk_scores(spark, sf_dir).collect()
    label = {r.id: r.y for r in base.relation(spark, sf_dir, analysis_queries._MODEL).collect()}
    known = [(r.probability, label[r.id]) for r in rows if r.probability is not None]
    assert all(0 <= p <= 1 for p, _ in known) and np.mean([p for p, y in known if y]) > np.mean([p for p, y in known if not y])
    assert all(r.level == ("low" if r.probability < 0.15 else "moderate" if r.probability < 0.35 else "elevated") for r in rows if r.probability is not None)


def test_equal_duplicates_are_ranked_by_the_given_ties(spark):
    """Rows that the duplicate rank's own order leaves equal come in the order of ``ties``, however the rows are dealt."""
    from labspark.operators import lake

    raw = [(e, "r1", "p1", f"lab{e % 5}", "2024-01-01", "TSH", "2.500", "mIU/L", "0.4 - 4.0", None) for e in (9, 3, 7, 5)]
    for parts in (1, 4):
        rows = spark.createDataFrame(raw if parts == 1 else raw[::-1], "event_id long, " + ", ".join(f"{c} string" for c in lake.LAB_COLUMNS)).repartition(parts)
        made = lake.converted(rows)
        found = lake.flagged(made, quality.population_stats(made, where=lake.plausible()), ties=("event_id",))
        assert [r.event_id for r in found.orderBy("dup_rank").collect()] == [3, 5, 7, 9]
