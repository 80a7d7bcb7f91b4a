"""Documents that fail as rows of a batch; numbers of a text against its report's own facts."""

import re

from pyspark.sql import functions as F

from labspark.operators import reports, text
from labspark.plans import text_queries
from labspark.sources import io


def test_one_bad_document_does_not_stop_the_batch(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "good.txt").write_text("Report\nTSH    2.5    mIU/L    0.40 - 4.00\nFerritin    31    ug/L\n")
    (folder / "binary.pdf").write_bytes(b"\x89PNG\xff\xfe")
    (folder / "blank.txt").write_text(" \n\t\n")
    (folder / "letter.txt").write_text("Dear patient,\nthank you.")
    documents = io.read_documents(spark, str(tmp_path / "in"))
    rows, done = text.ingest(documents)
    got = {r.report_id: (r.rows, r.error) for r in done.collect()}
    assert got == {"good": (2, None), "binary": (0, "not UTF-8 text"), "blank": (0, "no text"), "letter": (0, "no result rows")}
    assert {r.doc_id for r in rows.collect()} == {"good"} and all(len(r.sha256) == 64 for r in done.collect())
    good, bad = io.quarantined(done)
    assert (good.count(), bad.count()) == (1, 3)


def test_written_documents_come_back(spark, tmp_path):
    docs = spark.createDataFrame([("a b/c", "x\ny"), ("d", None), ("e", "é" * 1000)], "report_id string, body string")
    io.write_documents(docs, "report_id", "body", str(tmp_path / "out"))
    got = {r.report_id: (r.text, r.error) for r in io.read_documents(spark, str(tmp_path / "out"), io.FOLDER).collect()}
    assert {v for v in got.values()} == {("x\ny\n", None), (None, "no text"), ("é" * 1000 + "\n", None)}


def plain(summary, facts):
    number = re.compile(reports.NUMBER)
    allowed = set(number.findall(facts))
    for n in list(allowed):
        f = float(n)
        for form in (f"{f:.0f}", f"{f:.1f}", f"{f:.2f}", f"{f:.6f}", f"{f * 100:.0f}"):
            allowed |= {form, re.sub(r"\.?0+$", "", form) if "." in form else form}
    return sorted(set(number.findall(summary)) - allowed - {str(i) for i in range(101)})


def test_numbers_need_a_source_in_their_own_report(spark):
    facts = "struct<v: double, note: string, list: array<double>>"
    rows = spark.createDataFrame(
        [(1, "2.347 or 2.35 or 2.3 or 235", (2.347, "from 118", [140.5])), (2, "2.347 is another's, 118 and 140.50 too", (7.25, None, [])), (3, "140.5, 141, 140, 14050 and 100 of 100", (None, None, [140.5])), (4, None, (1.0, None, None)), (5, "500", None)],
        f"id int, s string, f {facts}",
    )
    got = {r.id: r.u for r in rows.select("id", reports.ungrounded(F.col("s"), F.col("f")).alias("u")).collect()}
    assert got == {1: [], 2: ["118", "140.50", "2.347"], 3: got[3], 4: [], 5: ["500"]}
    for r in rows.where("s is not null and f is not null").select("id", "s", F.to_json("f").alias("j")).collect():
        want = plain(r.s, r.j)
        assert set(got[r.id]) ^ set(want) <= {"140", "141"}, r.id  # a half is rounded up here, to the even number there


def test_summaries_hold_their_own_numbers_only(spark, sf_dir):
    for r in text_queries.g4_number_grounding(spark, sf_dir).collect():
        assert r.ungrounded == "" and r.planted == "123456.75"


def test_interpretation_is_whole(spark, sf_dir):
    rows = text_queries.l4_interpretation(spark, sf_dir).collect()
    assert rows and all(r.bands > 0 and r.questions > 0 and r.summary_length > 0 for r in rows)
    assert {r.risk_level for r in rows} <= {"low", "moderate", "elevated", None} and any(r.cluster is not None for r in rows) and any(r.escalation is not None for r in rows)


def test_labels_that_hold_values_are_not_matched_again(spark, monkeypatch):
    """Of lines whose first label has a marker, only that label is matched; a longer label wins where it is an alias itself or the first names none."""
    from labspark.operators import normalize, text

    asked, own = [], normalize.match_labels

    def counted(rows, column="raw_label", *more):
        asked.append(rows.select(column).distinct().count())
        return own(rows, column, *more)

    monkeypatch.setattr(normalize, "match_labels", counted)
    plain = [("a", n, f"TSH    {n}.{n:03d}    mIU/L    0.40 - 4.00") for n in range(200)]
    odd = [("b", 1, "Vitamin D 25 OH    31.5    ng/mL    30 - 100"), ("b", 2, "Notes 5 TSH    2.5"), ("b", 3, None), ("b", 4, "7 TSH 2.5"), ("b", 5, "Ferritn 88 ng/mL 3")]
    rows = text.parse_lines(spark.createDataFrame(plain + odd, "doc_id string, line_no long, line string")).collect()
    assert sum(asked) < 20
    found = {(r.doc_id, r.line_no): (r.marker, r.label, r.value) for r in rows}
    assert {found[("a", n)] for n in range(200)} == {("TSH", "TSH", f"{n}.{n:03d}") for n in range(200)}
    assert {k[1]: v for k, v in found.items() if k[0] == "b"} == {1: ("VITD", "Vitamin D 25 OH", "31.5"), 5: ("FERRITIN", "Ferritn", "88")}


def test_rows_of_issues_are_written_once(spark, sf_dir):
    """The statistics' passes, the findings and the rollup read written rows, not the events again."""
    from labspark.plans import lake_queries

    for df in lake_queries._issues(spark, sf_dir):
        assert "FileScan parquet" not in df._jdf.queryExecution().toString()


def test_documents_on_a_disk_start_no_processes(spark, tmp_path):
    """Folders are named as Spark names them, rows of one key share a file, and no checksum files (each with a process for its rights) are written."""
    docs = spark.createDataFrame([("a b/c", "x\ny"), ("d=%e'[1]^{", "z"), (None, "no key"), ("twice", "one"), ("twice", "two"), ("", "empty"), ("blank", "")], "report_id string, body string")
    io.write_documents(docs, "report_id", "body", str(tmp_path / "own"))
    docs.selectExpr("report_id", "body as value").repartition("report_id").write.partitionBy("report_id").text(str(tmp_path / "sparks"))
    folders = {n: sorted(p.name for p in (tmp_path / n).iterdir() if p.is_dir()) for n in ("own", "sparks")}
    assert folders["own"] == folders["sparks"] and not list((tmp_path / "own").rglob(".*"))
    own, sparks = ({r.report_id: sorted(r.text.split("\n")) for r in io.read_documents(spark, str(tmp_path / n), io.FOLDER).where("error is null").collect()} for n in ("own", "sparks"))
    assert own == sparks and own["twice"] == ["", "one", "two"] and len(own) == 4


def test_files_of_documents_are_read_once(spark, tmp_path):
    """Lines and outcomes read written rows, not the files again."""
    for n in range(200):
        (tmp_path / f"good{n}.txt").write_text("TSH    2.5    mIU/L    0.40 - 4.00\n")
    documents = io.read_documents(spark, str(tmp_path))
    assert documents.rdd.getNumPartitions() == 1 and documents.count() == 200
    for df in text.ingest(documents):
        assert "binaryFile" not in df._jdf.queryExecution().toString()


def test_interpretation_leaves_no_part_of_the_analytics_out(spark, sf_dir, monkeypatch):
    """All three targets, trees up to their early stop, the whole range of cluster numbers, and drivers where a risk is given."""
    from labspark.operators import boosting, cluster

    asked, fitted, plain, grow = [], {}, cluster.choose_kmeans, boosting.fit

    def chosen(*args, **more):
        model, scored = plain(*args, **more)
        asked.extend(k for k, _ in scored)
        return model, scored

    def fit(rows, columns, labels, **more):
        fitted.update(grow(rows, columns, labels, **more))
        return {t: fitted[t] for t in labels}

    monkeypatch.setattr(cluster, "choose_kmeans", chosen)
    monkeypatch.setattr(boosting, "fit", fit)
    rows = text_queries.l4_interpretation(spark, sf_dir).collect()
    assert asked == list(range(3, 10)) and set(fitted) == {"fatigue", "brain_fog", "hair_loss"}
    for model in fitted.values():
        assert len(model.losses) - 1 - len(model.trees) == 50 or len(model.losses) == 1501 or not model.losses
    known = [r for r in rows if r.cluster is not None]
    assert known and all(r.risks == 3 for r in known) and all(r.risks == 0 for r in rows if r.cluster is None)
    for r in rows:
        assert (r.risk_level is None) == (r.brain_fog_level is None) == (r.hair_loss_level is None) and (r.risk_level is not None or not r.drivers)
        assert (r.drivers or 0) <= 9
