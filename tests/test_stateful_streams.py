"""Keyed state of the streams: a batch touches its own keys, a repeated event applies once, a restart goes on."""

from pyspark.sql import functions as F

from labspark.streaming import streams


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def test_latest_rows_and_restart(spark, tmp_path):
    schema = "patient_id string, collected_at string, report_id string"
    folder, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))

    def run():
        stream = spark.readStream.schema(schema).json(folder)
        streams.upsert(streams.latest_changes(stream), out, state).awaitTermination()

    put(spark, [("a", "2024-01-02", "r1"), ("a", "2024-01-01", "r0"), ("b", "2024-01-01", "r2"), ("c", None, "r3")], schema, folder)
    run()
    put(spark, [("a", "2024-01-01", "late"), ("b", "2024-02-01", "r4"), ("c", "2024-01-01", "r5"), ("b", "2024-02-01", "r4")], schema, folder)
    run()  # from the checkpoint
    run()  # nothing new
    second = spark.read.parquet(out).where("batch = 1")
    assert {r.patient_id for r in second.collect()} == {"b", "c"}  # the late row of a changes nothing
    got = {r.patient_id: r.report_id for r in streams.snapshot(spark, out, "patient_id", ("collected_at", "report_id")).collect()}
    assert got == {"a": "r1", "b": "r4", "c": "r5"}


def test_status_applies_once(spark, tmp_path):
    schema = "report_id long, happened string, status string"
    folder, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    for rows in ([(1, "2024-01-01 10:00:00", "processing"), (1, "2024-01-01 10:00:00", "processing"), (2, "2024-01-01 10:00:00", "processing"), (3, None, "failed")], [(1, "2024-01-01 10:00:00", "processing"), (2, "2024-01-02 10:00:00", "failed"), (2, "2024-01-01 12:00:00", "pending_review")]):
        put(spark, rows, schema, folder)
        stream = spark.readStream.schema(schema).json(folder)
        streams.upsert(streams.status_changes(stream, at="happened"), out, state).awaitTermination()
    got = {r.report_id: (r.status, r.changes) for r in streams.snapshot(spark, out, "report_id", ("at", "changes")).collect()}
    assert got == {1: ("processing", 1), 2: ("failed", 3)}
    assert {r.report_id for r in spark.read.parquet(out).where("batch = 1").collect()} == {2}


def test_quiet_reports_become_stale(spark, tmp_path):
    schema = "report_id long, happened string, status string"
    folder, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    for rows in ([(1, "2024-01-01 10:00:00", "processing")], [(2, "2024-03-01 10:00:00", "processing")], [(3, "2024-03-02 10:00:00", "processing")]):
        put(spark, rows, schema, folder)
        stream = spark.readStream.schema(schema).json(folder).withColumn("t", F.to_timestamp("happened")).withWatermark("t", "1 hour")
        streams.upsert(streams.status_changes(stream, at="happened", stale_ms=24 * 3_600_000), out, state).awaitTermination()
    got = {r.report_id: r.status for r in streams.snapshot(spark, out, "report_id", ("at", "changes")).collect()}
    assert got[1] == "stale" and got[3] == "processing"
