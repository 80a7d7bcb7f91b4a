"""Streaming forms of the lake (M1 to M6).  Each takes a streaming DataFrame and returns one, or starts a query into a sink."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import catalog, schemas
from ..operators import graph, lake


def lab_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New result files (JSON lines) with event time ``at``."""
    return spark.readStream.schema(schemas.LAB).option("maxFilesPerTrigger", files_per_trigger).json(folder).withColumn("at", F.col("collected_at").try_cast("timestamp"))


def normalised(stream: DataFrame, labels: DataFrame) -> DataFrame:
    """M1: the batch operators on a stream; ``labels`` is the label map of ``match_labels``, a static table."""
    return lake.converted(stream, labels)


def first_arrivals(stream: DataFrame, keys: list[str], at: str = "at", delay: str = "1 day") -> DataFrame:
    """M2: repeated keys within the watermark are dropped; state holds a key for ``delay`` only."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def volumes(stream: DataFrame, source: str = "lab_provider", at: str = "at", width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """M6: rows and implausible ones per source and window."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), source).agg(F.count("*").alias("rows"), F.count_if(~lake.plausible()).alias("implausible"))


def alerts(stream: DataFrame) -> DataFrame:
    """M5: rows that trigger an escalation rule, joined with the static rules."""
    rules = catalog.escalation_rules(stream.sparkSession).withColumnRenamed("reason", "rule_reason")
    return graph.triggered(stream, rules, value="value_si").select("report_id", "patient_id", "marker", "value_si", "level", "rule_reason")


class LatestRow(StatefulProcessor):
    """Keeps a key's latest row as value state and gives it out whenever it changes."""

    def __init__(self, fields: list[str], schema: str, order: tuple[str, ...], ttl_ms: int | None):
        self._fields, self._schema, self._order, self._ttl = fields, schema, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._latest = handle.getValueState("latest", self._schema, self._ttl) if self._ttl else handle.getValueState("latest", self._schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        place = lambda r: tuple((r[c] is not None, r[c]) for c in self._order)
        known = self._latest.get() if self._latest.exists() else None
        kept = None if known is None else dict(zip(self._fields, known, strict=True))
        changed = False
        for row in rows:
            own = row.asDict()
            if kept is None or place(own) > place(kept):
                kept, changed = own, True
        if changed:
            self._latest.update(tuple(kept[c] for c in self._fields))
            yield Row(**{c: kept[c] for c in self._fields})

    def close(self) -> None:
        pass


class Status(StatefulProcessor):
    """Keeps a report's status, the time of its last event and the number of changes; a repeated or older event changes nothing.

    With ``stale_ms`` a timer of event time says once that a report has had no event for so long.
    """

    def __init__(self, key: str, at: str, status: str, stale_ms: int | None):
        self._key, self._at, self._status, self._stale = key, at, status, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("status", "status string, at string, changes long")

    def _row(self, key, status: str, at: str, changes: int) -> Row:
        return Row(**{self._key: key[0], "status": status, "at": at, "changes": changes})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        status, at, changes = self._state.get() if self._state.exists() else (None, None, 0)
        before = changes
        for own in sorted({(str(r[self._at]), r[self._status]) for r in rows if r[self._at] is not None and r[self._status] is not None}):
            if at is None or own > (at, status):
                changes += status != own[1]
                at, status = own
        if changes == before:
            return
        self._state.update((status, at, changes))
        if self._stale:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            due = datetime.fromisoformat(at).replace(tzinfo=timezone.utc)
            self._handle.registerTimer(int(due.timestamp() * 1000) + self._stale)
        yield self._row(key, status, at, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        status, at, changes = self._state.get()
        self._state.update(("stale", at, changes + 1))
        yield self._row(key, "stale", at, changes + 1)

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that ``transformWithState`` needs, for queries that start within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def latest_changes(stream: DataFrame, key: str = "patient_id", order: tuple[str, ...] = ("collected_at", "report_id"), ttl_ms: int | None = None) -> DataFrame:
    """M3: a key's latest row, each time that a later one comes; only the keys of a batch are touched.  Keys that are quiet for ``ttl_ms`` are forgotten."""
    schema = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)
    return stream.groupBy(key).transformWithState(LatestRow(stream.columns, schema, order, ttl_ms), schema, "update", "processingTime" if ttl_ms else "none")


def status_changes(stream: DataFrame, key: str = "report_id", at: str = "at", status: str = "status", stale_ms: int | None = None) -> DataFrame:
    """M4: the status of an id (columns key, status, at, changes) each time that it changes, latest event first, ties in time to the later name.

    A repeated event applies once; ids without events have no row, so an unknown id is not a queued one.  On a stream with a
    watermark and with ``stale_ms``, an id without events for so long becomes stale.
    """
    kind = dict(stream.dtypes)[key]
    schema = f"`{key}` {kind}, status string, at string, changes bigint"
    return stream.groupBy(key).transformWithState(Status(key, at, status, stale_ms), schema, "update", "eventTime" if stale_ms else "none")


def upsert(changes: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes each batch of changes to a folder of its own, which a repeated batch overwrites; ``snapshot`` reads the table they make up."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with keyed_state(changes.sparkSession):
        writer = changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def snapshot(spark: SparkSession, path: str, key: str, order: tuple[str, ...]) -> DataFrame:
    """The latest row of each key in a table of changes; within a batch a key has one row."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order, "batch")).alias("r")).select("r.*")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Processes what is there into Parquet, then stops."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_once(stream: DataFrame, path: str, checkpoint: str):
    """Like ``run_once`` for aggregations without a watermark: each batch overwrites the table with the whole result."""
    return stream.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
