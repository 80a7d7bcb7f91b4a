"""WARC archives: writing captures as transactions, and assembling them again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable

#: Payloads from this size on are stored once; later captures of them revisit the first.
REVISIT_BYTES = 1000
#: Records of an archive file, which is one row when read; captures of larger payloads have files of their own.
FILE_RECORDS, LARGE_BYTES = 600, 1 << 17
VERSION = "WARC/1.1"
_NAMESPACE = "urn:uuid:"


def _record_id(kind: str, capture: Column) -> Column:
    """A UUID-shaped id derived from the capture, so that recomputed tasks write the same records."""
    digest = F.md5(F.concat(F.lit(kind + "|"), capture))
    return F.concat(F.lit(f"<{_NAMESPACE}"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column | str, record_id: Column, block: Column, *headers: tuple[str, Column]) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit(f"{VERSION}\r\nWARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", codec: str = "gzip") -> None:
    """Writes a request, a response (or revisit) and a metadata record per row of ``pages`` as archive files under ``path``.

    The request and the metadata name the response in WARC-Concurrent-To.  Of equal payloads (null: empty) of at least ``REVISIT_BYTES`` bytes, the
    row with the largest id has the response; the others are revisits of it and carry no payload.  Spark's text writer makes
    the files, so that they may lie in any store.  Only ids and digests are shuffled to find equal payloads.
    A file holds at most 200 captures of up to ``LARGE_BYTES`` bytes, or a single larger one.  Repeated rows write equal records.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\r\n]", " ").alias("url"), payload.alias("payload"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).alias("size"))
    firsts = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    revisits = durable(rows.where(F.col("size") >= REVISIT_BYTES).select("page_id", "digest").join(firsts, "digest").where("page_id <> first").distinct())
    rows = rows.join(revisits, ["page_id", "digest"], "left")

    name = lambda page: F.concat(F.coalesce(page.cast("string"), F.lit("null")), F.lit("|"), "digest")
    rows = rows.withColumn("capture", name(F.col("page_id"))).withColumn("response_id", _record_id("response", F.col("capture")))
    original_id = F.when(F.col("first").isNotNull(), _record_id("response", name(F.col("first"))))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    target, http = ("WARC-Target-URI", F.col("url")), "application/http; msgtype="
    request = _record("request", _record_id("request", F.col("capture")), F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1\r\n\r\n")), target, ("WARC-Concurrent-To", F.col("response_id")), ("Content-Type", F.lit(http + "request")))
    response = _record(
        F.when(F.col("first").isNull(), F.lit("response")).otherwise(F.lit("revisit")), F.col("response_id"), F.when(F.col("first").isNull(), F.concat(head, "payload")).otherwise(head),
        target, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("WARC-Refers-To", original_id), ("WARC-Profile", F.when(F.col("first").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", F.lit(http + "response")),
    )
    fields = F.concat_ws("\r\n", F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.concat(F.lit("payloadLength: "), F.col("size").cast("string")), F.lit(""))
    metadata = _record("metadata", _record_id("metadata", F.col("capture")), fields, target, ("WARC-Concurrent-To", F.col("response_id")), ("Content-Type", F.lit("application/warc-fields")))
    records = rows.select("size", F.explode(F.array(request, response, metadata)).alias("value"))
    largest = pages.agg(F.max(F.octet_length(F.col(payload_col).cast("string")))).first()[0] or 0
    small = records.where(F.col("size") < LARGE_BYTES) if largest >= LARGE_BYTES else records
    for part, folder, count in ((small, "small", FILE_RECORDS), *([(records.where(F.col("size") >= LARGE_BYTES), "large", 3)] if largest >= LARGE_BYTES else [])):
        part.select("value").write.option("lineSep", "\r\n\r\n").option("compression", codec).option("maxRecordsPerFile", count).text(f"{path}/{folder}")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record; blocks are cut by Content-Length, so they may hold anything."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        begin = stop + 4
        at = begin + int(headers["content-length"])
        yield headers, data[begin:at]
        at += 4


_RECORD = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, fields map<string,string>, payload_bytes long, computed_digest string, payload binary"


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``; ``payloads``: with the HTTP payload."""
    import gzip
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("computed_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                data, out = content.as_py(), []
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                for h, block in parse_records(data):
                    kind, body, fields = h["warc-type"], None, None
                    if kind == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                    elif kind == "metadata":
                        fields = [(k, v.strip()) for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n") if line)]
                    out.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), fields, None if body is None else len(body), None if body is None else hashlib.sha1(body).hexdigest(), body if payloads else None))
                    if len(out) >= 100:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
                        out = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, target_uri, request, response, metadata.

    Request and metadata records join the response or revisit that their concurrent-to identifier names.  Captures without them
    have null there.
    """
    names = ["record_type", "record_id", "refers_to", "payload_digest", "payload_bytes", "computed_digest", "payload", *(["copies"] if "copies" in records.columns else [])]
    nested = F.struct(*names).alias("response")
    responses = records.where("record_type in ('response', 'revisit')").select(F.col("record_id").alias("id"), "target_uri", nested)
    requests = records.where("record_type = 'request'").select(F.col("concurrent_to").alias("id"), F.struct("record_id", "target_uri").alias("request"))
    metadata = records.where("record_type = 'metadata'").select(F.col("concurrent_to").alias("id"), F.struct("record_id", "fields").alias("metadata"))
    joined = responses.join(requests, "id", "left").join(metadata, "id", "left")
    return joined.select(F.col("metadata.fields")["pageId"].cast("long").alias("page_id"), "target_uri", "request", "response", "metadata")


def captures(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of ``pages`` after a round trip through
    archives under ``path`` (a new folder beside the session's checkpoints, if none is given).

    Sizes and digests of responses are those of the payload read back; revisits have what their records state: the digest, and
    the length in their metadata.  Null html is an empty payload.  Repeated rows (equal page_id and html) write records of equal ids, which are one
    transaction, and are returned as often as they are; rows without an id keep null.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    if path is None:
        durable(spark.range(1))
        path = f"{spark.sparkContext.getCheckpointDir()}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path)
    read = read_records(spark, path).drop("payload")
    # Equal records become one with a count, so that joins through their ids don't multiply them.
    records = durable(read.groupBy("record_id").agg(*((F.first if c == "fields" else F.min)(c).alias(c) for c in read.columns if c != "record_id"), F.count("*").alias("copies")))
    whole = assemble(records.withColumn("payload", F.lit(None).cast("binary")))
    names = records.where("record_type = 'metadata' and concurrent_to is not null").select(F.col("concurrent_to").alias("original_id"), F.col("fields")["pageId"].cast("long").alias("refers_to")).distinct()
    wanted = whole.where("response.refers_to is not null").select(F.col("response.refers_to").alias("original_id")).distinct()
    names = names.join(wanted, "original_id", "left_semi")
    # Responses refer to nothing; keys of their own keep them from meeting in one task.
    joined = whole.withColumn("original_id", F.coalesce("response.refers_to", F.concat(F.lit("none "), "response.record_id"))).join(names, "original_id", "left")
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("response.copies").cast("int"))))
    length = F.coalesce("response.payload_bytes", F.col("metadata.fields")["payloadLength"].cast("long"))
    digest = F.coalesce("response.computed_digest", F.regexp_replace("response.payload_digest", "^sha1:", ""))
    return joined.select("page_id", length.alias("payload_bytes"), digest.alias("payload_digest"), F.col("response.record_type").alias("record_type"), "refers_to")
