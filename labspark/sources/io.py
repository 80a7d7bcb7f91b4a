"""Readers and sinks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog, schemas


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once into the session's checkpoint folder (``spark.checkpoint.dir``), where every executor can read it.

    Where the session names none, a local session takes a temporary folder; on a cluster, whose executors could not read that, this raises.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="labspark-checkpoint-"))
    return df.checkpoint()


def packed(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df`` in no more partitions than ``rows`` fill with ``each``: for tables that many passes read, whose tasks would be too small."""
    return df.coalesce(max(1, -(-rows // each)))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints."""
    durable(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read_lab_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """A1: text columns, never inferred; a source with other columns or order is read by its own header and joined by name."""
    out = None
    for p in paths:
        df = spark.read.option("header", True).csv(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_lab_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A2."""
    return spark.read.schema(schemas.LAB).json(path)


def read_intake(spark: SparkSession, path: str) -> DataFrame:
    """A3: nested answers, all as text."""
    return spark.read.schema(schemas.INTAKE).json(path)


def read_zone(spark: SparkSession, path: str) -> DataFrame:
    """A4: partitioned Parquet."""
    return spark.read.parquet(path)


def write_zone(df: DataFrame, path: str, *partition_by: str) -> None:
    """Overwritten Parquet.  Rebalancing by the partition columns bounds the files of each partition and still splits large ones."""
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_audit(audit: DataFrame, stats: DataFrame, summary: DataFrame, path: str) -> None:
    """The audit as CSV, statistics and summary as JSON; small tables, one file each."""
    audit.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/audit")
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/population_stats")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


#: The id of a document: its file's stem, or the value of the partition folder that it lies in.
STEM, FOLDER = r"([^/]+?)(?:\.[^./]*)?$", r"/[^/=]+=([^/]+)/[^/]*$"
#: Documents, or bytes of them, that a task reads.
FILES, BYTES = 500, 1 << 26


def scan_documents(spark: SparkSession, path: str, named_by: str = STEM, content: bool = False) -> DataFrame:
    """Id, path, size and digest of whole files, and their bytes if asked for.  Spark reads them, so any store will do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", named_by, 1).alias("report_id"), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), *(["content"] if content else []))


def read_documents(spark: SparkSession, path: str, named_by: str = STEM) -> DataFrame:
    """report_id, path, bytes, sha256, text and error of every file; a file that is not text, or holds none, has its reason as error and no text.

    Nothing a file holds stops the batch; only a store that can't be read does.  Files of no bytes are skipped by the reader and have no row.
    The reader gives a task some 32 small files; here it gets ``FILES`` of them or ``BYTES``, as tasks and the files they write cost more than the reading.
    """
    files = scan_documents(spark, path, named_by, content=True)
    found = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()  # of the listing; no file is opened
    files = files.coalesce(max(1, -(-found.files // FILES), -(-found.bytes // BYTES)))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    error = F.when(text.isNull(), "not UTF-8 text").when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", "no text")
    return files.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), text)).drop("content")


#: What Spark writes for a key in a folder's name: these characters as % and two digits, no key as a fixed name.
_ESCAPED, _NO_KEY = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]"), "__HIVE_DEFAULT_PARTITION__"


def _files_of(root: str, name: str):
    """A function for ``mapInArrow``: rows (key as text, value), equal keys together, into a file a key; yields the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, current, out, hidden = 0, object(), None, ""
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", key) if key else _NO_KEY
                if folder != current:
                    if out:
                        out.close()
                        os.replace(hidden, os.path.join(os.path.dirname(hidden), "document.txt"))
                    own = os.path.join(root, f"{name}={folder}")
                    os.makedirs(own, exist_ok=True)
                    hidden = os.path.join(own, f".{uuid.uuid4().hex}")  # a task that fails leaves no file that readers see
                    out, current, files = open(hidden, "wb"), folder, files + 1  # noqa: SIM115
                out.write(value.encode() if isinstance(value, str) else value)
                out.write(b"\n")
        if out:
            out.close()
            os.replace(hidden, os.path.join(os.path.dirname(hidden), "document.txt"))
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    return run


def write_documents(docs: DataFrame, key: str, text: str, path: str) -> None:
    """One text file a document, in a folder named by its key (``FOLDER`` reads it back); a line break ends each file.

    In other stores Spark's writer makes the files.  On a disk it would start processes for the rights of each file, its checksum file and its folder, so
    there the tasks write the files themselves; every executor must see that disk, as for Spark's writer.
    """
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("value")).repartition(key)
    spark = docs.sparkSession
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toUri()
    if root.getScheme() != "file":
        rows.write.partitionBy(key).text(path)
        return
    if os.path.exists(root.getPath()):
        raise FileExistsError(path)
    os.makedirs(root.getPath())
    named_ = rows.select(F.col(key).cast("string").alias("key"), F.col("value").cast("binary").alias("value")).sortWithinPartitions("key")
    named_.mapInArrow(_files_of(root.getPath(), key), "files bigint").agg(F.sum("files")).collect()


def named(df: DataFrame, view: str, keep: bool = False) -> DataFrame:
    """A10: a temporary view, persisted on demand; ``unpersist`` it when done."""
    df = df.persist() if keep else df
    df.createOrReplaceTempView(view)
    return df


def stamped(df: DataFrame) -> DataFrame:
    """Provenance columns."""
    return df.withColumns({"pipeline_version": F.lit(catalog.PIPELINE), "catalog_version": F.lit(catalog.VERSION), "data_label": F.lit(catalog.LABEL)})


def manifest(spark: SparkSession, folder: str, fingerprint: str) -> DataFrame:
    """Path, kind, digest and size of every artifact file, with the catalog's version and the data's fingerprint."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return stamped(files.select("path", F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("kind"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))).withColumn("fingerprint", F.lit(fingerprint))


def unavailable(spark: SparkSession, manifest_: DataFrame, folder: str) -> DataFrame:
    """Listed artifacts that are gone, changed, or of another catalog version, with the reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha2("content", 256).alias("now"))
    reason = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed").when(F.col("catalog_version") != catalog.VERSION, "catalog version")
    return manifest_.join(files, "path", "left").withColumn("reason", reason).where("reason is not null").select("path", "reason")


def read_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A14."""
    return catalog.from_document(spark.read.schema(schemas.CATALOG).option("multiLine", True).json(path))


def front_matter(texts: DataFrame, text: str = "value") -> DataFrame:
    """``meta`` (map of the lines between leading --- marks) and ``body`` of whole Markdown texts; without marks no meta."""
    pattern = r"(?s)\A---\s*\n(.*?)\n---\s*\n?(.*)\z"
    head = F.regexp_extract(text, pattern, 1)
    lines = F.filter(F.split(head, "\n"), lambda line: line.contains(":"))
    entries = F.transform(lines, lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)).alias("k"), F.trim(F.trim(F.substr(line, F.instr(line, ":") + 1)), F.lit('"')).alias("v")))
    has = F.col(text).rlike(pattern)
    return texts.withColumns({"meta": F.map_from_entries(F.when(has, entries).otherwise(F.array().cast("array<struct<k:string,v:string>>"))), "body": F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(F.col(text))})


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their name, meta and body."""
    files = spark.read.text(path, wholetext=True).withColumn("source", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return front_matter(files).drop("value")


def quarantined(rows: DataFrame, reason: str = "error") -> tuple[DataFrame, DataFrame]:
    """I16: rows without and with an error."""
    return rows.where(F.col(reason).isNull()), rows.where(F.col(reason).isNotNull())
