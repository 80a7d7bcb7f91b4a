"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable

#: ASCII white space of every word contract here: space and \x09 to \x0D.
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text that numpy kernels take at a time; bounds their working memory.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept where every executor can read it.

    Uses the folder of ``spark.checkpoint.dir``.  Where the session names none, a local session takes a temporary folder; on a cluster, whose
    executors could not read that, this raises.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="labspark-checkpoint-"))
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One Arrow array of text in which null has become the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a large_string array, and where each begins (one entry more than texts)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multiplier of the rolling hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


#: Cells that one task numbers.
CELLS = 1 << 16


def _cells(base: DataFrame, size: Column, target: int) -> tuple[list[int], list[DataFrame]]:
    """Cells of the id range that hold rows: the shift of each level, and its cells as (cell, first_id, bytes).

    A cell is the ids that agree but for their lowest ``shift`` bits.  Cells of more than ``target`` bytes are cut into smaller ones by a further pass over
    their rows, until none is too large or a cell is a single id; so outlying ids cost a pass or two and nothing overflows.
    """
    low, high = base.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [], []
    rows, shift, shifts, levels = base.where("doc_id is not null"), max(0, (high - low).bit_length() - 15), [], []
    while True:
        found = durable(rows.groupBy(F.shiftright("doc_id", shift).alias("cell")).agg(F.sum(size).alias("bytes")).withColumn("first_id", F.shiftleft("cell", shift)))
        heavy = (F.col("bytes") > target) & F.lit(shift > 0)
        n, most = found.where(heavy).agg(F.count("*"), F.max("bytes")).first()
        shifts.append(shift)
        levels.append(found.where(~heavy).select("cell", "first_id", "bytes"))
        if not n:
            return shifts, levels
        bits = min(shift, 12 if n <= 16 else int(np.ceil(np.log2(most / target))) + 1)
        parents = found.where(heavy).select(F.col("cell").alias("parent"))
        rows = rows.join(F.broadcast(parents) if n <= CELLS else parents, F.shiftright("doc_id", shift) == F.col("parent"), "left_semi")
        shift -= bits


def _numbered(levels: list[DataFrame], target: int, per_task: int) -> tuple[DataFrame, int, int]:
    """level, cell, chunk of all cells, their number, and the number of chunks.  Chunks are filled with whole cells in the order of their ids up to ``target`` bytes.

    Cells are dealt to tasks by ranges of ids; each task fills its own chunks, and the chunks of the tasks before go in front.  The driver gets a row a task of ``per_task`` cells.
    """
    spark = levels[0].sparkSession
    cells = levels[0].withColumn("level", F.lit(0))
    for k, own in enumerate(levels[1:], 1):
        cells = cells.unionByName(own.withColumn("level", F.lit(k)))
    n = cells.count()
    tasks = -(-n // per_task)
    dealt = cells.repartitionByRange(tasks, "first_id") if tasks > 1 else cells.coalesce(1)  # one task has ``per_task`` cells at most

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filled = 0, 0
        for batch in batches:
            chunk = []
            for z in batch.column("bytes").to_pylist():
                if filled and filled + z > target:
                    number, filled = number + 1, 0
                filled += z
                chunk.append(number)
            yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column("level"), batch.column("cell"), pa.array(chunk, pa.int64())], ["task", "level", "cell", "own"])

    ordered = dealt.sortWithinPartitions("first_id").select(F.spark_partition_id().alias("task"), "level", "cell", "bytes")
    filled = durable(ordered.mapInArrow(fill, "task int, level int, cell long, own long"))
    before, total = [], 0
    for task, last in filled.groupBy("task").agg(F.max("own")).orderBy("task").collect():
        before.append((task, total))
        total += last + 1
    if len(before) == 1:
        return filled.select("level", "cell", F.col("own").alias("chunk")), n, total
    offsets = F.broadcast(spark.createDataFrame(before, "task int, before long"))  # a row a task
    return filled.join(offsets, "task").select("level", "cell", (F.col("own") + F.col("before")).alias("chunk")), n, total


def ordered_chunks(docs: DataFrame, id_col: str, text_col: str, target_bytes: int, carry: tuple[str, ...] = (), per_task: int = CELLS) -> tuple[DataFrame, int]:
    """Columns doc_id, text, tie, chunk (and those of ``carry``), and the number of chunks.  ``chunk`` numbers ranges of rising doc_id of about ``target_bytes`` of text each.

    Equal ids share a chunk.  Rows without an id come after all others, in the order of ``tie``, a hash of the text, and fill as many chunks as they
    need.  (doc_id, tie) orders all rows alike whatever partitions they come in; rows equal in both have equal texts.  Cells and chunks are numbered in Spark,
    ``per_task`` cells a task; the table of cells is broadcast up to 2^18 of them, and joined by a shuffle beyond.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    shifts, levels = _cells(base.select("doc_id", "text"), size, target_bytes)
    known, n, count = _numbered(levels, target_bytes, per_task) if levels else (None, 0, 0)
    missing = base.where("doc_id is null").agg(F.sum(size)).first()[0] or 0
    bits = max(0, (missing // target_bytes).bit_length())
    last = F.lit(count) + (F.shiftright("tie", 64 - bits) + (1 << bits >> 1) if bits else 0)
    out, chunks = base.withColumn("tie", F.xxhash64("text")), [F.when(F.col("doc_id").isNull(), last)]
    for k, shift in enumerate(shifts):
        own = known.where(F.col("level") == k).select(F.col("cell").alias(f"cell_{k}"), F.col("chunk").alias(f"chunk_{k}"))
        out = out.withColumn(f"cell_{k}", F.shiftright("doc_id", shift)).join(F.broadcast(own) if n <= 1 << 18 else own, f"cell_{k}", "left")
        chunks.append(F.col(f"chunk_{k}"))
    return out.select("doc_id", "text", "tie", *carry, F.coalesce(*chunks).cast("int").alias("chunk")), count + ((1 << bits) if missing else 0)


def bucket_bits(chunks: int) -> int:
    """So many bits that there is a bucket for each chunk."""
    return max(0, int(chunks - 1).bit_length())


def bucket_cuts(values: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, stop) of sorted 64-bit values, cut where their top ``bits`` change."""
    if not len(values):
        return
    tops = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    cuts = (np.flatnonzero(np.diff(tops)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True):
        yield int(tops[a]), a, b


def flags_table(chunks: list[int], buckets: list[int], flags: list[np.ndarray]) -> pa.Table:
    """chunk, bucket, bits: a bit for each value that the chunk has sent to the bucket, in order; rows without any set bit are left out."""
    own = [(c, k, np.packbits(f).tobytes()) for c, k, f in zip(chunks, buckets, flags, strict=True) if f.any()]
    return pa.table({n: pa.array([r[i] for r in own], t) for i, (n, t) in enumerate((("chunk", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())))})


def flagged(values: np.ndarray, bits: int, back: pa.Table) -> np.ndarray:
    """Which of a chunk's sorted values have their bit set in the rows bucket, bits that came back."""
    sent = {k: (a, b) for k, a, b in bucket_cuts(values, bits)}
    out = np.zeros(len(values), bool)
    for k, packed in zip(back.column("bucket").to_pylist(), back.column("bits"), strict=True):
        a, b = sent[k]
        out[a:b] = np.unpackbits(np.frombuffer(packed.as_buffer(), np.uint8), count=b - a).astype(bool)
    return out
