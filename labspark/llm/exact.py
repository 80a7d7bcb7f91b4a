"""Exact dedup by composable polynomial fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import SPACE, durable, row_slices, text_array, text_buffer

#: Two primes below 2**31 and a base for each; products of residues fit in 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (1298374651, 918273645)
#: Bytes hashed at a time; a sum of so many products of a byte and a residue stays below 2**63.
CHUNK = 1 << 16
#: Rows and bytes of texts taken at a time (a longer text is taken alone); bounds the copies of texts that a task holds.
ROWS, BYTES = 1024, 1 << 22
#: Most bits of an address in the table that says which fingerprints may occur more than once: 16 MB at most.
REPEAT_BITS = 27


def _descending(base: int, prime: int) -> np.ndarray:
    out, x = np.empty(CHUNK, np.int64), 1
    for i in range(CHUNK - 1, -1, -1):
        out[i], x = x, x * base % prime
    return out


_POWERS = tuple(_descending(b, p) for b, p in zip(BASES, PRIMES, strict=True))


def chunk_hash(chunk: bytes) -> tuple[int, int, int]:
    """Length and two residues of at most CHUNK bytes."""
    values, n = np.frombuffer(chunk, np.uint8).astype(np.int64), len(chunk)
    return n, *(int(values @ w[CHUNK - n :]) % p for w, p in zip(_POWERS, PRIMES, strict=True))


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """The hash of two adjoining pieces: the left one is shifted by the length of the right one."""
    return left[0] + right[0], *((h * pow(b, right[0], p) + g) % p for h, g, b, p in zip(left[1:], right[1:], BASES, PRIMES, strict=True))


def fingerprint(data: bytes) -> tuple[int, int]:
    """(length, 62-bit fingerprint) of a text of any length, from its chunks' hashes."""
    total = (0, 0, 0)
    for i in range(0, len(data), CHUNK):
        total = combine(total, chunk_hash(data[i : i + CHUNK]))
    return total[0], total[1] << 31 | total[2]


def same_text(a: bytes, b: bytes) -> bool:
    """Chunkwise comparison; stops at the first chunk that differs."""
    return len(a) == len(b) and all(a[i : i + CHUNK] == b[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        texts = text_array(batch.column("text")).to_pylist()
        length, prints, digests = [], [], []
        for t in texts:
            data = t.encode("utf-8", "surrogatepass").translate(None, SPACE)
            n, f = fingerprint(data)
            length.append(n), prints.append(f), digests.append(hashlib.sha256(data).digest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.int64()), pa.array(length, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "n_chars", "print", "length", "sha"])


def _repeated(narrow: DataFrame) -> np.ndarray:
    """A bit for each value of a fingerprint's low bits, set where some (fingerprint, length) with that value occurs twice.

    Eight bits a row, up to 2**REPEAT_BITS, so at most 16 MB come to the driver.  Where more fingerprints repeat than it can tell apart, some texts are
    compared for nothing.
    """
    wide = min(REPEAT_BITS, max(15, narrow.count().bit_length() + 3))
    twice = narrow.groupBy("print", "length").count().where("count > 1").select((F.col("print").bitwiseAND(F.lit((1 << wide) - 1)) + 1).alias("at"))
    maps = twice.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(1 << (wide - 3), np.uint8)
    for m in maps:
        own = np.frombuffer(m.bits, np.uint8)
        out[(m.bucket - 1) * 4096 : (m.bucket - 1) * 4096 + len(own)] = own
    return out


def _first_of_each(repeated: np.ndarray):
    """The different texts of each slice of rows, once, of fingerprints that may repeat: copies are compared here, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            column = text_array(batch.column("text"))
            for a, b in row_slices(text_buffer(column)[1], BYTES):
                held: dict[tuple[int, int], list[bytes]] = {}
                for t in column.slice(a, b - a).to_pylist():
                    data = t.encode("utf-8", "surrogatepass").translate(None, SPACE)
                    n, f = fingerprint(data)
                    at = f & (8 * len(repeated) - 1)
                    if not repeated[at >> 3] >> (at & 7) & 1:
                        continue
                    known = held.setdefault((f, n), [])
                    if not any(same_text(data, k) for k in known):
                        known.append(data)
                rows = [(f, n, d) for (f, n), texts in held.items() for d in texts]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["print", "length", "data"])

    return run


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by fingerprint: the second and later different texts of one fingerprint, numbered from 1.

    Holds the different texts of the current fingerprint only: one, but for a collision.
    """
    key, known = None, []
    for batch in batches:
        out = []
        for f, n, d in zip(batch.column("print").to_pylist(), batch.column("length").to_pylist(), batch.column("data"), strict=True):
            data = d.as_py()
            if (f, n) != key:
                key, known = (f, n), [data]
            elif not any(same_text(data, k) for k in known):
                out.append((f, n, hashlib.sha256(data).digest(), len(known)))
                known.append(data)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.int32())], ["print", "length", "sha", "variant"])


def _members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_chars, sha, keep_id, best_chars, group_size of every row."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    narrow = durable(base.mapInArrow(_digests, "doc_id long, n_chars long, print long, length long, sha binary"))
    texts = base.select("text").mapInArrow(_first_of_each(_repeated(narrow)), "print long, length long, data binary")
    parted = texts.repartition(F.col("print"), F.col("length")).sortWithinPartitions("print", "length").mapInArrow(_differing, "print long, length long, sha binary, variant int")
    parted = parted.groupBy("print", "length", "sha").agg(F.min("variant").alias("variant"))
    members = narrow.join(parted, ["print", "length", "sha"], "left").withColumn("variant", F.coalesce("variant", F.lit(0)))
    key = ["print", "length", "variant"]
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("other")))  # the complement falls as the id rises, and has no overflow
    groups = members.groupBy(*key).agg(best.alias("best"), F.count("*").alias("group_size")).select(*key, F.bitwise_not("best.other").alias("keep_id"), F.col("best.n_chars").alias("best_chars"), "group_size")
    return members.join(groups, key).select("doc_id", "n_chars", "sha", "keep_id", "best_chars", "group_size")


_KEPT = "doc_id <=> keep_id and n_chars = best_chars"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty, and empty texts are equal.  Groups
    form on a 62-bit fingerprint composed from chunk hashes, and the length; then the texts of every fingerprint that occurs twice are
    compared chunk by chunk in a stream sorted by fingerprint, and those that differ part ways.  Of a group the row with the
    most code points in the original text stays, ties to the smallest doc_id (null ids last).  Repeated rows are copies of
    one another; rows that share the kept doc_id as well are all marked as kept.  Other columns are left out.
    An empty table gives no rows.  Copies are dropped within each batch before the comparison's shuffle, and the
    join back on the group is one that adaptive execution may split.
    """
    return _members(docs, id_col, text_col).select("doc_id", "keep_id", "group_size", F.expr(_KEPT).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each group of equal texts, all columns kept.

    The row that stays has the id and text of ``exact_groups``'s kept one; where several rows share both, the first by its other columns stays, so
    repeated rows, ids with several texts and null ids all leave one row a group.  Only such groups pass a window, which keeps a row a key before its shuffle.
    """
    winners = _members(docs, id_col, text_col).where(_KEPT).groupBy(F.col("doc_id").alias("_x_id"), F.col("sha").alias("_x_sha"), F.col("n_chars").alias("_x_chars")).agg(F.count("*").alias("_x_rows"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts = text_array(batch.column(text_col)).to_pylist()
            shas = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass").translate(None, SPACE)).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, shas, pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names, "_sha", "_chars"])

    texts = docs.withColumn(text_col, F.col(text_col).cast("string"))
    rows = texts.mapInArrow(marked, StructType([*texts.schema.fields, StructField("_sha", BinaryType()), StructField("_chars", LongType())]))
    found = rows.join(winners, rows[id_col].cast("long").eqNullSafe(F.col("_x_id")) & (F.col("_sha") == F.col("_x_sha")) & (F.col("_chars") == F.col("_x_chars")))
    first = Window.partitionBy("_sha").orderBy(F.to_json(F.struct(*docs.columns)))
    several = found.where("_x_rows > 1").withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    return found.where("_x_rows = 1").select(*docs.columns).unionByName(several.select(*docs.columns))
