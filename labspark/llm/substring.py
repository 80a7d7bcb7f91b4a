"""Substring dedup: Rabin-Karp hashes of every fixed-length word window."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, SLICE_BYTES, bucket_bits, bucket_cuts, flagged, flags_table, mix, ordered_chunks, powers, row_slices, text_array, text_buffer

#: Bytes of text in a chunk, the unit that finds its own repeats before anything is shuffled.
CHUNK_BYTES = 12 << 20
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and how many words lie before each row (one entry more than rows)."""
    inside = ~_IS_SPACE[data]
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of each run of ``length`` values, modulo 2**64, scrambled."""
    if len(values) < length:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=total[1:])
    count = len(values) - length + 1
    return mix((total[length:] - total[:count]) * powers(BASE_INVERSE, count))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def _long_row(data: np.ndarray, length: int, limit: int) -> tuple[np.ndarray, int]:
    """Window hashes and the number of words of one long text, taken in pieces that end between words."""
    hashes, words, last, start = [], 0, np.zeros(0, np.uint64), 0
    while start < len(data):
        stop = min(start + limit, len(data))
        while stop < len(data) and not _IS_SPACE[data[stop]]:
            stop += 1
        piece = data[start:stop]
        begins, ends, _ = word_spans(piece, np.array([0, len(piece)]))
        values = np.concatenate((last, word_hashes(piece, begins, ends)))
        hashes.append(rolling(values, length))
        words, last, start = words + len(begins), values[max(0, len(values) - length + 1) :], stop
    return np.concatenate(hashes), words


def windows(texts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window of ``length`` words of each text; its row; and the number of words of each row."""
    data, offsets = text_buffer(texts)
    hashes, rows, counts = [], [], []
    for a, b in row_slices(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) > 2 * SLICE_BYTES:  # a single row
            h, n = _long_row(part, length, SLICE_BYTES)
            hashes.append(h), rows.append(np.full(len(h), a)), counts.append(np.array([n]))
            continue
        starts, ends, first = word_spans(part, own)
        each = np.diff(first)
        counts.append(each)
        h = rolling(word_hashes(part, starts, ends), length)
        row = np.repeat(np.arange(a, b), each)
        same = row[: len(h)] == row[length - 1 :] if len(h) else np.zeros(0, bool)
        hashes.append(h[same]), rows.append(row[: len(h)][same])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(hashes, np.uint64), join(rows, np.int64), join(counts, np.int64)


#: What windows are compared by once their hashes have met: 96 bits of an XXH3 digest of their words.
DIGEST = np.dtype("S12")


def digests(text: str, at: np.ndarray, length: int) -> np.ndarray:
    """Digests of the windows of ``length`` words of ``text`` that start at the words ``at``, from the words themselves."""
    words = text.encode("utf-8", "surrogatepass").split()
    joined, digest = b" ".join(words), xxhash.xxh3_128_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends))[at].tolist()
    return np.frombuffer(b"".join([digest(joined[a:b])[:12] for a, b in zip(starts, (ends[at + length - 1] - 1).tolist(), strict=True)]), DIGEST)


def tops(values: np.ndarray) -> np.ndarray:
    """The first 64 bits of digests."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 12)[:, :8]).view(">u8").ravel().astype(np.uint64)


class Chunk:
    """The rows of one chunk in order, and their windows."""

    def __init__(self, rows: pa.Table, length: int) -> None:
        rows = rows.select(["doc_id", "text", "tie"]).sort_by([("doc_id", "ascending"), ("tie", "ascending")])
        ids = rows.column("doc_id").combine_chunks()
        self.ids, self.length = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids, length
        self.texts = text_array(rows.column("text"))
        self.hashes, self.row, self.counts = windows(self.texts, length)
        values, ties = self.ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), rows.column("tie").to_numpy()
        new = (np.diff(values) != 0) | (self.ids.is_null().to_numpy(zero_copy_only=False)[1:] & (np.diff(ties) != 0)) if len(values) else values
        #: Number of each row's document: rows of one id are one, and so are rows without an id that have equal texts.
        self.document = np.concatenate(([0], np.cumsum(new))) if len(values) else values

    def distinct(self) -> np.ndarray:
        return np.unique(self.hashes)

    def met(self, bits: int, back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose hash other chunks have too, by what came ``back``, and those whose hash is in several documents here."""
        values, inverse = np.unique(self.hashes, return_inverse=True)
        elsewhere = flagged(values, bits, back)[inverse]
        if not len(values):
            return elsewhere, elsewhere
        own = self.document[self.row]
        least, most = np.full(len(values), len(self.texts)), np.full(len(values), -1)
        np.minimum.at(least, inverse, own)
        np.maximum.at(most, inverse, own)
        return elsewhere, (least < most)[inverse]

    def digests(self, of: np.ndarray) -> np.ndarray:
        """Digests of the windows ``of`` (rising numbers)."""
        per_row = np.maximum(self.counts - self.length + 1, 0)
        first = np.cumsum(per_row) - per_row
        row = self.row[of]
        cuts = np.flatnonzero(np.diff(row)) + 1
        parts = [digests(self.texts[int(self.row[own[0]])].as_py(), own - first[self.row[own[0]]], self.length) for own in np.split(of, cuts) if len(own)]
        return np.concatenate(parts) if parts else np.zeros(0, DIGEST)


def _occurrences(sent: DataFrame, kind: np.dtype, lower: bool) -> DataFrame:
    """From rows bucket, chunk, values (sorted, each once a chunk): chunk, bucket, bits of those that any other chunk has, or, with ``lower``, that a lower chunk has.

    A value comes once from a chunk, however often the chunk has it, so the most frequent one gives a bucket no more rows than there are chunks.
    """

    def run(bucket: pa.Table) -> pa.Table:
        chunks = bucket.column("chunk").to_numpy()
        order = np.argsort(chunks, kind="stable")
        parts = [np.frombuffer(bucket.column("values")[int(k)].as_buffer(), kind) for k in order]
        values = np.concatenate(parts)
        by = np.argsort(values, kind="stable")
        again = values[by][1:] == values[by][:-1]
        hit = np.zeros(len(values), bool)
        hit[by[1:][again]] = True
        if not lower:
            hit[by[:-1][again]] = True
        ends = np.cumsum([len(p) for p in parts])
        number = bucket.column("bucket")[0].as_py()
        return flags_table(chunks[order].tolist(), [number] * len(parts), np.split(hit, ends[:-1]))

    return sent.groupBy("bucket").applyInArrow(run, "chunk int, bucket int, bits binary")


def _sent(chunk: int, values: np.ndarray, places: np.ndarray, bits: int) -> pa.Table:
    out = [(k, values[a:b].tobytes()) for k, a, b in bucket_cuts(places, bits)]
    return pa.table({"bucket": pa.array([k for k, _ in out], pa.int32()), "chunk": pa.array([chunk] * len(out), pa.int32()), "values": pa.array([v for _, v in out], pa.binary())})


def covered(first: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of ``size`` places lie in a window of ``length`` that starts at one of ``first``."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + length, size), -1)
    return np.cumsum(edge[:-1]) > 0


_RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start: int, end: int>>, kept_sha256 string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans (maximal removed runs of words), kept_sha256 and,
    on demand, kept_text.

    A word goes if a window of ``length`` consecutive words covers it whose word sequence also starts in a document with a smaller
    doc_id, judged on the input.  Words are runs of other than ASCII white space, unchanged; null texts have none; a text shorter than a
    window loses nothing.  Rows of one doc_id don't remove each other's words; rows without an id come last, by a hash of their text, and equal
    ones among them count as one document.  Other columns are left out; an empty table gives no rows.

    Documents go to chunks by rising doc_id.  A chunk sends each of its window hashes once, by hash, and learns which of them other chunks have; of those windows
    only, and of hashes that several of its own documents share, digests of the words decide: 96 bits of another hash function, sent likewise.
    """
    chunked, count = ordered_chunks(docs, id_col, text_col, CHUNK_BYTES)
    bits = bucket_bits(count)

    def send(rows: pa.Table) -> pa.Table:
        values = Chunk(rows, length).distinct()
        return _sent(rows.column("chunk")[0].as_py(), values, values, bits)

    def verify(rows: pa.Table, back: pa.Table) -> pa.Table:
        if not rows.num_rows or not back.num_rows:
            return _sent(0, np.zeros(0, DIGEST), np.zeros(0, np.uint64), bits)
        own = Chunk(rows, length)
        elsewhere, _ = own.met(bits, back)
        values = np.unique(own.digests(np.flatnonzero(elsewhere)))
        return _sent(rows.column("chunk")[0].as_py(), values, tops(values), bits)

    def settle(rows: pa.Table, back: pa.Table) -> pa.Table:
        own = Chunk(rows, length)
        second = back.column("verified").to_numpy(zero_copy_only=False).astype(bool)
        elsewhere, here = own.met(bits, back.filter(pa.array(~second)))
        of = np.flatnonzero(elsewhere | here)
        gone = np.zeros(len(own.hashes), bool)
        if len(of):
            values, inverse = np.unique(own.digests(of), return_inverse=True)
            document = own.document[own.row[of]]
            least = np.full(len(values), len(own.texts))
            np.minimum.at(least, inverse, document)
            sent = np.zeros(len(values), bool)
            sent[inverse[elsewhere[of]]] = True
            before = np.zeros(len(values), bool)
            before[sent] = flagged(tops(values[sent]), bits, back.filter(pa.array(second)))
            gone[of] = (document > least[inverse]) | before[inverse]
        texts, counts = own.texts, own.counts
        per_row = np.maximum(counts - length + 1, 0)
        ends = np.cumsum(per_row)
        removed, spans, hexes, kept = [], [], [], []
        for i in range(len(texts)):
            part = gone[ends[i] - per_row[i] : ends[i]]
            words = texts[i].as_py().encode("utf-8", "surrogatepass").split()
            if part.any():
                cover = covered(np.flatnonzero(part), len(words), length)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], cover.astype(np.int8), [0])))).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                removed.append(int(cover.sum()))
                words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
            else:
                spans.append([]), removed.append(0)
            text = b" ".join(words)
            hexes.append(hashlib.sha256(text).hexdigest())
            if keep_text:
                kept.append(text.decode("utf-8", "surrogatepass"))
        columns = {"doc_id": own.ids, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "kept_sha256": pa.array(hexes, pa.string())}
        return pa.table(columns | ({"kept_text": pa.array(kept, pa.string())} if keep_text else {}))

    groups = chunked.groupBy("chunk")
    met = _occurrences(groups.applyInArrow(send, "bucket int, chunk int, values binary"), np.dtype(np.uint64), False)
    verified = _occurrences(groups.cogroup(met.groupBy("chunk")).applyInArrow(verify, "bucket int, chunk int, values binary"), DIGEST, True)
    back = met.withColumn("verified", F.lit(False)).union(verified.withColumn("verified", F.lit(True)))
    return groups.cogroup(back.groupBy("chunk")).applyInArrow(settle, _RESULT + ", kept_text string" * keep_text)
