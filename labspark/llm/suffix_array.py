"""Suffix-array dedup with a run-length compressed Burrows-Wheeler index."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, bucket_bits, mix, ordered_chunks, powers, row_slices, text_array, text_buffer

LENGTH = 100
#: Length of the seeds by which equal strings meet.
SEED = 20
CHUNK_BYTES = 4 << 20
#: Texts that are streamed through an index at a time.
TEXTS = 2048
#: Texts of a chunk are hashed so many bytes at a time.
PART = 1 << 18
#: Buckets for each chunk, as a power of two: an index is built over a few hundred kB.
MORE_BUCKETS = 2


# ---- the index -----------------------------------------------------------------------------------------------------


@dataclass
class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts that each end in a terminator of their own, with sampled run ends.

    ``symbol``: the symbol of each run of the transform (0: a terminator; these make runs of one row).
    ``head_sample``, ``tail_sample``: text places of the suffixes at each run's first and last row.
    ``head_match``: how many bytes the suffix one place before a run's head shares with the suffix above it in the order.

    Rows of a run keep their order one place further left, so the suffix above that of place p is one place left of that above p + 1, but where p + 1 is a
    run's head; there it is one place left of the tail of the last run before with the same symbol.  The samples hold these breaks, and everything between
    follows by counting: of any place the neighbours in the suffix order and how many bytes are shared with them.  Nothing of the texts' length is kept.
    """

    size: int
    symbol: np.ndarray
    head_sample: np.ndarray
    tail_sample: np.ndarray
    head_match: np.ndarray

    @classmethod
    def build(cls, data: np.ndarray, ends: np.ndarray) -> RunLengthIndex:
        """From texts laid end to end, each with one more place, at ``ends``, for its terminator."""
        n = len(data)
        symbols = data.astype(np.int64) + 1
        symbols[ends] = 0
        stop = np.repeat(ends, np.diff(np.concatenate(([-1], ends))))
        place = np.arange(n)

        # Sorts by 7 symbols, then doubles; terminators rank by their number, so no comparison goes past one.
        ahead = lambda k: np.minimum(place + k, stop)
        two = (symbols << 9) | symbols[ahead(1)]
        four = (two << 18) | two[ahead(2)]
        key = (four << 27) | (four[ahead(4)] >> 9)
        key[ends] = np.arange(len(ends)) - len(ends)
        rank, tied = cls._ranked(key, np.zeros(n, np.int64), place)
        depth = 7
        while len(tied):
            rank, tied = cls._ranked((rank[tied] << 32) | rank[np.minimum(tied + depth, stop[tied])], rank, tied)
            depth *= 2
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = place

        before = np.where(suffixes > 0, symbols[suffixes - 1], 0)
        start = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0))))
        tails = np.append(start[1:], n) - 1
        index = cls(n, before[start], suffixes[start], suffixes[tails], np.zeros(len(start), np.int64))
        runs, heads, last = index._shifted()
        left, right = heads[1:], last[:-1]
        index.head_match[runs[1:]] = cls._common(data, left, right, np.minimum(stop[left] - left, stop[right] - right))
        return index

    @staticmethod
    def _ranked(key: np.ndarray, rank: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (numbers of smaller suffixes) with those at ``places`` refined by their keys, and the places still tied.

        Keys begin with the rank so far, so each tied group stays in its own stretch of ranks.
        """
        by = np.argsort(key)
        key, places = key[by], places[by]
        old = rank[places]
        index = np.arange(len(by))
        group = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), index, 0))
        head = np.concatenate(([True], key[1:] != key[:-1]))
        rank = rank.copy()
        rank[places] = old + np.maximum.accumulate(np.where(head, index, 0)) - group
        alone = head & np.concatenate((head[1:], [True]))
        return rank, places[~alone]

    @staticmethod
    def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Lengths of the common beginnings at places ``a`` and ``b``, at most ``most``: eight bytes at a time while they agree."""
        eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
        out, left = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(left):
            x, y = (np.ascontiguousarray(eight[p[left] + out[left]]).view("<u8").ravel() for p in (a, b))
            differ = x ^ y
            low = differ & (~differ + np.uint64(1))  # the lowest differing bit lies in the first differing byte
            out[left] += np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
            left = left[(differ == 0) & (out[left] < most[left])]
        return np.minimum(out, most)

    def _shifted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs in the order of the suffixes one place before theirs, and the places of these at each run's head and tail.

        That order goes by the symbol, and among equal ones keeps the runs'; terminators come first, by their number.
        """
        heads, tails = (self.head_sample - 1) % self.size, (self.tail_sample - 1) % self.size
        runs = np.lexsort((np.where(self.symbol == 0, heads, np.arange(len(heads))), self.symbol))
        return runs, heads[runs], tails[runs]

    def neighbours(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Breaks of the suffix above and of that below: sorted places, the neighbour there and the bytes shared with it."""
        runs, heads, tails = self._shifted()
        none, match = -(1 << 40), self.head_match[runs]
        out = []
        for at, to, shared in ((heads, np.concatenate(([-1], tails[:-1])), np.concatenate(([none], match[1:]))), (tails, np.concatenate((heads[1:], [-1])), np.concatenate((match[1:], [none])))):
            by = np.argsort(at)
            out.append((at[by], to[by], shared[by]))
        return out

    def earlier_matches(self, places: np.ndarray, length: int) -> np.ndarray:
        """For each of ``places`` a smaller place with which it shares ``length`` bytes or more (-1: there is none).

        Matching statistics are streamed along the suffix order, upwards and downwards from each place at once, while ``length`` bytes are shared, until a
        smaller place is met.  Neighbours and shared lengths come from the samples alone.
        """
        found, both = np.full(len(places), -1), self.neighbours()
        here = [(np.arange(len(places)), places), (np.arange(len(places)), places)]
        steps = 0
        while any(len(own) for own, _ in here):
            steps += 1
            if steps > self.size:
                raise ValueError("the samples of the index contradict each other")
            for side, (at, to, match) in enumerate(both):
                own, now = here[side]
                more = found[own] < 0
                own, now = own[more], now[more]
                k = np.searchsorted(at, now)
                away = at[k] - now
                near = match[k] + away >= length
                own, now = own[near], to[k[near]] - away[near]
                hit = now < places[own]
                found[own[hit]] = now[hit]
                here[side] = own[~hit], now[~hit]
        return found


# ---- which strings meet where ------------------------------------------------------------------------------------


def seeds(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``length``-byte strings that share their seed: first start, last start, hash of the seed.

    The seed of a string is its ``seed``-byte substring of least hash (the leftmost, if several), which depends on the string
    alone: equal strings have equal seeds.
    """
    if len(data) < length:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64))
    n = len(data) - seed + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=total[1:])
    hashes = mix((total[seed:] - total[:n]) * powers(BASE_INVERSE, n))
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width, size = length - seed + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    count = len(data) - length + 1
    at = (least[:count] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(count, bool)
    for o in offsets[1:-1].tolist():  # no string crosses a row's end
        inside[max(0, o - length + 1) : o] = False
    change = np.concatenate(([True], (at[1:] != at[:-1]) | ~inside[:-1] | ~inside[1:]))
    first = np.flatnonzero(change & inside)
    breaks = np.flatnonzero(np.concatenate((change[1:] | ~inside[1:], [True])) & inside)
    return first, breaks, mix(hashes[at[first]])  # least hashes are small numbers; scrambled again they spread evenly over buckets


def whole_characters(data: np.ndarray, edges: list[int]) -> list[int]:
    """Starts and ends of what stays of a UTF-8 text without the spans whose starts and ends are ``edges``, and without characters that lose a byte."""
    out = [0]
    for start, end in zip(edges[::2], edges[1::2], strict=True):
        while start < len(data) and start > 0 and data[start] & 0xC0 == 0x80:
            start -= 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if start < out[-1]:  # within the character that the last span has cut
            start = out[-1]
        out += [start, end]
    return [*out, len(data)]


class Segments:
    """The runs of one chunk: where they lie, and their seeds."""

    def __init__(self, rows: pa.Table, length: int, seed: int) -> None:
        rows = self.rows = rows.sort_by([("doc_id", "ascending"), ("tie", "ascending")])
        ids = rows.column("doc_id").combine_chunks()
        self.ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        self.texts = text_array(rows.column("text"))
        self.data, self.offsets = text_buffer(self.texts)
        found = []
        for a, b in row_slices(self.offsets, PART):
            lo, hi = int(self.offsets[a]), int(self.offsets[b])
            for x in range(lo, max(hi - length + 1, lo + 1), PART):  # a longer row in overlapping parts
                y = min(hi, x + PART + length - 1)
                inner = self.offsets[a + 1 : b] if b - a > 1 else self.offsets[:0]
                first, last, seed_hash = seeds(self.data[x:y], np.concatenate(([0], inner - x, [y - x])), length, seed)
                found.append((first + x, last + x, seed_hash))
        self.first, self.last, self.seed = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def shared(self, back: pa.Table) -> np.ndarray:
        """Runs whose seed occurs more than once, here or in other chunks."""
        values, inverse, counts = np.unique(self.seed, return_inverse=True, return_counts=True)
        known = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in back.column("hashes")]) if back.num_rows else np.zeros(0, np.uint64)
        often = counts > 1
        often |= np.isin(values, known)
        return np.flatnonzero(often[inverse])

    def distinct(self, runs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of runs with the same bytes the earliest ones, with their bytes; and the others, all of whose strings are repeats."""
        seen: set[bytes] = set()
        new, old, content = [], [], []
        view = memoryview(self.data)
        for k, a, b in zip(runs.tolist(), self.first[runs].tolist(), (self.last[runs] + length).tolist(), strict=True):
            own = bytes(view[a:b])
            if own in seen:
                old.append(k)
            else:
                seen.add(own)
                new.append(k), content.append(own)
        return np.array(new, np.int64), np.array(old, np.int64), content


def _both_ways(hashed: DataFrame) -> DataFrame:
    """From rows bucket, chunk, hashes: chunk, hashes that any other chunk has too."""

    def run(bucket: pa.Table) -> pa.Table:
        chunks = bucket.column("chunk").to_numpy()
        parts = [np.frombuffer(b.as_buffer(), np.uint64) for b in bucket.column("hashes")]
        values = np.sort(np.concatenate(parts))
        often = np.unique(values[1:][values[1:] == values[:-1]])
        shared = [(c, np.intersect1d(p, often, assume_unique=True)) for c, p in zip(chunks.tolist(), parts, strict=True)]
        shared = [(c, p.tobytes()) for c, p in shared if len(p)]
        return pa.table({"chunk": pa.array([c for c, _ in shared], pa.int32()), "hashes": pa.array([p for _, p in shared], pa.binary())})

    return hashed.groupBy("bucket").applyInArrow(run, "chunk int, hashes binary")


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept_sha256 string"


def remove_repeats_by_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans (maximal removed byte ranges), kept_sha256
    and, on demand, kept_text (without the characters that lose a byte) and the columns of ``carry``.

    A byte goes if a ``length``-byte string covers it that also starts earlier: in a smaller doc_id, or in the same document before. Strings don't
    cross documents, may overlap, and are judged on the input.  Null counts as empty; shorter texts lose nothing.  Rows without an
    id come last; they, and rows of one doc_id, follow each other by a hash of their text, whatever order they are met in.  Other columns are left out; an empty table gives no rows.

    Equal strings meet by their seeds (see ``seeds``): each chunk of documents sends its seeds' hashes once, learns which are shared, and sends the
    runs of strings around shared seeds, each different one once, to the seed's bucket.  A bucket builds the run-length index over its runs in document order
    and streams them through it; what its matching statistics show to match earlier text for the full length goes back to its chunk.  Hashes only bring
    candidates together: the index compares bytes.
    """
    chunked, count = ordered_chunks(docs, id_col, text_col, CHUNK_BYTES, carry=carry)
    bits = bucket_bits(count) + MORE_BUCKETS

    def bucket_of(values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(64 - bits)).astype(np.int64)

    def send_seeds(rows: pa.Table) -> pa.Table:
        values = np.unique(Segments(rows, length, seed).seed)
        tops = bucket_of(values)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(tops)) + 1, [len(values)])) if len(values) else np.zeros(1, np.int64)
        spans = list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))
        chunk = rows.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([int(tops[a]) for a, _ in spans], pa.int32()), "chunk": pa.array([chunk] * len(spans), pa.int32()), "hashes": pa.array([values[a:b].tobytes() for a, b in spans], pa.binary())})

    def send_runs(rows: pa.Table, back: pa.Table) -> pa.Table:
        own = Segments(rows, length, seed)
        new, _, content = own.distinct(own.shared(back), length)
        chunk = rows.column("chunk")[0].as_py() if rows.num_rows else 0
        tops = bucket_of(own.seed[new])
        out = []
        for b in np.unique(tops).tolist():
            at = np.flatnonzero(tops == b)
            parts = [content[i] for i in at.tolist()]
            out.append((b, new[at].astype("<i8").tobytes(), np.array([len(p) for p in parts], "<i8").tobytes(), b"".join(parts)))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        bucket, runs, sizes, data = (pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))
        return pa.table({"bucket": bucket, "chunk": pa.array([chunk] * len(out), pa.int32()), "runs": runs, "sizes": sizes, "data": data})

    def mark(bucket: pa.Table) -> pa.Table:
        chunks = bucket.column("chunk").to_numpy()
        owner, number, texts, later = [], [], [], []
        seen: set[bytes] = set()
        for k in np.argsort(chunks, kind="stable").tolist():
            runs, sizes = (np.frombuffer(bucket.column(c)[k].as_buffer(), "<i8") for c in ("runs", "sizes"))
            data, at = bucket.column("data")[k].as_py(), 0
            for run, size in zip(runs.tolist(), sizes.tolist(), strict=True):
                text, at = data[at : at + size], at + size
                if text in seen:
                    later.append((int(chunks[k]), run, 0, size - length + 1))
                else:
                    seen.add(text)
                    owner.append(int(chunks[k])), number.append(run), texts.append(text)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        index = RunLengthIndex.build(data, ends)
        for first in range(0, len(texts), TEXTS):  # streamed through it in document order
            size = sizes[first : first + TEXTS] - length + 1
            text = np.repeat(np.arange(first, first + len(size)), size)
            place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
            hit = index.earlier_matches(starts[text] + place, length) >= 0
            text, place = text[hit], place[hit]
            cut = np.concatenate(([0], np.flatnonzero((np.diff(text) != 0) | (np.diff(place) != 1)) + 1, [len(text)])) if len(text) else np.zeros(1, np.int64)
            later += [(owner[int(text[a])], number[int(text[a])], int(place[a]), b - a) for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
        marks = np.array(later, np.int64).reshape(-1, 4)
        marks = marks[np.argsort(marks[:, 0], kind="stable")]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(marks[:, 0])) + 1, [len(marks)])).tolist() if len(marks) else [0]
        groups = [marks[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        return pa.table({"chunk": pa.array([int(g[0, 0]) for g in groups], pa.int32()), "marks": pa.array([g[:, 1:].astype("<i8").tobytes() for g in groups], pa.binary()), "hashes": pa.array([None] * len(groups), pa.binary())})

    def settle(rows: pa.Table, back: pa.Table) -> pa.Table:
        own = Segments(rows, length, seed)
        known, marks = back.filter(pa.compute.is_valid(back.column("hashes"))), back.filter(pa.compute.is_valid(back.column("marks")))
        _, old, _ = own.distinct(own.shared(known), length)
        edge = np.zeros(len(own.data) + 1, np.int64)
        np.add.at(edge, own.first[old], 1)
        np.add.at(edge, own.last[old] + length, -1)
        for m in marks.column("marks"):
            run, first, count = np.frombuffer(m.as_buffer(), "<i8").reshape(-1, 3).T
            begin = own.first[run] + first
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + count - 1 + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        view, removed, spans, digests, kept = memoryview(own.data), [], [], [], []
        for a, b in zip(own.offsets.tolist(), own.offsets[1:].tolist(), strict=False):
            mask = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).tolist() if mask.any() else []
            spans.append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)])
            removed.append(sum(edges[1::2]) - sum(edges[::2]))
            inner = [0, *edges, b - a]
            data = b"".join(bytes(view[a + x : a + y]) for x, y in zip(inner[::2], inner[1::2], strict=True))
            digests.append(hashlib.sha256(data).hexdigest())
            if keep_text:
                part = own.data[a:b]
                inner = whole_characters(part, edges)
                kept.append(b"".join(part[x:y].tobytes() for x, y in zip(inner[::2], inner[1::2], strict=True)).decode("utf-8", "surrogatepass"))
        sizes = np.diff(own.offsets)
        columns = {"doc_id": own.ids, "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array([len(s) for s in spans], pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(columns | ({"kept_text": pa.array(kept, pa.string())} if keep_text else {}) | {c: own.rows.column(c) for c in carry})

    groups = chunked.groupBy("chunk")
    hashed = groups.applyInArrow(send_seeds, "bucket int, chunk int, hashes binary")
    shared = _both_ways(hashed)
    runs = groups.cogroup(shared.groupBy("chunk")).applyInArrow(send_runs, "bucket int, chunk int, runs binary, sizes binary, data binary")
    marks = runs.groupBy("bucket").applyInArrow(mark, "chunk int, marks binary, hashes binary")
    back = shared.select("chunk", F.lit(None).cast("binary").alias("marks"), "hashes").unionByName(marks)
    return groups.cogroup(back.groupBy("chunk")).applyInArrow(settle, _RESULT + ", kept_text string" * keep_text + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema))
