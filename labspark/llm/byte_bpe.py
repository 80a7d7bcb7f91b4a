"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_array

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A single space between two characters that are no white space: the pattern always starts a match there.
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
#: A text that can't be cut at its spaces alone.
_UNEVEN = re.compile(r"\s \S|\S \s|  |^\s|\s$|^ | $")
#: Bytes of pieces and ids that a Python worker remembers (it starts anew when there are more), and the longest piece that it remembers.
CACHE_BYTES, CACHE_PIECE = 64 << 20, 256


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: visible Latin-1 ones for themselves, the rest from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, alphabet = read_ranks(path), byte_alphabet()
        shown = {token: "".join(alphabet[b] for b in token) for token in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: The byte table reversed: an id's bytes.
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = {i: bytes(byte_of[c] for c in text) for text, i in self.tokenizer.get_vocab().items()}
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _pieces(self, text: str) -> list[str]:
        words = _BOUNDARY.split(text) if _UNEVEN.search(text) else text.split(" ")
        return [words[0], *(" " + w for w in words[1:])]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        Texts are cut at spaces where no match can cross, and each different piece is encoded once.
        """
        if self.held > CACHE_BYTES:
            self.cache, self.held = {}, 0
        pieces = [self._pieces(t) if t else [] for t in texts]
        fresh = list({p for own in pieces for p in own if p not in self.cache})
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.cache[p] = ids = array("I", e.ids).tobytes()
                self.held += len(p) + len(ids) + 150
        get = self.cache.__getitem__
        out = [b"".join(map(get, own)) for own in pieces]
        for p in [p for p in fresh if len(p) > CACHE_PIECE]:
            self.held -= len(p) + len(self.cache.pop(p)) + 150
        return out

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """The characters that each id covers; ids that split a character share its range."""
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode_text(self, ids: np.ndarray) -> str:
        """As text; bytes of a split character that are no UTF-8 become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def coder(path: str) -> ByteBpe:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
    return ByteBpe(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """doc_id and ids array<int> of each text (null: empty), with ``offsets`` also start and end (characters) of each id."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column("text")).to_pylist()
            columns = [batch.column("doc_id"), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coder(path).encode_batch(texts)], pa.list_(pa.int32()))]
            if offsets:
                spans = [coder(path).offsets(t) for t in texts]
                columns += [pa.array([[s[k] for s in own] for own in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "start", "end"][: len(columns)])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, ids array<int>" + ", start array<int>, end array<int>" * offsets)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, data binary: the bytes that each row's ids stand for (null ids: none)."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [coder(path).decode(np.asarray(x or [], np.uint32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encodes, then decodes what was encoded, in one pass.

    Null and empty texts have no ids.  Repeated rows give repeated rows; other columns are left out.  A text of any length
    is encoded whole.  No shuffle.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            texts, rows = text_array(batch.column("text")), []
            for i in range(0, len(texts), 256):
                for ids in own.encode_batch(texts[i : i + 256].to_pylist()):
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(np.frombuffer(ids, "<u4"))).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
