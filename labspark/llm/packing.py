"""Hierarchical multi-length packing of token ids into training sequences."""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_array

VOCABULARY = "word_bpe_49k.json"
#: Context sizes, powers of two, longest first.
TIERS = (4096, 2048, 1024, 512)
#: The id that ends every document.
END = 2
#: Tokens of a training step; a step takes sequences of one tier.
STEP_TOKENS = 1 << 17
#: Tokens of documents that wait in a task for a place; bounds its memory, but for a single longer document.
WAITING_TOKENS = 1 << 19
#: Bytes of words and ids that a Python worker remembers (it starts anew when there are more), and the longest word that it remembers.
CACHE_BYTES, CACHE_WORD = 192 << 20, 256
#: Words below this character whose letters need no text rules; beyond it, libraries may know other letters.
_PLAIN_BELOW = "\u0530"


class WordCoder:
    """Ids of whole texts, as the tokenizers library gives them with the vocabulary file as it is, from the ids of their words.

    The vocabulary's own rules lower the case and never join characters across white space, so a text's ids are its words' ids
    in a row.  Each different word is encoded once; lower-case words of letters only skip the text rules, which leave them alone.
    A text that holds the string of a special token goes through the library whole, as such strings may touch words.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.encode().lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends_word = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}
        self.held = 0
        self.marks = {m: self._encode(self.whole, [m.decode()])[0] for m in (b".", b",")}

    @staticmethod
    def _encode(tokenizer, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        """Plain words, many to a text: each word's last id is one that ends words."""
        out = []
        lines = [words[i : i + 64] for i in range(0, len(words), 64)]
        for line, e in zip(lines, self.plain.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()]
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    @staticmethod
    def _is_plain(text: str) -> bool:
        """Letters only, which lower-casing and composing leave as they are."""
        return text.isalpha() and (text.isascii() or (max(text) < _PLAIN_BELOW and text == text.lower() and unicodedata.is_normalized("NFC", text)))

    def _learn(self, fresh: set[bytes]) -> None:
        """Fills the cache.  A plain word with a full stop or comma behind it is the word's ids and the mark's."""
        marked, letters, others = [], [], []
        for w in fresh:
            text = w.decode("utf-8", "surrogatepass")
            if w[-1:] in self.marks and self._is_plain(text[:-1]):
                marked.append(w)
                if w[:-1] not in self.cache and w[:-1] not in fresh:
                    letters.append((w[:-1], text[:-1]))
            elif self._is_plain(text):
                letters.append((w, text))
            else:
                others.append((w, text))
        self.cache.update(zip((w for w, _ in letters), self._encode_plain([t for _, t in letters]), strict=True))
        for i in range(0, len(others), 4096):
            own = others[i : i + 4096]
            self.cache.update(zip((w for w, _ in own), self._encode(self.whole, [t for _, t in own]), strict=True))
        for w in marked:
            self.cache[w] = self.cache[w[:-1]] + self.marks[w[-1:]]
        self.held += sum(len(w) + len(self.cache[w]) + 150 for w in fresh)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.held > CACHE_BYTES:
            self.cache, self.held = {}, 0
        lower = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        special = {i for i, t in enumerate(lower) if any(m in t for m in self.special)}
        words = [[] if i in special else t.split() for i, t in enumerate(lower)]
        cache = self.cache
        fresh = {w for own in words for w in own if w not in cache}
        if fresh:
            self._learn(fresh)
        get = cache.__getitem__
        out = [b"".join(map(get, own)) for own in words]
        for i in special:
            out[i] = self._encode(self.whole, [texts[i]])[0]
        for w in [w for w in fresh if len(w) > CACHE_WORD]:
            self.held -= len(w) + len(cache[w]) + 150
            del cache[w]
        return out


@functools.lru_cache(maxsize=2)
def word_coder(path: str) -> WordCoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
    return WordCoder(path)


class TierPacker:
    """Packs a stream of documents of one task.

    A document's full windows of the longest tier go out at once.  What is left of it is routed to the shortest tier that
    holds it.  When enough waits, each tier is packed: its pieces fill a window in turn, and the gap is closed with whole pieces of
    shorter tiers, longest first, and at last with a piece that is cut.  At the end the rest is cut into
    windows at powers of two.  Every window is full.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, waiting: int = WAITING_TOKENS) -> None:
        self.tiers, self.limit = tiers, waiting
        self.queues: dict[int, deque] = {t: deque() for t in tiers}
        self.waiting = 0
        #: (document, start, length, sequence, offset, size of the sequence)
        self.out: list[tuple] = []
        self.sequence = 0

    def add(self, doc, tokens: int) -> None:
        start, top = 0, self.tiers[0]
        while tokens - start >= top:
            self._close([(doc, start, top)], top)
            start += top
        if start < tokens:
            self._wait((doc, start, tokens - start))
        if self.waiting >= self.limit:
            self.pack()

    def _wait(self, piece: tuple, first: bool = False) -> None:
        queue = self.queues[min(t for t in self.tiers if t >= piece[2])]
        queue.appendleft(piece) if first else queue.append(piece)
        self.waiting += piece[2]

    def _take(self, tier: int) -> tuple:
        piece = self.queues[tier].popleft()
        self.waiting -= piece[2]
        return piece

    def _close(self, pieces: list[tuple], size: int) -> None:
        offset = 0
        for doc, start, length in pieces:
            self.out.append((doc, start, length, self.sequence, offset, size))
            offset += length
        self.sequence += 1

    def _window(self, size: int, own: int) -> bool:
        """One full window of ``size`` that starts with a piece of tier ``own``."""
        if self.waiting < size:
            return False
        pieces, room = [self._take(own)], 0
        room = size - pieces[0][2]
        while room:
            below = next((t for t in self.tiers if self.queues[t] and self.queues[t][0][2] <= room), None)
            if below is not None:
                pieces.append(self._take(below))
                room -= pieces[-1][2]
                continue
            cut = next(t for t in reversed(self.tiers) if self.queues[t])
            doc, start, length = self._take(cut)
            pieces.append((doc, start, room))
            self._wait((doc, start + room, length - room), first=True)
            room = 0
        self._close(pieces, size)
        return True

    def pack(self) -> None:
        for tier in self.tiers:
            while self.queues[tier] and self._window(tier, tier):
                pass

    def finish(self) -> None:
        self.pack()
        rest = [p for t in self.tiers for p in self.queues[t]]
        left = sum(p[2] for p in rest)
        size = self.tiers[0]
        while left:
            if size > left:
                size //= 2
                continue
            window, room = [], size
            while room:
                doc, start, length = rest[0]
                n = min(length, room)
                window.append((doc, start, n))
                rest[:1] = [(doc, start + n, length - n)] if n < length else []
                room -= n
            self._close(window, size)
            left -= size


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, task int, number long"


def step_groups(packed: DataFrame) -> DataFrame:
    """``packed`` (tier, task, number of the sequence among its task's and tier's) with step_group in place of task and number.

    The sequences of a tier are numbered over all tasks, and each run of ``STEP_TOKENS`` tokens is a step: all steps of a tier hold equal tokens,
    but for its last one.  Only counts by task and tier are gathered, as many rows as tasks times tiers; these are what is joined back.
    """
    counts = packed.groupBy("tier", "task").agg((F.max("number") + 1).alias("n"))
    before = counts.select("tier", "task", F.coalesce(F.sum("n").over(Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    step = F.shiftleft(F.col("tier").cast("long"), 44) + F.floor((F.col("before") + F.col("number")) * F.col("tier") / F.lit(STEP_TOKENS))
    return packed.join(before, ["tier", "task"]).withColumn("step_group", step).drop("task", "number", "before")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, tiers: tuple[int, ...] = TIERS, ids: bool = False) -> DataFrame:
    """One row per piece of a packed document; with ``ids`` also the piece's ids as array<int>.

    Each text (null: empty) becomes its ids and the end id 2, so an empty text is a document of one id.  Ids are the library's with the file as it
    is: the string of a special token within a text becomes that token.  Pieces fill sequences of the tiers'
    sizes; a task's last ones are shorter powers of two, so that no sequence needs padding.  ``sequence_id`` is unique: the task's
    number and a number within it; ``step_group`` puts sequences of one tier into steps of equal tokens (see ``step_groups``).  A text
    of any length is encoded whole and cut into as many pieces as it takes.  Repeated rows are packed each; other columns
    are left out; an empty table gives no rows.  One pass over the input, no shuffle of it; a task holds at most
    ``WAITING_TOKENS`` ids, one batch and the words it remembers.  The pieces are kept in the checkpoint folder, as the steps need their counts.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, packer, task = word_coder(path), TierPacker(tiers), TaskContext.get().partitionId()
        end, steps = np.asarray([END], "<u4").tobytes(), {}
        held: dict[int, list] = {}
        number = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for doc, start, length, sequence, offset, size in packer.out:
                own = held[doc]
                data = own[1][4 * start : 4 * (start + length)]
                done = steps.setdefault(size, [0, -1])
                if sequence != done[1]:
                    done[0], done[1] = done[0] + 1, sequence
                rows.append((own[0], start, length, zlib.crc32(data), len(own[1]) // 4, (task << 33) | sequence, offset, size, task, done[0] - 1, np.frombuffer(data, "<u4").astype(np.int32) if ids else None))
                own[2] -= length
                if not own[2]:
                    del held[doc]
            packer.out = []
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "task", "number", "ids"][: len(kinds)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            texts, names = text_array(batch.column("text")), batch.column("doc_id").to_pylist()
            for i in range(0, len(texts), 128):
                for name, data in zip(names[i : i + 128], coder.encode(texts[i : i + 128].to_pylist()), strict=True):
                    data += end
                    held[number] = [name, data, len(data) // 4]
                    packer.add(number, len(data) // 4)
                    number += 1
                if len(packer.out) >= 1000:
                    yield flush()
        packer.finish()
        yield flush()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return step_groups(durable(base.mapInArrow(run, _SCHEMA + ", ids array<int>" * ids)))
