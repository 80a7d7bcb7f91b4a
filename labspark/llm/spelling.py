"""Groups of spelling variants: words one edit apart, found by bidirectional FM-index searches.

A word and a near word differ within a window of the word; outside of it they agree, so both meet under the key (length of the searching word, window,
what stands before it, what stands after it).  The first windows are the two halves.  Keys that too many words share are parted by halving the window.
Keys are dealt to bins, and each bin's vocabulary, delimited, becomes one index in which the half without the window is matched exactly and the search
goes on across the other, where one error is allowed within the window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, shuffle_partitions

#: Bytes of words that share a key before its window is halved, and bytes of words that a bin is meant to hold.
KEY_BYTES, BIN_BYTES = 1 << 20, 1 << 21
#: Symbols from one stored count to the next, and search states taken at a time.
STRIDE, STATES = 64, 1 << 13


class _Half:
    """Rank structure over the Burrows-Wheeler transform of a cyclic text."""

    def __init__(self, text: np.ndarray, symbols: int):
        rank, h, n = text.astype(np.int64), 1, len(text)
        while True:  # prefix doubling; a text of different delimited words has no two equal rotations
            _, rank = np.unique(rank * (n + symbols) + np.roll(rank, -h), return_inverse=True)
            if rank[np.argmax(rank)] == n - 1:
                break
            h *= 2
        self.places = np.empty(n, np.int64)
        self.places[rank] = np.arange(n)
        bwt = text[self.places - 1]
        blocks = n // STRIDE + 1
        self.bwt = np.full(blocks * STRIDE, symbols, text.dtype)
        self.bwt[:n] = bwt
        counts = np.zeros((blocks + 1, symbols + 1), np.int64)
        np.add.at(counts, (np.arange(n) // STRIDE + 1, bwt.astype(np.int64) + 1), 1)
        #: below[k, c]: symbols less than c in the first k blocks.
        self.below = np.cumsum(np.cumsum(counts, 0), 1)
        self.starts = self.below[-1]
        self.blocks = self.bwt.reshape(-1, STRIDE)

    def less(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Symbols less than ``c`` among the first ``at`` of the transform."""
        block, rest = at // STRIDE, at % STRIDE
        own = (self.blocks[block] < c[:, None]) & (np.arange(STRIDE) < rest[:, None])
        return self.below[block, c] + own.sum(1)

    def less_all(self, at: np.ndarray) -> np.ndarray:
        """The same for every symbol, a column each."""
        block, rest, rows = at // STRIDE, at % STRIDE, np.arange(len(at))
        extra = np.zeros((len(at), self.below.shape[1] + 1), np.int64)
        for k in range(STRIDE):
            extra[rows, self.blocks[block, k].astype(np.int64) + 1] += k < rest
        return self.below[block] + np.cumsum(extra[:, :-1], 1)


class Index:
    """Bidirectional FM-index of different words, each ended by a delimiter (symbol 0)."""

    def __init__(self, words: list[str]):
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        self.alphabet = np.unique(np.concatenate(points))
        self.symbols = len(self.alphabet) + 1
        parts = [x for p in points for x in (np.searchsorted(self.alphabet, p) + 1, np.zeros(1, np.int64))]
        text = np.concatenate(parts).astype(np.uint8 if self.symbols < 255 else np.int32)
        self.ends, self.n = np.flatnonzero(text == 0), len(text)
        self.ahead, self.back = _Half(text, self.symbols), _Half(text[::-1].copy(), self.symbols)

    def codes(self, word: str) -> np.ndarray:
        """Symbols of a word; -1 where the vocabulary lacks the character."""
        p = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, p), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == p, at + 1, -1)

    def near(self, words: list[str], before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word of the vocabulary) pairs that differ by one edit which leaves ``before`` first and ``after`` last characters of the query alone."""
        codes = [self.codes(w) for w in words]
        sizes = np.array([len(c) for c in codes], np.int64)
        mid = sizes // 2
        right = before >= mid
        found = []
        for flip in (False, True):
            own = np.flatnonzero(right != flip)
            if not len(own):
                continue
            text = [codes[k][::-1] if flip else codes[k] for k in own.tolist()]
            exact = np.where(flip, sizes - mid, mid)[own]
            a, b = (after, before) if flip else (before, after)
            q, at = self._search(text, exact, a[own], sizes[own] - b[own], flip)
            found.append((own[q], at))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _search(self, text: list[np.ndarray], exact: np.ndarray, first: np.ndarray, last: np.ndarray, flip: bool) -> tuple[np.ndarray, np.ndarray]:
        """Matches the first ``exact`` symbols from the middle outwards to the delimiter, then goes on to the other end with one error at ``first`` to ``last``.

        An interval is (lo in the index read backwards, lo in the one read ahead, size); an extension to one side moves the other's lo by the smaller symbols.
        """
        one, two = (self.back, self.ahead) if flip else (self.ahead, self.back)
        sizes = np.array([len(t) for t in text], np.int64)
        pattern = np.zeros((len(text), int(sizes.max()) + 2), np.int64)  # the delimiter follows each word
        for k, t in enumerate(text):
            pattern[k, : len(t)] = t

        def extend(half: _Half, c: np.ndarray, lo: np.ndarray, other: np.ndarray, size: np.ndarray):
            good = c >= 0
            c = np.maximum(c, 0)
            low, high = half.less(c, lo), half.less(c, lo + size)
            low1, high1 = half.less(c + 1, lo), half.less(c + 1, lo + size)
            return half.starts[c] + low1 - low, other + high - low, np.where(good, (high1 - low1) - (high - low), 0)

        q = np.arange(len(text))
        lo, other, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.n)
        for step in range(int(exact.max()) + 1):
            on = np.flatnonzero((step <= exact[q]) & (size > 0))
            if not len(on):
                break
            c = np.where(step < exact[q[on]], pattern[q[on], np.maximum(exact[q[on]] - 1 - step, 0)], 0)
            lo[on], other[on], size[on] = extend(one, c, lo[on], other[on], size[on])
        keep = size > 0
        out_q, out_at = [], []
        # state columns: query, next place, lo (read ahead), other (read backwards), size, errors
        open_ = [np.stack([q, exact, other, lo, size, np.zeros(len(q), np.int64)])[:, keep]]
        while open_:
            block = open_.pop()
            if block.shape[1] > STATES:
                open_ += [block[:, STATES:], block[:, :STATES]]
                continue
            q, j, lo, other, size, errors = block
            fresh = []
            free = np.flatnonzero((errors == 0) & (j >= first[q]) & (j <= last[q]))
            if len(free):
                fq, fj = q[free], j[free]
                want, inside = pattern[fq, fj], fj < last[fq]
                gone = inside & (want != pattern[fq, fj + 1])  # of equal neighbours the last is the one left out
                if gone.any():
                    left = block[:, free[gone]].copy()
                    left[1] += 1
                    left[5] = 1
                    fresh.append(left)
                low, high = two.less_all(lo[free]), two.less_all(lo[free] + size[free])
                counts = np.diff(high - low, axis=1)
                s, c = np.nonzero(counts)
                real = (c > 0) & (c != want[s])
                s, c = s[real], c[real]
                k = free[s]
                moved = np.stack([q[k], j[k], two.starts[c] + low[s, c + 1] - low[s, c], other[k] + high[s, c] - low[s, c], counts[s, c], np.ones(len(k), np.int64)])
                fresh.append(moved)  # a symbol put in
                changed = moved[:, inside[s]]
                changed[1] += 1
                fresh.append(changed)  # a symbol replaced
            now = np.concatenate([block[:, (errors == 1) | (j < last[q])], *fresh], 1)
            if not now.shape[1]:
                continue
            q, j, lo, other, size, errors = now
            lo, other, size = extend(two, pattern[q, j], lo, other, size)
            over = (j == sizes[q]) & (size > 0)
            if over.any():
                place = one.places[other[over]]  # of the delimiter before the word, in reading direction of ``one``
                end = np.searchsorted(self.ends, self.n - 1 - place) if flip else (np.searchsorted(self.ends, place) + 1) % len(self.ends)
                out_q.append(q[over])
                out_at.append(end)
            going = (size > 0) & (j < sizes[q])
            if going.any():
                open_.append(np.stack([q, j + 1, lo, other, size, errors])[:, going])
        if not out_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_q), np.concatenate(out_at)


def near_in_bin(table: pa.Table) -> pa.Table:
    """Columns word, near, near_n of a bin's rows (word, n, before, after; ``before`` null for rows that are to be found)."""
    words, ns, before, after = (table.column(c).to_pylist() for c in ("word", "n", "before", "after"))
    known = {w: n for w, n, a in zip(words, ns, before, strict=True) if a is None}
    asks = [k for k, a in enumerate(before) if a is not None]
    rows: list[tuple[str, str]] = []
    if known and asks:
        vocabulary = sorted(known)
        q, at = Index(vocabulary).near([words[k] for k in asks], np.array([before[k] for k in asks]), np.array([after[k] for k in asks]))
        rows = sorted({(words[asks[a]], vocabulary[b]) for a, b in zip(q.tolist(), at.tolist(), strict=True)})
    return pa.table({"word": pa.array([r[0] for r in rows], pa.string()), "near": pa.array([r[1] for r in rows], pa.string()), "near_n": pa.array([known[r[1]] for r in rows], pa.int64())})


def near_pairs(vocabulary: DataFrame, key_bytes: int = KEY_BYTES, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """Columns word, near, near_n: each ordered pair of different words of ``vocabulary`` (word, n) one inserted, deleted or replaced code point apart.

    A word asks under its own length's windows, and is found under those of lengths one less, equal and one more.  A key of over ``key_bytes`` is
    parted by halving the window until that is a single character, where at most some squared alphabet of words can share it.
    """
    size = F.char_length("word")
    asks = vocabulary.select("word", "n", size.alias("asked"), F.lit(True).alias("asks"))
    found = vocabulary.select("word", "n", F.explode(F.array(size - 1, size, size + 1)).alias("asked"), F.lit(False).alias("asks"))
    whole = asks.unionByName(found).withColumns({"before": F.lit(0), "after": F.lit(0)})

    def halved(rows: DataFrame) -> DataFrame:
        middle = F.col("before") + F.floor((F.col("asked") - F.col("before") - F.col("after")) / 2).cast("int")
        two = F.array(F.struct(F.col("before").alias("before"), (F.col("asked") - middle).alias("after")), F.struct(middle.alias("before"), F.col("after").alias("after")))
        parts = rows.withColumn("part", F.explode(two)).select("word", "n", "asked", "asks", "part.before", "part.after").where(size >= F.col("before") + F.col("after"))
        return parts.withColumn("key", F.xxhash64("asked", "before", "after", F.expr("substring(word, 1, before)"), F.expr("right(word, after)")))

    settled, rows = [], durable(halved(whole))
    total = rows.agg(F.sum(F.octet_length("word") + 8)).first()[0] or 0
    while True:
        hot = durable(rows.where("asked - before - after > 1").groupBy("key").agg(F.sum(F.octet_length("word") + 8).alias("bytes")).where(F.col("bytes") > key_bytes).select("key"))
        if hot.isEmpty():
            settled.append(rows)
            break
        few = F.broadcast(hot)  # at most total / key_bytes keys
        settled.append(rows.join(few, "key", "left_anti"))
        rows = durable(halved(rows.join(few, "key", "left_semi")))
    keyed = settled[0]
    for more in settled[1:]:
        keyed = keyed.unionByName(more)
    bins = max(shuffle_partitions(vocabulary.sparkSession), int(total // bin_bytes) + 1)
    asked = F.when(F.col("asks"), F.col("before"))
    sent = keyed.select(F.pmod("key", F.lit(bins)).alias("bin"), "word", "n", asked.alias("before"), F.when(F.col("asks"), F.col("after")).alias("after")).distinct()
    return sent.groupBy("bin").applyInArrow(near_in_bin, "word string, near string, near_n bigint").distinct()


def words_of(docs: DataFrame, deleted: Column | None = None, least: int = 6, often: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns word, n: runs of letters of whole texts, A to Z in lower case, of at least ``least`` code points and ``often`` occurrences.

    ``deleted``, an expression of doc_id and run, is the place (from 0) of a code point to take out of a run, null for none.
    """
    text = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit("[A-Za-zÀ-ÿ]{%d,}" % least), F.lit(0))).alias("run"))
    word = F.col("run")
    if deleted is not None:
        runs = runs.withColumn("gone", deleted)
        word = F.when(F.col("gone").isNull(), F.col("run")).otherwise(F.expr("concat(substring(run, 1, int(gone)), substring(run, int(gone) + 2))"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def variants(vocabulary: DataFrame, factor: int = 5, key_bytes: int = KEY_BYTES, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """Each word of ``vocabulary`` (word, n; each word once) with form, root, n_near and form_n.

    The form is the near word of largest n (ties: smallest) if that is at least ``factor`` times the word's, else null; the root is where the forms
    lead.  An n grows with each form, so forms lead round in no circle, and chains double in each round until none moves.  An empty vocabulary gives no rows.
    """
    kept = durable(vocabulary.select("word", F.col("n").cast("long").alias("n")))
    best = near_pairs(kept, key_bytes, bin_bytes).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    named = kept.join(best, "word", "left").withColumn("form", F.when(-F.col("best.m") >= factor * F.col("n"), F.col("best.near")))
    named = durable(named.select("word", "n", "form", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), -F.col("best.m")).alias("form_n")))
    links = durable(named.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("later"))
        moved = durable(links.join(onward, "root", "left").select("word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return named.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
