"""SimHash near-dedup over vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, mix, text_array
from .components import components

SEED = 42
#: Fingerprints that a leaf and a shard should hold, and the most that the shards' trees are fitted on (the driver gets these, no more).
LEAF, SHARD, SAMPLE = 512, 1 << 14, 1 << 18
FULL = (1 << 64) - 1


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of every run of ``words`` words (ASCII lower case), repeats included; fewer words are one run."""
    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return []
    joined, digest = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= words:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = np.concatenate(([0], ends[: len(own) - words])).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def simhash(hashes: list[int]) -> int:
    """64 majority bits: 1 where over half of the hashes have 1; no hashes give zero."""
    counts, values = np.zeros(64, np.int64), np.array(hashes, np.uint64)
    for i in range(0, len(values), 1 << 14):
        part = values[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id, print long (the 64 bits as a signed number); null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column("text"))
            prints = [_signed(simhash(shingle_hashes(t, words))) for i in range(0, len(texts), 256) for t in texts[i : i + 256].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "print"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, print long")


def set_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, print, second, size of each row of ``docs`` (doc_id, text) with words: majority fingerprints of the set of word shingles, by two independent hashes, and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, seconds, sizes = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id"), text_array(batch.column("text")), strict=True):
                if len(values := np.unique(np.array(shingle_hashes(text.as_py(), words), np.uint64))):
                    ids.append(doc_id.as_py()), prints.append(_signed(simhash(values))), seconds.append(_signed(simhash(mix(values)))), sizes.append(len(values))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, prints, seconds, sizes)], ["doc_id", "print", "second", "size"])

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id long, print long, second long, size long")


@dataclass
class VantageTree:
    """A vantage-point tree over the Hamming distance on the bits of ``mask``.

    Inner node k sends fingerprints within ``radius[k]`` of ``vantage[k]`` to ``near[k]`` and others to ``far[k]``; a negative child is leaf
    ``~child``.  ``reach``: the distance on these bits within which a search must be whole.
    """

    mask: int
    reach: int
    vantage: np.ndarray
    radius: np.ndarray
    near: np.ndarray
    far: np.ndarray
    leaves: int

    @classmethod
    def fit(cls, sample: np.ndarray, mask: int, reach: int, depth: int, seed: int) -> VantageTree:
        """Splits the sample in two, ``depth`` times.  Of some vantage points and radii it takes those with the fewest
        fingerprints on the boundary for the evenness of the split."""
        rng, bits = np.random.default_rng(seed), np.uint64(mask)
        vantage, radius, near, far, leaves = [], [], [], [], 0

        def grow(part: np.ndarray, level: int) -> int:
            nonlocal leaves
            best = None
            if level < depth and len(part) >= 4:
                for v in rng.choice(part, min(6, len(part)), replace=False):
                    d = np.bitwise_count((part ^ v) & bits).astype(np.int64)
                    middle = int(np.median(d))
                    for r in (middle - 1, middle):
                        inside = np.count_nonzero(d <= r) / len(part)
                        if 0.1 <= inside <= 0.9:
                            edge = np.count_nonzero((d - reach <= r) & (d + reach > r)) / len(part)
                            cost = (edge + 0.25) / min(inside, 1 - inside)
                            if best is None or cost < best[0]:
                                best = (cost, v, r, d)
            if best is None:
                leaves += 1
                return ~(leaves - 1)
            _, v, r, d = best
            k = len(vantage)
            for column, value in zip((vantage, radius, near, far), (v, r, 0, 0), strict=True):
                column.append(value)
            near[k] = grow(part[d <= r], level + 1)
            far[k] = grow(part[d > r], level + 1)
            return k

        root = grow(sample, 0)
        if root < 0:
            vantage, radius, near, far = [0], [64], [~0], [~0]
        return cls(mask, reach, np.array(vantage, np.uint64), np.array(radius, np.int64), np.array(near, np.int64), np.array(far, np.int64), leaves)

    def _distance(self, prints: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.bitwise_count((prints ^ self.vantage[node]) & np.uint64(self.mask)).astype(np.int64)

    def home(self, prints: np.ndarray) -> np.ndarray:
        """The leaf of each fingerprint."""
        node = np.zeros(len(prints), np.int64)
        while len(at := np.flatnonzero(node >= 0)):
            k = node[at]
            node[at] = np.where(self._distance(prints[at], k) <= self.radius[k], self.near[k], self.far[k])
        return ~node

    def shards(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, leaf) of every leaf that may hold something within reach: branches that the triangle inequality
        rules out are pruned, and a fingerprint near a boundary enters both sides."""
        index, node, out = np.arange(len(prints)), np.zeros(len(prints), np.int64), []
        while len(node):
            d, r = self._distance(prints[index], node), self.radius[node]
            inside, outside = d - self.reach <= r, d + self.reach > r
            index, node = np.concatenate((index[inside], index[outside])), np.concatenate((self.near[node[inside]], self.far[node[outside]]))
            done = node < 0
            out.append((index[done], ~node[done]))
            index, node = index[~done], node[~done]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (index, node)


def block_masks(blocks: int) -> list[int]:
    """64 bits in ``blocks`` runs of nearly equal length."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def sampled_masks(tables: int, bits: int, seed: int = 7) -> list[int]:
    """``tables`` random choices of ``bits`` of the 64 bits."""
    rng = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(tables)]


def leaf_links(prints: np.ndarray, reps: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (two arrays of reps) between the home fingerprints of a leaf and all of it, within ``distance``.

    A spanning forest: one link for each fingerprint that a component reaches, so that dense groups give no more links than members.
    """
    own, guests = np.flatnonzero(home), np.flatnonzero(~home)
    if len(own) * len(prints) <= 1 << 26:  # a first pass by blocks drops those without neighbours
        hit = [np.count_nonzero(np.bitwise_count(prints[own[i : i + 64], None] ^ prints[None, :]) <= distance, axis=1) > 1 for i in range(0, len(own), 64)]
        own = own[np.concatenate(hit)] if hit else own
    a, b, left = [], [], own
    while len(left):
        first, left = left[0], left[1:]
        front, away = [first], guests
        while front:
            x = prints[front.pop()]
            close = np.bitwise_count(prints[left] ^ x) <= distance
            met = left[close]
            if len(met):
                left = left[~close]
                front.extend(met.tolist())
            close = np.bitwise_count(prints[away] ^ x) <= distance
            if close.any():
                met, away = np.concatenate((met, away[close])), away[~close]
            if len(met):
                a.append(np.full(len(met), first)), b.append(met)
    if not a:
        return reps[:0], reps[:0]
    return reps[np.concatenate(a)], reps[np.concatenate(b)]


def fit_trees(groups: DataFrame, masks: list[int], reach: int, shard: int) -> tuple[list[VantageTree], list[np.ndarray]]:
    """A tree for each mask, fitted on a sample of the column print, with about ``shard`` rows a leaf; and by the sample, how many rows are at home in each leaf."""
    n = groups.count()
    wanted = min(SAMPLE, max(4096, 64 * n // shard))
    sample = np.array([r[0] for r in groups.select("print").orderBy(F.xxhash64("print"), "print").limit(wanted).collect()], np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard)))))
    trees = [VantageTree.fit(sample, m, reach, depth, i) for i, m in enumerate(masks)]
    return trees, [np.bincount(t.home(sample), minlength=t.leaves) * (n / max(1, len(sample))) for t in trees]


def subleaves(prints: np.ndarray, home: np.ndarray, bits: list[tuple[int, int]], leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tree goes on within a shard: (rows, whether at home) of leaves of about ``leaf`` rows, so that a pair one of which is at home in the shard meets in a leaf where one of both is.

    ``bits``: the mask and reach to split on, and those for a leaf that stays eight times too large; at last such a leaf is given out as it is.
    """
    if len(prints) <= leaf or not bits:
        yield np.arange(len(prints)), home
        return
    (mask, reach), others = bits[0], bits[1:]
    sample = prints[:: max(1, len(prints) // 8192)]
    tree = VantageTree.fit(sample, mask, reach, int(np.ceil(np.log2(len(prints) / leaf))), 0)
    own = tree.home(prints)
    index, leaves = tree.shards(prints)
    keep = leaves <= own[index]
    index, leaves = index[keep], leaves[keep]
    by = np.lexsort((index, leaves))
    index, leaves = index[by], leaves[by]
    cuts = np.flatnonzero(np.diff(leaves)) + 1
    for at, k in zip(np.split(index, cuts), leaves[np.concatenate(([0], cuts))].tolist(), strict=True):
        # At home in this leaf are rows whose own leaf it is.  A guest of the shard is no less needed by the shard's home rows here than elsewhere.
        inside = own[at] == k
        if len(at) > 8 * leaf and others:
            for rows, mine in subleaves(prints[at], inside, others, leaf):
                yield at[rows], mine
        else:
            yield at, inside


def candidate_links(groups: DataFrame, masks: list[int], reach: int, distance: int, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """Links a, b between the rows of ``groups`` (print, rep; one row per fingerprint) within ``distance`` bits.

    A tree for each mask deals the fingerprints out to shards, each one Spark group, in which the tree goes on down to leaves.  A fingerprint is at home
    in one leaf of a tree and a guest in the lower-numbered leaves that its boundary overlaps, so a pair meets where one of both is at home.  Disjoint
    masks of all 64 bits with reach = distance // masks miss no pair: on one of them a pair differs by that much at most.
    """
    trees, _ = fit_trees(groups, masks, reach, shard)
    first = np.cumsum([0, *(t.leaves for t in trees)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                prints = part.column("print").to_numpy().view(np.uint64)
                for tree, base in zip(trees, first.tolist(), strict=False):
                    home = tree.home(prints)
                    index, leaves = tree.shards(prints)
                    keep = leaves <= home[index]
                    index, leaves = index[keep], leaves[keep]
                    take = pa.array(index)
                    yield pa.RecordBatch.from_arrays([pa.array(leaves + base, pa.int64()), part.column("print").take(take), part.column("rep").take(take), pa.array(leaves == home[index])], ["shard", "print", "rep", "home"])

    def link(key: tuple, rows: pa.Table) -> pa.Table:
        prints, reps = (rows.column(c).to_numpy() for c in ("print", "rep"))
        order = np.argsort(mix(prints.view(np.uint64)))
        prints, reps, home = prints.view(np.uint64)[order], reps[order], rows.column("home").to_numpy()[order]
        mask = masks[int(np.searchsorted(first, key[0].as_py(), "right")) - 1]
        found = [leaf_links(prints[at], reps[at], inside, distance) for at, inside in subleaves(prints, home, [(mask, reach), (FULL ^ mask, distance)], leaf)]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = groups.mapInArrow(deal, "shard long, print long, rep long, home boolean")
    return dealt.groupBy("shard").applyInArrow(link, "a long, b long")


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, blocks: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach) of each row of ``docs``.

    Fingerprints link at ``distance`` or fewer differing bits.  Null, empty and word-less texts have fingerprint zero and
    link like any other; equal fingerprints form one node before the search.  Repeated rows give repeated rows; rows of
    one doc_id are one node; rows without an id take part through their fingerprint.  Other columns are left out; an empty table gives
    no rows.  No link between different fingerprints is lost, and groups of many copies give one link a member.
    """
    prints = durable(fingerprints(docs, id_col, text_col, words))
    groups = durable(prints.groupBy("print").agg(F.min("doc_id").alias("rep")))
    found = components(candidate_links(groups.where("rep is not null"), block_masks(blocks), distance // blocks, distance))
    named = groups.join(found, groups["rep"] == found["node"], "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id, hashes: the sets of word shingles (as sorted 64-bit hashes) of the rows of ``docs`` that ``ids`` names."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                data = [np.unique(np.array(shingle_hashes(t, words), np.uint64)).tobytes() for t in text_array(part.column("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "hashes"])

    return docs.join(ids, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, hashes binary").groupBy("doc_id").agg(F.min("hashes").alias("hashes"))


def verified_links(pairs: DataFrame, shingled: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b: doc_ids) whose sets of word shingles have a Jaccard similarity of ``similarity`` or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (shingled.select(F.col("doc_id").alias(c), F.col("hashes").alias(h)) for c, h in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def search_plan(rows: int, similarity: float, reach: int = 1, recall: float = 0.99) -> tuple[int, int]:
    """(bits of a mask, masks) with which a pair of sets of ``similarity`` is within ``reach`` on a mask with a chance of ``recall``, whatever the number of rows.

    Masks are the wider the more rows there are, so that the chance pairs of a row stay few; then more masks are needed.
    A bit differs with a chance of angle / pi, so the bits of a pair that differ are binomial.
    """
    bits = min(40, max(10, int(np.ceil(np.log2(max(rows, 2)))) - 8))
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    chance = np.array([math.comb(64, d) * p**d * (1 - p) ** (64 - d) for d in range(65)])
    meet = np.array([sum(math.comb(d, j) * math.comb(64 - d, bits - j) for j in range(reach + 1)) / math.comb(64, bits) for d in range(65)])
    masks = 1
    while chance @ (1 - (1 - meet) ** masks) < recall:
        masks += 1
    return bits, masks


class Leaf:
    """The rows of a leaf, in the order common to all leaves, and which pairs of them may be similar."""

    def __init__(self, rows: dict[str, np.ndarray], at: np.ndarray, home: np.ndarray, distance: int, total: int, similarity: float) -> None:
        self.at, self.home, self.distance, self.total, self.similarity = at, home, distance, total, similarity
        self.print, self.second, self.size, self.label, self.block = (rows[c][at] for c in ("print", "second", "size", "label", "block"))

    def pairs(self, across: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (two arrays of positions in the leaf, the later one first, by rising order) within the distances, of different labels and near enough in
        size; ``across``: of different blocks only.  Labels may change between two steps."""
        n = len(self.at)
        step = max(1, (1 << 19) // max(1, n))  # some 40 MB at once where all pairs are near
        for i in range(0, n, step):
            stop = min(i + step, n)
            x, y = np.nonzero(np.bitwise_count(self.print[i:stop, None] ^ self.print[None, :stop]) <= self.distance)
            x = x + i
            keep = (y < x) & (self.label[x] != self.label[y]) & (self.home[x] | self.home[y])
            x, y = x[keep], y[keep]
            keep = np.bitwise_count(self.print[x] ^ self.print[y]) + np.bitwise_count(self.second[x] ^ self.second[y]) <= self.total
            keep &= np.minimum(self.size[x], self.size[y]) >= self.similarity * np.maximum(self.size[x], self.size[y])
            if across:
                keep &= self.block[x] != self.block[y]
            yield x[keep], y[keep]


def first_neighbours(leaves: Iterator[Leaf], across: bool, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its first ``most`` possible partners before it (two arrays of positions), and the rows that are not done with by these.

    The third array has all rows with a possible partner; it is empty where no row has more than ``most``.
    """
    a, b, seen, more = [], [], [], False
    for leaf in leaves:
        for x, y in leaf.pairs(across):
            if len(x):
                seen.append(np.unique(leaf.at[np.concatenate((x, y))]))
                nth = np.arange(len(x)) - np.searchsorted(x, x)
                more |= bool(nth.max() >= most)
                a.append(leaf.at[x[nth < most]]), b.append(leaf.at[y[nth < most]])
    none = np.zeros(0, np.int64)
    a, b, seen = (np.concatenate([none, *p]) for p in (a, b, seen))
    if len(a):
        a, b = np.unique(np.stack((a, b)), axis=1)
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        more |= bool(nth.max() >= most)
        a, b = a[nth < most], b[nth < most]
    return a, b, np.unique(seen) if more else none


def joined_up(leaf: Leaf, sets: list[np.ndarray], across: bool) -> Iterator[tuple[int, int]]:
    """Links (positions in the leaf) of a spanning forest over the leaf's labels: every possible pair is compared, but where links join its ends already."""
    shared, step = None, 1 << 14
    for later, earlier in leaf.pairs(across):
        i = 0
        while i < len(later):
            x, y = later[i : i + step], earlier[i : i + step]
            i += step
            keep = leaf.label[x] != leaf.label[y]
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            if shared is None:
                shared = _bitmaps(sets)
                step = min(step, max(1, (1 << 21) // max(1, shared.shape[1])))  # 16 MB of bits a side from the next pairs on
            if not len(shared):
                both = np.array([len(np.intersect1d(sets[k], sets[m], assume_unique=True)) for k, m in zip(x.tolist(), y.tolist(), strict=True)])
            else:
                both = np.concatenate([np.bitwise_count(shared[x[j : j + step]] & shared[y[j : j + step]]).sum(axis=1, dtype=np.int64) for j in range(0, len(x), step)])
            alike = both >= leaf.similarity * (leaf.size[x] + leaf.size[y] - both)
            for k, m in zip(x[alike].tolist(), y[alike].tolist(), strict=True):
                if leaf.label[k] != leaf.label[m]:
                    leaf.label[leaf.label == leaf.label[k]] = leaf.label[m]
                    yield k, m


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set: one for every value that several sets have.  No rows where that takes more than 64 MB."""
    sizes = [len(s) for s in sets]
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    keep = (counts > 1)[inverse]
    column, row = number[inverse][keep], np.repeat(np.arange(len(sets)), sizes)[keep]
    words = (int(number[-1]) + 64) // 64
    if words * len(sets) > 1 << 23:
        return np.zeros((0, 1), np.uint64)
    out = np.zeros((len(sets), words), np.uint64)
    np.bitwise_or.at(out, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return out


def _grid(rows: DataFrame, budget: int) -> DataFrame:
    """``rows`` (shard, label, print, rep, size, ..) dealt to groups (shard, low, high) of about ``budget`` shingles at most twice, with the column block.

    A shard with one label only needs no more comparison.  A larger one is split into blocks: of rows that have another label than most of it, and of the others.
    Two blocks meet if one of them is of the former; so rows of one label, however many, are dealt out as often as there are blocks of other labels.
    """
    by_label = rows.groupBy("shard", "label").agg(F.sum("size").alias("own"))
    total, most = F.sum("own"), F.max("own")
    split = total > budget
    shards = by_label.groupBy("shard").agg(
        F.max_by("label", F.struct("own", "label")).alias("major"), F.count("*").alias("labels"), split.alias("split"),
        F.when(split, F.ceil((total - most) / budget)).otherwise(1).cast("int").alias("minor_blocks"), F.when(split, F.ceil(most / budget)).otherwise(0).cast("int").alias("major_blocks"),
    ).where("labels > 1")
    crowd = F.col("split") & (F.col("label") == F.col("major"))
    spread = F.xxhash64("print", "rep")
    block = F.when(crowd, F.col("minor_blocks") + F.pmod(spread, F.col("major_blocks"))).otherwise(F.pmod(spread, F.col("minor_blocks"))).cast("int")
    last = F.when(crowd, F.col("minor_blocks")).otherwise(F.col("minor_blocks") + F.col("major_blocks")) - 1
    met = rows.join(shards, "shard").withColumn("block", block).withColumn("met", F.explode(F.sequence(F.lit(0), last)))
    return met.withColumn("low", F.least("block", "met")).withColumn("high", F.greatest("block", "met")).drop("met", "major", "labels", "split", "minor_blocks", "major_blocks")


def similar_links(docs: DataFrame, groups: DataFrame, same: DataFrame, words: int, similarity: float, distance: int, masks: list[int], reach: int = 1, total: int = 128, shard: int = 1 << 16, leaf: int = LEAF, most: int = 2, budget: int = 1 << 22) -> DataFrame:
    """Links a, b that join up, with ``same``'s, whatever pairs of ``groups`` (print, second, size, rep) within ``distance`` bits, and ``total`` bits of both, are within ``reach`` on a mask and similar.

    A tree for each mask deals the fingerprints out to shards, with guests where a boundary is within reach.  First each fingerprint is compared with its
    first ``most`` neighbours, in an order common to all shards, so that many near copies give a few pairs each; what these links join up takes one label.
    Then those that have further neighbours of another label meet with their shingle sets in the shards, where every pair of different labels is compared and only
    links that join two labels come out.  So a pair is left out only where verified links join its ends already.

    A shard of too many rows is split into blocks (see ``_grid``).  A crowd of near copies, however large, mostly has one label by then and costs about its own
    size; only a crowd that is near by its bits but not similar costs up to all its pairs, compared within groups of ``budget`` shingles.
    """
    trees, sizes = fit_trees(groups, masks, reach, shard)
    first = np.cumsum([0, *(t.leaves for t in trees)]).tolist()
    blocks_of = [np.maximum(1, np.ceil(s / (4 * shard))).astype(np.uint64) for s in sizes]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                prints = part.column("print").to_numpy().view(np.uint64)
                for k, tree in enumerate(trees):
                    index, leaves = tree.shards(prints)
                    keep = leaves <= tree.home(prints)[index]
                    index, leaves = index[keep], leaves[keep]
                    # Large shards are split at random here, otherwise in each tree; all their rows go on to the next step.
                    blocks = blocks_of[k][leaves]
                    block = ((mix(prints[index] ^ np.uint64(k)) >> np.uint64(40)) * blocks) >> np.uint64(24)
                    rows = part.take(pa.array(index))
                    yield pa.RecordBatch.from_arrays([pa.array(leaves + first[k], pa.int64()), pa.array(block.astype(np.int32)), pa.array(blocks > 1), *(rows.column(c) for c in ("print", "second", "size", "rep"))], ["shard", "block", "split", "print", "second", "size", "rep"])

    def leaves_of(number: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, Iterator[Leaf]]:
        values = {c: rows.column(c).to_numpy() for c in ("print", "second", "size", "rep", "block", "label" if "label" in rows.column_names else "rep")}
        order = np.lexsort((values["rep"], mix(values["print"].view(np.uint64))))  # the same everywhere, so that the members of a dense group meet the same few first ones
        values = {c: v[order] for c, v in values.items()}
        values.setdefault("label", values["rep"])
        values |= {c: values[c].view(np.uint64) for c in ("print", "second")}
        mask = masks[int(np.searchsorted(first, number, "right")) - 1]
        parts = subleaves(values["print"], np.ones(len(order), bool), [(mask, reach)], leaf)
        return order, values["rep"], (Leaf(values, at, home, distance, total, similarity) for at, home in parts)

    def neighbours(key: tuple, rows: pa.Table) -> pa.Table:
        _, reps, leaves = leaves_of(key[0].as_py(), rows)
        a, b, rest = first_neighbours(leaves, False, most)
        if rows.column("split")[0].as_py():
            rest = np.arange(len(reps))
        none = pa.nulls(len(rest), pa.int64())
        shards = pa.chunked_array([pa.nulls(len(a), pa.int64()), pa.array(np.full(len(rest), key[0].as_py()), pa.int64())])
        return pa.table({"a": pa.array(np.concatenate((reps[a], reps[rest])), pa.int64()), "b": pa.chunked_array([pa.array(reps[b], pa.int64()), none]), "shard": shards})

    def undecided(key: tuple, rows: pa.Table) -> pa.Table:
        number, low, high = (k.as_py() for k in key)
        _, reps, leaves = leaves_of(number, rows)
        rest = first_neighbours(leaves, low != high, 0)[2]
        return pa.table({"shard": pa.array(np.full(len(rest), number), pa.int64()), "rep": pa.array(reps[rest], pa.int64())})

    def settle(key: tuple, rows: pa.Table) -> pa.Table:
        number, low, high = (k.as_py() for k in key)
        order, reps, leaves = leaves_of(number, rows)
        hashes, links = rows.column("hashes"), []
        for part in leaves:
            sets = [np.frombuffer(hashes[int(i)].as_buffer(), np.uint64) for i in order[part.at]]
            part.size = np.array([len(s) for s in sets])
            links += [(int(reps[part.at[k]]), int(reps[part.at[m]])) for k, m in joined_up(part, sets, low != high)]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    dealt = groups.mapInArrow(deal, "shard long, block int, split boolean, print long, second long, size long, rep long")
    made = durable(dealt.groupBy("shard", "block").applyInArrow(neighbours, "a long, b long, shard long"))
    pairs = made.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = durable(pairs.union(same).where("a <> b").distinct())
    sets = lambda ids: shingle_sets(docs, ids.distinct(), words)
    links = durable(verified_links(pairs, sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))), similarity))
    left = made.where("b is null").select("shard", F.col("a").alias("rep")).distinct()
    if left.isEmpty():
        return links
    labels = components(links).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    nodes = durable(groups.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    left = _grid(durable(left.join(nodes, "rep")), budget)
    left = durable(left.groupBy("shard", "low", "high").applyInArrow(undecided, "shard long, rep long").distinct())
    shingled = sets(left.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep")
    left = _grid(durable(left.join(nodes, "rep")), budget).join(shingled, "rep")
    return links.union(left.groupBy("shard", "low", "high").applyInArrow(settle, "a long, b long"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, distance: int = 18, total: int = 32, recall: float = 0.99) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one with the smallest doc_id; all columns kept.

    Sets of shingles as similar as 0.8 differ by 9.7 of 64 bits on average (deviation 2.9), beyond what pruning can bear at full reach.  So each tree works on
    a random choice of bits, at reach 1, and there are as many trees as it takes for a pair at ``similarity`` to be within reach in one with a chance of ``recall``
    (see ``search_plan``).  Fingerprints within ``distance`` bits that meet, and within ``total`` of 128 with a second fingerprint, are candidates, and their shingle
    sets decide.  The second one keeps chance pairs out, so that ``distance`` can be wide.  Rows without an id or without words stay.
    Repeated rows of the kept id all stay; of rows of one id that differ in text, the set that sorts first stands for all.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = durable(set_fingerprints(base, words))
    groups = durable(prints.groupBy("print", "second").agg(F.min_by("size", "doc_id").alias("size"), F.min("doc_id").alias("rep")))
    same = prints.join(groups, ["print", "second"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    bits, tables = search_plan(groups.count(), similarity, 1, recall)
    found = components(similar_links(base, groups, same, words, similarity, distance, sampled_masks(tables, bits), total=total))
    dropped = found.where("node <> component").select(F.col("node").alias("_dropped_id"))
    return docs.join(dropped, docs[id_col].cast("long") == dropped["_dropped_id"], "left_anti")
