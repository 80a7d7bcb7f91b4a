"""Exact neighbours of vectors over pivots: cells, triangle bounds, and halos.

A few hundred stored vectors are pivots; every vector belongs to the cell of its nearest one.  Distances to pivots bound those between vectors, so a
query visits only cells that can still hold one of its neighbours, and within a cell only the ring its bound leaves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import durable
from . import stats

#: Pivots of a search are between these numbers; at most BLOCK stored vectors are compared at once.
PIVOTS, BLOCK = (1, 256), 4096

#: A search's task holds at most about so many bytes of queries' vectors, and as many of stored ones.
GROUP = 8 << 20


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one length, none of them null, as a matrix, without a Python object for each number."""
    if not len(column):
        return np.empty(0)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, a slice of rows at a time."""
    out = np.empty((len(x), len(pivots)))
    step = max(1, (1 << 22) // max(1, pivots.size))
    for a in range(0, len(x), step):
        out[a : a + step] = np.sqrt(((x[a : a + step, None, :] - pivots[None]) ** 2).sum(2))
    return out


def pivots_of(rows: DataFrame, key: str, vector: str, count: int) -> np.ndarray:
    """At most ``count`` different vectors, by the order of a hash of their key."""
    found = stats.seeded_sample(rows.select(key, vector), key, count).collect()
    return np.array(sorted({tuple(r[1]) for r in found}), np.float64)


def celled(rows: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """``rows`` (simple columns and one vector) with ``cell``, the nearest pivot, and ``reach``, the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(matrix(batch.column(vector)), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "reach"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", cell int, reach double")


def _regions(sizes: dict[int, int], between: np.ndarray, rows: int) -> list[int]:
    """For each cell the number of its region: neighbouring cells that hold about ``rows`` stored vectors together, or one cell of more."""
    out, left = [0] * len(between), set(range(len(between)))
    count = 0
    while left:
        seed, full = min(left), 0
        for c in np.argsort(between[seed], kind="stable").tolist():
            if c in left and (not full or full + sizes.get(c, 0) <= rows):
                out[c], full = count, full + sizes.get(c, 0)
                left.discard(c)
            if full >= rows:
                break
        left.discard(seed)
        count += 1
    return out


class _Search:
    """The ``k`` nearest of some queries in the cells that each visits, exact: products of matrices leave candidates, whose distances decide."""

    def __init__(self, x: np.ndarray, own: np.ndarray, bound: np.ndarray, near: np.ndarray, names: np.ndarray, starts: np.ndarray, k: int):
        self.x, self.own, self.near, self.names, self.starts, self.k = x, own, near, names, starts, k
        self.xx, self.yy = (x * x).sum(1), (near * near).sum(1)
        self.off = 1e-14 * (x.shape[1] + 8) * (self.xx.max() + self.yy.max())  # what a squared distance from products may be off by
        self.slack = bound * (1 + 1e-9) + 1e-12
        self.limit = self.slack**2 + 2 * self.off

    def slice(self, at: np.ndarray, go: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, stored vector and distance, by query and rank, of the queries ``at``; ``go`` says which cells each visits."""
        kept: tuple[np.ndarray, ...] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        more: list[tuple[np.ndarray, ...]] = []
        for c in np.flatnonzero(go.any(0)).tolist():
            rows = at[go[:, c]]
            for a in range(self.starts[c], self.starts[c + 1], BLOCK):
                b = min(a + BLOCK, self.starts[c + 1])
                d2 = self.xx[rows][:, None] + self.yy[a:b] - 2 * (self.x[rows] @ self.near[a:b].T)
                d2[self.own[rows][:, None] == self.names[a:b]] = np.inf
                if b - a > self.k and np.isinf(self.limit[rows]).any():
                    self.limit[rows] = np.minimum(self.limit[rows], np.partition(d2, self.k - 1, 1)[:, self.k - 1] + 2 * self.off)
                i, j = np.nonzero((d2 <= self.limit[rows][:, None]) & (d2 < np.inf))
                more.append((rows[i], a + j, d2[i, j]))
                if sum(len(m[0]) for m in more) > 1 << 18:
                    kept, more = self._least(kept, more), []
        q, s, _ = self._least(kept, more)
        d = np.empty(len(q))
        for a in range(0, len(q), 1 << 15):
            d[a : a + (1 << 15)] = np.sqrt(((self.near[s[a : a + (1 << 15)]] - self.x[q[a : a + (1 << 15)]]) ** 2).sum(1))
        within = d <= self.slack[q]
        q, s, d = q[within], s[within], d[within]
        order = np.lexsort((self.names[s], d, q))
        q, s, d = q[order], s[order], d[order]
        first = np.arange(len(q)) - np.searchsorted(q, q, "left") < self.k
        return q[first], s[first], d[first]

    def _least(self, kept: tuple[np.ndarray, ...], more: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """Candidates that may still be among a query's ``k`` nearest, by query and nearness; queries' limits fall to what these allow."""
        q, s, d2 = (np.concatenate(c) for c in zip(kept, *more, strict=True))
        order = np.lexsort((d2, q))
        q, s, d2 = q[order], s[order], d2[order]
        last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q, "left") == self.k - 1)
        self.limit[q[last]] = np.minimum(self.limit[q[last]], d2[last] + 2 * self.off)
        there = d2 <= self.limit[q]
        return q[there], s[there], d2[there]


def _nearest_in_cells(asked: DataFrame, stored: DataFrame, k: int, regions: list[int], sizes: dict[int, int], rows: int, work: list | None) -> DataFrame:
    """query, chunk, distance: for each row of ``asked`` (query, v, region, cells, bound) the ``k`` nearest within its bound in these cells of one region of ``stored`` (chunk, w, cell, region).

    A region's queries and stored vectors are dealt to blocks of about ``rows`` by hash, and each pair of a region's blocks is a task's group.
    """
    visits = {r.region: r.n for r in asked.groupBy("region").agg(F.count("*").alias("n")).collect()}  # a row a region
    if work is not None:
        work.append(sum(r.n * sizes.get(r.cell, 0) for r in asked.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()))
    stock: dict[int, int] = {}
    for c, n in sizes.items():
        stock[regions[c]] = stock.get(regions[c], 0) + n
    blocks = asked.sparkSession.createDataFrame([(r, -(-n // rows), -(-stock.get(r, 0) // rows) or 1) for r, n in visits.items()] or [(-1, 1, 1)], "region int, nq int, nr int")

    def dealt(df: DataFrame, name: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        named = df.join(F.broadcast(blocks), "region")
        # Both sides' block numbers are of one type: rows of equal groups but of other types would be hashed to different tasks.
        return named.withColumns({own: F.pmod(F.xxhash64(name), F.col(n_own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))}).drop("nq", "nr")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, chunks, distances = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if left.num_rows and right.num_rows:
            right = right.sort_by("cell")
            cell = right.column("cell").to_numpy()
            present, starts = np.unique(cell, return_index=True)
            place = np.full(len(regions), -1)
            place[present] = np.arange(len(present))
            keys = np.array(left.column("query").to_pylist() + right.column("chunk").to_pylist())
            codes = np.unique(keys, return_inverse=True)[1]  # in the order of the keys
            search = _Search(matrix(left.column("v")), codes[: left.num_rows], left.column("bound").to_numpy(), matrix(right.column("w")), codes[left.num_rows :], np.append(starts, len(cell)), k)
            lists = left.column("cells").combine_chunks()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            wanted = place[lists.flatten().to_numpy()]
            for a in range(0, left.num_rows, 512):
                at = np.arange(a, min(a + 512, left.num_rows))
                go = np.zeros((len(at), len(present) + 1), bool)
                go[np.repeat(at - a, ends[at + 1] - ends[at]), wanted[ends[a] : ends[at[-1] + 1]]] = True  # cells without vectors here come last
                for found, made in zip(search.slice(at, go[:, :-1]), (queries, chunks, distances), strict=True):
                    made.append(found)
        return pa.table({"query": left.column("query").take(pa.array(np.concatenate(queries))), "chunk": right.column("chunk").take(pa.array(np.concatenate(chunks))), "distance": pa.array(np.concatenate(distances), pa.float64())})

    kinds = dict(asked.dtypes)["query"], dict(stored.dtypes)["chunk"]
    left = dealt(asked, "query", "qb", "nq", "rb", "nr").groupBy("region", "qb", "rb")
    right = dealt(stored, "chunk", "rb", "nr", "qb", "nq").groupBy("region", "qb", "rb")
    return left.cogroup(right).applyInArrow(best, f"query {kinds[0]}, chunk {kinds[1]}, distance double")


def nearest_join(asked: DataFrame, stored: DataFrame, query_key: str, key: str, vector: str, k: int, pivots: int | None = None, work: list | None = None) -> DataFrame:
    """query, chunk, distance, rank: each query's ``k`` nearest stored vectors but those of its own key, by Euclidean distance, ties to the smaller key.

    Exact.  First each query searches its own cell; its k-th distance there bounds what other cells must offer.  Then it visits the cells whose ball and
    whose side of the halfway plane can hold something as near.  Neighbouring cells make a region, and a query is sent once to each region that it visits, with
    its cells there; stored vectors are copied to blocks of their region's queries.  Where the vectors have no clusters, bounds prune little and nearly all
    pairs are compared, in blocks of bounded bytes.  ``work`` gets the numbers of compared pairs.
    Null vectors and keys take no part; equal vectors are neighbours at distance 0; empty tables give no rows.
    """
    left = asked.select(F.col(query_key).alias("query"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and query is not null")
    right = stored.select(F.col(key).alias("chunk"), F.col(vector).cast("array<double>").alias("w")).where("w is not null and chunk is not null")
    size = right.count()
    if not size:
        return left.select("query", F.lit(None).cast(dict(right.dtypes)["chunk"]).alias("chunk"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("rank")).limit(0)
    centres = pivots_of(right, "chunk", "w", pivots or min(PIVOTS[1], max(PIVOTS[0], math.isqrt(size // 4))))
    right, left = durable(celled(right, "w", centres)), durable(celled(left, "v", centres))
    cells = {r.cell: (r.n, r.far) for r in right.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("far")).collect()}  # a row a pivot
    sizes, far = {c: n for c, (n, _) in cells.items()}, np.array([cells.get(c, (0, -np.inf))[1] for c in range(len(centres))])
    between = _distances(centres, centres)
    # A query goes to a region once, so it is copied at most as often as there are regions: some six of small tables, which keeps the cores busy.
    rows = max(1, min(GROUP // (8 * max(1, centres.shape[1])), max(1024, size // 6)))
    regions = _regions(sizes, between, rows)
    region_of = np.array(regions)
    in_region = F.element_at(F.array(*map(F.lit, regions)), F.col("cell") + 1)
    right = right.withColumn("region", in_region)
    own_cell = left.select("query", "v", in_region.alias("region"), F.array("cell").alias("cells"), F.lit(float("inf")).alias("bound"))
    order = Window.partitionBy("query").orderBy("distance", "chunk")
    first = _nearest_in_cells(own_cell, right, k, regions, sizes, rows, work)
    own = durable(first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
    bounds = own.groupBy("query").agg(F.max("distance").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each region with cells that it visits."""
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                d, cell = _distances(matrix(batch.column("v")), centres), batch.column("cell").to_numpy()
                bound = np.array([np.inf if b is None else b * (1 + 1e-9) + 1e-12 for b in batch.column("bound").to_pylist()])[:, None]
                gap = np.maximum(between[cell], 1e-300)
                plane = (d**2 - d[np.arange(len(cell)), cell][:, None] ** 2) / (2 * gap)  # how far beyond the halfway plane the other cell begins
                go = (d - far <= bound) & ((plane <= bound) | ~np.isfinite(plane)) & np.isfinite(far)
                go[np.arange(len(cell)), cell] = False
                for r in np.unique(region_of[go.any(0)]).tolist():
                    own = np.flatnonzero(region_of == r)
                    at, to = np.nonzero(go[:, own])
                    rows_at, starts = np.unique(at, return_index=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), pa.array(own[to].astype(np.int32)))
                    take = pa.array(rows_at)
                    yield pa.RecordBatch.from_arrays([batch.column("query").take(take), batch.column("v").take(take), pa.array(np.full(len(rows_at), r, np.int32)), lists, pa.array(bound[rows_at, 0])], ["query", "v", "region", "cells", "bound"])

    kind = dict(left.dtypes)["query"]
    others = durable(left.join(bounds, "query", "left").select("query", "v", "cell", "bound").mapInArrow(visits, f"query {kind}, v array<double>, region int, cells array<int>, bound double"))
    found = own.unionByName(_nearest_in_cells(others, right, k, regions, sizes, rows, work))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _near(x: np.ndarray, place: np.ndarray, at: int, eps: float) -> np.ndarray:
    """Rows of ``x`` (sorted by ``place``, a distance to one point) within ``eps`` of row ``at``."""
    a, b = np.searchsorted(place, place[at] - eps - 1e-9, "left"), np.searchsorted(place, place[at] + eps + 1e-9, "right")
    return a + np.flatnonzero(((x[a:b] - x[at]) ** 2).sum(1) <= eps * eps)


#: A grid's boxes along one axis; tiles of a join are ``TILE`` boxes wide.
_AXIS, TILE = 1 << 20, 4


def _touch(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether a row of ``a`` is within ``eps`` of one of ``b``: both are halved, and halves too far apart are dropped."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if len(a) * len(b) <= 4096:
            if (((a[:, None] - b[None]) ** 2).sum(2) <= eps * eps).any():
                return True
            continue
        gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
        if (gap**2).sum() > eps * eps * (1 + 1e-12):
            continue
        swap = len(a) < len(b)
        big, small = (b, a) if swap else (a, b)
        half = np.argpartition(big[:, (big.max(0) - big.min(0)).argmax()], len(big) // 2)
        for part in (big[half[len(big) // 2 :]], big[half[: len(big) // 2]]):
            todo.append((small, part) if swap else (part, small))
    return False


def _grid_clusters(points: DataFrame, low: list[float], eps: float, least: int, rounds: int) -> DataFrame:
    """rep, core, cluster of ``points`` (rep, v, n) of one to three dimensions, as ``density_clusters`` describes them.

    Boxes of the grid are so small that all in one are within ``eps``: boxes of ``least`` rows are all core, and the core vectors of a box are one cluster.  Only
    vectors of other boxes, each with fewer than ``least``, count their neighbours, in a join over tiles of boxes.  Boxes are linked by their outermost core
    vectors; where these don't meet and the boxes are not joined by others, blocks of their core vectors are searched.
    """
    from .cluster import settled_labels

    dims = len(low)
    side = eps / math.sqrt(dims) * (1 - 1e-9)
    axes, reach = range(dims), eps * (1 + 1e-9)
    x = [F.col(f"x{i}") for i in axes]
    packed = lambda parts: sum((p * _AXIS ** (dims - 1 - i) for i, p in enumerate(parts)), F.lit(0).cast("long"))
    # Coordinates begin at TILE boxes, so that none of a neighbour is negative.
    at = lambda c, i, width: F.floor((c - F.lit(low[i])) / F.lit(width) + TILE * side / width)
    placed = points.select("rep", "n", *[F.col("v")[i].alias(f"x{i}") for i in axes])
    placed = durable(placed.withColumns({"box": packed([at(x[i], i, side) for i in axes]), "tile": packed([at(x[i], i, TILE * side) for i in axes])}))
    filled = placed.groupBy("box").agg(F.sum("n").alias("m"))

    def visiting(rows: DataFrame) -> DataFrame:
        """``rows`` as y0, y1, ..., in each tile where they may have a neighbour."""
        for i in axes:
            rows = rows.withColumn(f"_t{i}", F.explode(F.sequence(at(x[i] - reach, i, TILE * side), at(x[i] + reach, i, TILE * side))))
        return rows.select(F.col("rep").alias("asker"), *[x[i].alias(f"y{i}") for i in axes], packed([F.col(f"_t{i}") for i in axes]).alias("tile"))

    near = sum(((x[i] - F.col(f"y{i}")) * (x[i] - F.col(f"y{i}")) for i in axes), F.lit(0.0)) <= F.lit(eps * eps)
    loose = durable(placed.join(filled.where(F.col("m") < least).select("box"), "box"))
    counts = visiting(loose).join(placed.select("n", "tile", *x), "tile").where(near).groupBy("asker").agg(F.sum("n").alias("m"))
    thick = filled.where(F.col("m") >= least).select("box")
    cores = durable(placed.join(thick, "box", "left_semi").unionByName(loose.join(counts.where(F.col("m") >= least).select(F.col("asker").alias("rep")), "rep", "left_semi")))

    # Links of boxes: pairs of offsets, each once, and the direction between them.
    steps = [s for s in itertools.product(range(-2, 3), repeat=dims) if s > (0,) * dims]
    sign = lambda s: tuple((c > 0) - (c < 0) for c in s)
    heads = sorted({sign(s) for s in steps})
    outer = lambda h, back: F.max(F.struct(sum((x[i] * float(-h[i] if back else h[i]) for i in axes), F.lit(0.0)).alias("o"), *x)).alias(("b" if back else "f") + str(heads.index(h)))
    edges = [f(c).alias(f"{name}{i}") for i, c in enumerate(x) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = durable(cores.groupBy("box").agg(F.min("rep").alias("first"), F.count("*").alias("c"), *edges, *[outer(h, back) for h in heads for back in (False, True)]))
    ways = F.array(*[F.struct(F.lit(sum(c * _AXIS ** (dims - 1 - i) for i, c in enumerate(s))).alias("step"), F.lit(heads.index(sign(s))).alias("head"), F.col(f"f{heads.index(sign(s))}").alias("p")) for s in steps])
    ahead = boxes.select("box", F.explode(ways).alias("w")).select(F.col("box").alias("a"), (F.col("box") + F.col("w.step")).alias("b"), "w.head", "w.p")
    behind = boxes.select(F.col("box").alias("b"), F.posexplode(F.array(*[F.col(f"b{k}") for k in range(len(heads))])).alias("head", "q"))
    met = sum(((F.col("p")[f"x{i}"] - F.col("q")[f"x{i}"]) * (F.col("p")[f"x{i}"] - F.col("q")[f"x{i}"]) for i in axes), F.lit(0.0)) <= F.lit(eps * eps)
    pairs = durable(ahead.join(behind, ["b", "head"]).select("a", "b", met.alias("met")))
    links = pairs.where("met").select("a", "b")
    labels = settled_labels(links, "a", "b", rounds)
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"_{name}"))
    open_ = pairs.where("not met").join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    bounds = lambda name, mark: boxes.select(F.col("box").alias(name), F.col("c").alias(f"{mark}c"), *[F.col(f"{e}{i}").alias(f"{mark}{e}{i}") for i in axes for e in ("lo", "hi")])
    gap = lambda low_, high, low2, high2: F.greatest(F.lit(0.0), low_ - high2, low2 - high)
    apart = sum((F.pow(gap(F.col(f"alo{i}"), F.col(f"ahi{i}"), F.col(f"blo{i}"), F.col(f"bhi{i}")), 2) for i in axes), F.lit(0.0))
    open_ = durable(open_.join(bounds("a", "a"), "a").join(bounds("b", "b"), "b").where(apart <= reach * reach).withColumns({"na": F.ceil(F.col("ac") / BLOCK), "nb": F.ceil(F.col("bc") / BLOCK)}))

    def side_of(own: str, other: str) -> DataFrame:
        """Core vectors of one box of each open pair that are near enough the other's bounds, dealt to blocks that meet each block of the other."""
        rows = open_.join(cores.select(F.col("box").alias(own), "rep", *x), own)
        off = sum((F.pow(gap(x[i], x[i], F.col(f"{other}lo{i}"), F.col(f"{other}hi{i}")), 2) for i in axes), F.lit(0.0))
        rows = rows.where(off <= reach * reach).withColumns({f"k{own}": F.pmod(F.xxhash64("rep"), F.col(f"n{own}")).cast("int"), f"k{other}": F.explode(F.sequence(F.lit(0), F.col(f"n{other}").cast("int") - 1))})
        names = ["a", "b", "ka", "kb", *(f"x{i}" for i in axes)]
        return rows.select(*names).toDF(*names).groupBy("a", "b", "ka", "kb")  # columns of its own: both sides come from one table

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        stacked = [np.stack([t.column(f"x{i}").to_numpy() for i in axes], 1) for t in (left, right)]
        found = left.num_rows and right.num_rows and _touch(*stacked, eps)
        return pa.table({c: left.column(c).slice(0, 1 if found else 0) for c in ("a", "b")})

    late = durable(side_of("a", "b").cogroup(side_of("b", "a")).applyInArrow(searched, "a bigint, b bigint").distinct())
    if not late.isEmpty():
        labels = settled_labels(links.union(late), "a", "b", rounds)
    joined = durable(boxes.select("box", "first").join(labels, F.col("box") == F.col("node"), "left").select("box", "first", F.coalesce("label", "box").alias("label")))
    clusters = durable(joined.join(joined.groupBy("label").agg(F.min("first").alias("cluster")), "label").select("box", "cluster"))
    inner = durable(cores.join(clusters, "box").select("rep", "tile", *x, "cluster"))
    border = visiting(loose.join(cores.select("rep"), "rep", "left_anti")).join(inner.drop("rep"), "tile").where(near).groupBy("asker").agg(F.min("cluster").alias("cluster"))
    outside = loose.join(cores.select("rep"), "rep", "left_anti").join(border.withColumnRenamed("asker", "rep"), "rep", "left")
    return inner.select("rep", F.lit(True).alias("core"), "cluster").unionByName(outside.select("rep", F.lit(False).alias("core"), "cluster"))


def density_clusters(rows: DataFrame, key: str, vector: str, eps: float, least: int, cell_rows: int = 2000, rounds: int = 60) -> DataFrame:
    """Key, core, cluster (the smallest core key of the cluster, null for noise) of DBSCAN.

    Equal vectors become one with their number.  Vectors are dealt to Voronoi cells of about ``cell_rows``, and each is also a guest where it may be within
    ``eps`` of a cell's member: a halo.  A cell's task counts its members' neighbours, which makes them core or not, and then joins the core vectors it
    sees to local clusters; clusters of different cells that share a core vector are joined by their labels.  No table of pairs is made.  A border
    vector goes to the smallest cluster key among its core neighbours.  Cells that hold too many get pivots of their own, up to 4,096 pivots in all.
    Null vectors have no row; an empty table gives none.  Vectors of at most three dimensions go over a grid instead (``_grid_clusters``), whose work does not
    depend on how many vectors a cell of the space holds.
    """
    from .cluster import settled_labels

    own = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    kind = dict(own.dtypes)["key"]
    points = durable(own.groupBy("v").agg(F.min("key").alias("rep"), F.count("*").alias("n")))
    ends = [f(F.get("v", F.lit(i))).alias(f"{name}{i}") for i in range(3) for name, f in (("lo", F.min), ("hi", F.max))]
    total = points.agg(F.count("*").alias("size"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"), *ends).first()
    size, dims = total.size, total.most
    if not size:
        return own.select("key", F.lit(False).alias("core"), F.lit(None).cast(kind).alias("cluster")).withColumnRenamed("key", key)
    if total.least == dims and 1 <= dims <= 3 and eps > 0 and all(total[f"hi{i}"] - total[f"lo{i}"] < eps / 2 * (_AXIS - 64) for i in range(dims)):
        named = points.join(_grid_clusters(points, [total[f"lo{i}"] for i in range(dims)], eps, least, rounds), "rep").select("v", "core", "cluster")
        return own.join(named, "v").select(F.col("key").alias(key), "core", "cluster")
    centres = pivots_of(points, "rep", "v", min(4096, max(1, -(-size // cell_rows))))
    for _ in range(4):
        cells = durable(celled(points, "v", centres))
        heavy = [r.cell for r in cells.groupBy("cell").agg(F.count("*").alias("c")).where(F.col("c") > 2 * cell_rows).select("cell").collect()]
        if not heavy or len(centres) >= 4096:
            break
        more = pivots_of(cells.where(F.col("cell").isin(heavy)), "rep", "v", min(4096 - len(centres), 4 * len(heavy)))
        centres = np.unique(np.concatenate([centres, more]), axis=0)
    far = np.full(len(centres), -np.inf)
    for r in cells.groupBy("cell").agg(F.max("reach").alias("f")).collect():  # a row a pivot
        far[r.cell] = r.f

    def guests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector in its own cell and in those where it may have neighbours; ``place`` is its distance to the cell's pivot."""
        for batch in batches:
            if not batch.num_rows:
                continue
            d, cell = _distances(matrix(batch.column("v")), centres), batch.column("cell").to_numpy()
            slack = eps + 1e-9
            go = ((d - d[np.arange(len(cell)), cell][:, None]) / 2 <= slack) & (d - far <= slack)
            go[np.arange(len(cell)), cell] = True
            at, to = np.nonzero(go)
            take = lambda c: batch.column(c).take(pa.array(at))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([take("rep"), take("v"), take("n"), pa.array(to.astype(np.int32)), pa.array(d[at, to]), pa.array(cell[at] == to)], ["rep", "v", "n", "cell", "place", "member"])

    seen = durable(cells.select("rep", "v", "n", "cell").mapInArrow(guests, f"rep {kind}, v array<double>, n bigint, cell int, place double, member boolean"))

    def counted(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        x, place, n = matrix(table.column("v")), table.column("place").to_numpy(), table.column("n").to_numpy()
        members = np.flatnonzero(table.column("member").to_numpy())
        core = [bool(n[_near(x, place, i, eps)].sum() >= least) for i in members.tolist()]
        return pa.table({"rep": table.column("rep").take(pa.array(members)), "core": pa.array(core, pa.bool_())})

    cores = durable(seen.groupBy("cell").applyInArrow(counted, f"rep {kind}, core boolean"))

    def joined(table: pa.Table) -> pa.Table:
        """For each core vector seen and each member near one: rep, core, and the label of a local cluster (its smallest core vector)."""
        table = table.sort_by("place")
        x, place, reps = matrix(table.column("v")), table.column("place").to_numpy(), table.column("rep").to_pylist()
        core, member = table.column("core").to_numpy(), table.column("member").to_numpy()
        label = np.full(len(x), -1)
        for i in np.flatnonzero(core).tolist():
            if label[i] >= 0:
                continue
            label[i], open_ = i, [i]
            while open_:
                near = _near(x, place, open_.pop(), eps)
                near = near[core[near] & (label[near] < 0)]
                label[near] = i
                open_ += near.tolist()
        smallest: dict[int, object] = {}
        for i in np.flatnonzero(core).tolist():
            smallest[label[i]] = min(reps[i], smallest.get(label[i], reps[i]))
        out = [(reps[i], True, smallest[label[i]]) for i in np.flatnonzero(core).tolist()]
        for i in np.flatnonzero(member & ~core).tolist():
            near = _near(x, place, i, eps)
            out += [(reps[i], False, smallest[c]) for c in np.unique(label[near[core[near]]]).tolist()]
        return pa.table({c: pa.array([r[j] for r in out], t) for j, (c, t) in enumerate((("rep", table.schema.field("rep").type), ("core", pa.bool_()), ("label", table.schema.field("rep").type)))})

    local = durable(seen.join(cores, "rep").groupBy("cell").applyInArrow(joined, f"rep {kind}, core boolean, label {kind}").distinct())
    # A core vector may be seen in several cells: its labels are one cluster's.
    shared = local.where("core").groupBy("rep").agg(F.min("label").alias("a")).join(local.where("core"), "rep").where("a <> label").select("a", F.col("label").alias("b")).distinct()
    merged = settled_labels(shared, "a", "b", rounds).withColumnRenamed("label", "merged")
    final = local.join(merged, F.col("label") == F.col("node"), "left").groupBy("rep").agg(F.min(F.coalesce("merged", "label")).alias("cluster"))
    named = points.join(cores, "rep").join(final, "rep", "left").select("v", "core", "cluster")
    return own.join(named, "v").select(F.col("key").alias(key), "core", "cluster")


def noise_profile(labelled: DataFrame, rate: str) -> DataFrame:
    """In one row the clusters, the share of noise, and the mean of ``rate`` among noise and among core rows (null where there is none)."""
    noise = F.col("cluster").isNull()
    return labelled.agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"), F.avg(noise.cast("int")).alias("noise_share"), F.avg(F.when(noise, F.col(rate))).alias("noise_rate"), F.avg(F.when(F.col("core"), F.col(rate))).alias("core_rate"))
