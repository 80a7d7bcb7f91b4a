"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Vectors that the centroids are fitted on (the driver gets these, no more), bounds of the centroids of each half, rounds of Lloyd's algorithm.
SAMPLE, CENTROIDS, ROUNDS = 20_000, (32, 512), 12
#: Different vectors that a cell should hold: as many as take about the time that the heap takes for a cell.
CELL = 16
#: Share of true neighbours that the calibration on the sample asks for, and how many sampled queries it takes.
RECALL, PROBES = 0.95, 200
#: Stored vectors of a group of cells (a larger cell is split), and queries that meet them at a time.
GROUP_ROWS, BLOCK = 4_096, 1_024


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def lloyd(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of at most ``k`` clusters, begun at points far from one another."""
    rng, centres = np.random.default_rng(seed), [points[0]]
    away = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and away.max() > 0:
        centres.append(points[rng.choice(len(points), p=away / away.sum())])
        away = np.minimum(away, ((points - centres[-1]) ** 2).sum(axis=1))
    centres = np.array(centres)
    for _ in range(rounds):
        near = squared(points, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = points[near == c].mean(axis=0)
    return centres


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :]


def cells_by_distance(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Centroid pairs by rising sum of both distances: a heap holds the pairs whose predecessors have been visited."""
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, pushed = [(first[rows[0]] + second[columns[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(rows[i]), int(columns[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(rows) and y < len(columns) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (first[rows[x]] + second[columns[y]], x, y))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def visited_share(sample: np.ndarray, first: np.ndarray, second: np.ndarray, k: int) -> float:
    """The share of all vectors that a traversal must reach for ``RECALL`` of the true neighbours, measured on the sample.

    Sampled queries are compared with the whole sample; each true neighbour asks for as many vectors as the cells up to its own hold.
    """
    half = first.shape[1]
    probes = sample[: min(PROBES, len(sample))]
    a, b = squared(sample[:, :half], first).argmin(axis=1), squared(sample[:, half:], second).argmin(axis=1)
    cell, needed = a * len(second) + b, []
    held = np.bincount(cell, minlength=len(first) * len(second))
    for i, q in enumerate(probes):
        away = ((sample - q) ** 2).sum(axis=1)
        away[i] = np.inf
        true = np.argsort(away, kind="stable")[: min(k, len(sample) - 1)]
        order = np.argsort((squared(q[None, :half], first)[0][:, None] + squared(q[None, half:], second)[0][None, :]).ravel(), kind="stable")
        reached = np.empty(len(order))
        reached[order] = np.cumsum(held[order])
        needed.extend(reached[cell[true]])
    return float(np.quantile(needed, RECALL)) / len(sample) if needed else 1.0


def centroids_for(rows: int) -> int:
    """Centroids of each half: with n vectors about sqrt(n / CELL), so that cells stay small as the table grows."""
    return int(np.clip(np.ceil(np.sqrt(rows / CELL)), *CENTROIDS))


class Cells:
    """Where the vectors of each cell lie: consecutive cells fill groups of about ``GROUP_ROWS``, and a larger cell has groups of its own."""

    def __init__(self, different: np.ndarray, rows: np.ndarray) -> None:
        self.different = different
        self.parts = np.maximum(1, -(-rows // GROUP_ROWS))
        self.first = np.zeros(len(rows), np.int64)
        number, filled = 0, 0
        for cell in np.flatnonzero(rows).tolist():
            if filled and filled + rows[cell] > GROUP_ROWS:
                number, filled = number + 1, 0
            self.first[cell] = number
            filled += rows[cell]
            if self.parts[cell] > 1:
                number, filled = number + int(self.parts[cell]), 0


def visited(x: np.ndarray, y: np.ndarray, cells: Cells, wanted: int) -> np.ndarray:
    """The cells with vectors that a query at squared distances ``x`` and ``y`` from the halves' centroids visits, until they hold ``wanted`` different vectors."""
    out, found, width = [], 0, len(y)
    for a, b in cells_by_distance(x, y):
        held = cells.different[a * width + b]
        if held:
            out.append(a * width + b)
            found += held
            if found >= wanted:
                break
    return np.array(out, np.int64)


def rerank(ids: np.ndarray, queries: np.ndarray, asked: list[np.ndarray], names: np.ndarray, cells: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, names, distances) of the ``k`` nearest among the stored vectors (sorted by cell) of the cells that each query asks for."""
    rough = np.full((len(ids), len(names)), np.inf)
    own = np.unique(cells)
    begin, end = np.searchsorted(cells, own), np.searchsorted(cells, own, "right")
    wants = np.zeros((len(ids), len(own)), bool)
    for i, c in enumerate(asked):
        at = np.searchsorted(own, c)
        known = at < len(own)
        known[known] = own[at[known]] == c[known]
        wants[i, at[known]] = True
    for j, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        of = np.flatnonzero(wants[:, j])
        if len(of):
            rough[of, a:b] = np.maximum(squared(queries[of], v[a:b]), 0)
    most = np.partition(rough, k, axis=1)[:, k] if len(names) > k + 1 else np.full(len(ids), np.inf)  # one more than k, as the query itself may be among them
    for i, name in enumerate(ids.tolist()):
        at = np.flatnonzero((rough[i] <= most[i] * (1 + 1e-9) + 1e-9) & np.isfinite(rough[i]) & (names != name))
        d = np.sqrt(((v[at] - queries[i]) ** 2).sum(axis=1))
        best = np.lexsort((names[at], d))[:k]
        yield name, names[at[best]], d[best]


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, wanted: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows that ``queries`` selects: the ``k`` nearest other rows found, by
    Euclidean distance in double precision, ties to the smaller vec_id.

    Null, empty or zero vectors and those with null or non-finite components take no part, nor do rows without an id or of
    another length than most have.  Each half of a vector has centroids fitted on at most ``SAMPLE`` vectors, the more the more rows there are (see
    ``centroids_for``); all vectors are indexed by their
    pair of centroids.  A query visits pairs by summed distance until they hold ``wanted`` different vectors; by default as large a share of
    all as finds 95 % of the true neighbours within the sample (data without clusters ask for a large one).  Equal vectors are one entry with its k + 1
    smallest ids, which is exact, as ties go to smaller ids; so a vector that fills a third of the table fills no cell.
    Of rows that repeat a vec_id the smallest vector counts.  An empty table gives no rows.

    Cells lie in groups of about ``GROUP_ROWS`` stored vectors; a query goes once to each group that holds cells it visits, with their numbers.  A group that
    more than ``BLOCK`` queries reach is sent to as many tasks as there are blocks of them, so a task's vectors and queries are bounded both.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    width = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    (width, total), half = width, (width[0] + 1) // 2
    rows = rows.where(F.size("v") == width)
    sample = _matrix(rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toArrow().column("v"), width)
    first, second = (lloyd(x, centroids_for(total), ROUNDS, i) if x.shape[1] else np.zeros((1, 0)) for i, x in enumerate((sample[:, :half], sample[:, half:])))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), width)
                cell = squared(v[:, :half], first).argmin(axis=1) * len(second) + squared(v[:, half:], second).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    own = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.select("v", "vec_id").withColumn("copy", F.row_number().over(own)).where(F.col("copy") <= k + 1)
    entries = durable(entries.mapInArrow(place, "v array<double>, vec_id long, copy int, cell int"))
    different, stored_rows = (np.zeros(len(first) * len(second), np.int64) for _ in range(2))
    for cell, n, m in entries.groupBy("cell").agg(F.count_if(F.col("copy") == 1), F.count("*")).collect():  # as many rows as pairs of centroids
        different[cell], stored_rows[cell] = n, m
    cells = Cells(different, stored_rows)
    if wanted is None:
        distinct = np.unique(sample, axis=0)
        distinct = distinct[np.random.default_rng(0).permutation(len(distinct))]
        wanted = int(np.ceil(visited_share(distinct, first, second, k) * different.sum()))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                v, out = _matrix(part.column("v"), width), []
                for j, (x, y) in enumerate(zip(squared(v[:, :half], first), squared(v[:, half:], second), strict=True)):
                    asked = np.sort(visited(x, y, cells, wanted))
                    group, parts = cells.first[asked], cells.parts[asked]
                    whole = parts == 1
                    for own in np.split(np.flatnonzero(whole), np.flatnonzero(np.diff(group[whole])) + 1):
                        if len(own):
                            out.append((j, int(group[own[0]]), asked[own].astype("<i4").tobytes()))
                    out += [(j, int(group[c]) + p, asked[c : c + 1].astype("<i4").tobytes()) for c in np.flatnonzero(~whole).tolist() for p in range(int(parts[c]))]
                take = pa.array([r[0] for r in out], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in out], pa.int32()), part.column("vec_id").take(take), part.column("v").take(take), pa.array([r[2] for r in out], pa.binary())], ["group", "query_id", "q", "asked"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, spread = (batch.column(c).to_numpy() for c in ("cell", "spread"))
            group = cells.first[cell] + spread % cells.parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), *(batch.column(c) for c in ("vec_id", "v", "cell"))], ["group", "vec_id", "v", "cell"])

    def search(asked: pa.Table, stored: pa.Table) -> pa.Table:
        cell = stored.column("cell").to_numpy()
        by = np.argsort(cell, kind="stable")
        out = [(name, int(n), float(d)) for name, near, away in rerank(asked.column("query_id").to_numpy(), _matrix(asked.column("q"), width), [np.frombuffer(c.as_buffer(), "<i4") for c in asked.column("asked")], stored.column("vec_id").to_numpy()[by], cell[by], _matrix(stored.column("v"), width)[by], k) for n, d in zip(near, away, strict=True)]
        return pa.table({c: pa.array([r[j] for r in out], kind) for j, (c, kind) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    visits = durable(rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(visit, "group int, query_id long, q array<double>, asked binary"))
    reached = visits.groupBy("group").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    visits = visits.join(reached, "group").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).select("group", "block", "query_id", "q", "asked")
    stored = entries.withColumn("spread", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))).mapInArrow(store, "group int, vec_id long, v array<double>, cell int")
    stored = stored.join(reached.toDF("group", "of"), "group").select(F.col("group").alias("group"), F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("block"), "vec_id", "v", "cell")
    found = visits.groupBy("group", "block").cogroup(stored.groupBy("group", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
