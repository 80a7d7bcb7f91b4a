"""Gradient-boosted trees on binned features, several targets at once."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import durable

#: Rounds after which the rows' margins are written anew, so that a pass adds up at most so many trees.
FOLD = 16

#: Rows of a pass's task: small tables are spread over the cores in tasks of at least the first number, large ones have tasks of about the second.
TASK = (4096, 50_000)

#: Up to so many tasks send their sums to the driver at once; those of more are added up by other tasks first.
FEW = 32

#: Tables whose bins are at most so many bytes are fitted within tasks, one a target: each level of theirs costs less than starting a job does.
ALONE = 64 << 20

#: Rows whose sums are made at once, so that they stay near the processor.
SLICE = 32_768


@dataclass
class Tree:
    """A complete binary tree over bins, breadth first: node n's children are 2n + 1 and 2n + 2; feature -1 sends all to the left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    weight: np.ndarray

    def leaves(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each column of ``bins`` (a row a feature) reaches after ``levels`` tests: nodes are chosen from the last level upwards."""
        kind = np.uint8 if levels < 8 else np.int32

        def reached(n: int, level: int) -> np.ndarray:
            while level < levels and self.feature[n] < 0:
                n, level = 2 * n + 1, level + 1
            if level == levels:
                return np.array(n, kind)
            return np.where(bins[self.feature[n]] > self.cut[n], reached(2 * n + 2, level + 1), reached(2 * n + 1, level + 1))

        return np.broadcast_to(reached(0, 0), bins.shape[1:])


@dataclass
class Ensemble:
    """A target's trees: the margin is ``base`` and the trees' values; ``cuts`` are the upper bounds of each feature's bins but the last."""

    base: float
    cuts: list[np.ndarray]
    depth: int
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts).T.copy()
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.leaves(bins, self.depth)]
        return out

    def arrays(self) -> list[tuple[np.ndarray, ...]]:
        """The trees as feature (-1 for leaves), threshold, left, right, value and weight, as contributions need them; empty sides are left out."""
        out = []
        for t in self.trees:
            rows: list[list[float]] = []

            def walk(n: int, level: int, t: Tree = t, rows: list = rows) -> int:
                while level < self.depth and t.feature[n] < 0:
                    n, level = 2 * n + 1, level + 1
                k = len(rows)
                rows.append([-1, 0.0, 0, 0, t.value[n], t.weight[n]])
                if level < self.depth:
                    f = int(t.feature[n])
                    rows[k][:2] = f, self.cuts[f][t.cut[n]]
                    rows[k][2], rows[k][3] = walk(2 * n + 1, level + 1), walk(2 * n + 2, level + 1)
                return k

            walk(0, 0)
            out.append(tuple(np.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (int, float, int, int, float, float), strict=True)))
        return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many cuts are below it; a missing value is in the first."""
    out = np.zeros(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(c, np.where(np.isnan(x[:, f]), -np.inf, x[:, f]), "left")
    return out


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]) if columns else np.zeros((batch.num_rows, 0))


def _loss(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Sum of the logistic losses, and the rows."""
    return np.array([(np.logaddexp(0, margin) - y * margin).sum(), len(y)])


def _packing(x: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewer features of at most ``bins`` bins that hold all of ``x`` (a row a feature): equal ones once, and those of few bins joined.

    Also gives the place of each feature among these, and for each feature a matrix that turns the sums by their bins into its own.
    """
    seen: dict[bytes, int] = {}
    which = [seen.setdefault(v.tobytes(), len(seen)) for v in x]
    different = x[[which.index(u) for u in range(len(seen))]]
    widths = different.max(1, initial=0).astype(int) + 1
    place, step = np.zeros(len(different), int), np.ones(len(different), int)
    full: list[int] = []  # product of the widths that each packed feature holds
    for u in np.argsort(widths, kind="stable").tolist():
        if not full or full[-1] * widths[u] > bins:
            full.append(1)
        place[u], step[u] = len(full) - 1, full[-1]
        full[-1] *= widths[u]
    out = np.zeros((len(full), x.shape[1]), np.uint8)
    for u, values in enumerate(different):
        out[place[u]] += (values * step[u]).astype(np.uint8)
    j = np.arange(bins)
    turns = np.array([(j // step[u] % widths[u] == j[:, None]) & (j < full[place[u]]) for u in which], float)
    return out, place[which], turns


def _sums(x: np.ndarray, y: np.ndarray, margin: np.ndarray, leaf: np.ndarray, level: int, nodes: list[int], bins: int) -> np.ndarray:
    """Gradient, curvature and rows by node (of ``nodes``, on the level), feature and bin of the columns of ``x``, which have reached the nodes ``leaf``."""
    out = np.zeros((3, len(x), len(nodes) * bins))
    slot = np.full(2 << level, -1)
    slot[nodes] = np.arange(len(nodes))
    for a in range(0, x.shape[1], SLICE):
        own = slot[leaf[a : a + SLICE]]
        at = np.flatnonzero(own >= 0)
        whole = len(at) == len(own)
        part, place = (x[:, a : a + SLICE], own * bins) if whole else (x[:, a : a + SLICE].take(at, 1), own[at] * bins)
        z, t = (margin[a : a + SLICE], y[a : a + SLICE]) if whole else (margin[a + at], y[a + at])
        p = 1 / (1 + np.exp(-z))
        g, h = p - t, p * (1 - p)
        for f, values in enumerate(part):
            to = place + values
            out[0, f] += np.bincount(to, g, len(nodes) * bins)
            out[1, f] += np.bincount(to, h, len(nodes) * bins)
            out[2, f] += np.bincount(to, None, len(nodes) * bins)
    return out.reshape(3, len(x), len(nodes), bins).transpose(2, 1, 0, 3)


def fit(rows: DataFrame, columns: tuple[str, ...], labels: tuple[str, ...], split: str = "split", rounds: int = 1500, patience: int = 50, rate: float = 0.05, depth: int = 4, bins: int = 32, penalty: float = 1.0, least: float = 5.0) -> dict[str, Ensemble]:
    """An ensemble for each of ``labels`` (0 or 1), grown on the rows of split ``train`` and stopped on those of ``calibration``.

    Features are binned once, at quantiles of the training rows, and the bins, labels and margins of some thousand rows at a time kept as one block of arrays.
    A level of the trees of all targets takes one pass over the blocks, a job of one stage: each task adds up gradients and curvatures by target, node, feature and bin, these are summed, and the driver, which gets ``bins`` numbers for each of them whatever the input, chooses the splits.  Of two
    children only the one of fewer rows is summed, the other is what is left of their parent.  The first pass of a round also gives the
    loss on the calibration rows; a target rests when that has not fallen for ``patience`` rounds, and keeps the trees up to its best one.  Rows
    keep their margins, written anew every ``FOLD`` rounds.  Tables of at most ``ALONE`` bytes of bins take the same steps within a task a target.  A node with less curvature
    than ``least`` on a side is not split.  Columns may miss values; labels may not.  Without training rows, or with one class alone, a target has no trees.
    """
    names, targets = list(columns), list(labels)
    kept = rows.where(F.col(split).isin("train", "calibration"))
    levels = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    train = F.col(split) == "train"
    first = kept.agg(*[F.percentile_approx(F.when(train, F.col(c).cast("double")), levels, 1000).alias(f"q{i}") for i, c in enumerate(names)], *[F.avg(F.when(train, F.col(t))).alias(f"p{i}") for i, t in enumerate(targets)], F.count("*").alias("n")).first()
    cuts = [np.unique(np.array(first[f"q{i}"] or [], float)) for i in range(len(names))]
    base = [float(np.log(p / (1 - p))) if p is not None and 0 < p < 1 else 0.0 for p in (first[f"p{i}"] for i in range(len(targets)))]
    found = {i: Ensemble(b, cuts, depth) for i, b in enumerate(base)}
    going = {i for i in range(len(targets)) if first[f"p{i}"] is not None and 0 < first[f"p{i}"] < 1}

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block of arrays for each batch, with its place: bins (a row a feature), labels and margins of its training and of its calibration rows."""
        for i, batch in enumerate(batches):
            if batch.num_rows:
                x, y, own = binned(_matrix(batch, names), cuts).T, _matrix(batch, targets).T.astype(np.uint8), batch.column("_train").to_numpy(zero_copy_only=False)
                block = [(np.ascontiguousarray(x[:, m]), np.ascontiguousarray(y[:, m]), np.tile(np.array(base)[:, None], int(m.sum()))) for m in (own, ~own)]
                yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + i]), pa.array([pickle.dumps(block)], pa.binary())], ["place", "block"])

    def split_nodes(tree: Tree, level: int, sums: np.ndarray) -> None:
        for n, own in enumerate(sums, (1 << level) - 1):  # feature, kind, bin
            g, h, c = own[:, 0].sum(1)[0], own[:, 1].sum(1)[0], own[:, 2].sum(1)[0]
            tree.value[n], tree.weight[n] = -rate * g / (h + penalty), c
            left = np.cumsum(own, 2)[:, :, :-1]
            gl, hl = left[:, 0], left[:, 1]
            gain = gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty)
            gain[(hl < least) | (h - hl < least)] = 0.0
            f, b = np.unravel_index(gain.argmax(), gain.shape)
            if gain[f, b] > 1e-9 and b < len(cuts[f]):
                tree.feature[n], tree.cut[n] = f, b
                for side, mine in ((2 * n + 1, left[f, :, b]), (2 * n + 2, own[f].sum(1) - left[f, :, b])):
                    tree.value[side], tree.weight[side] = -rate * mine[0] / (mine[1] + penalty), mine[2]
            else:
                tree.value[2 * n + 1], tree.weight[2 * n + 1] = tree.value[n], c

    def grown(found: dict[int, Ensemble], going: set[int], measured: Callable[[int, dict[int, tuple[Tree, list[int]]]], dict[int, tuple[np.ndarray, np.ndarray]]], settled: Callable[[dict[int, Tree]], None]) -> None:
        """Grows the targets ``going``: ``measured`` gives for each its sums of the named nodes of a level, with the calibration loss and rows, and ``settled`` takes a round's trees."""
        for _ in range(rounds + 1):
            now = {t: Tree(np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64), np.zeros((2 << depth) - 1), np.zeros((2 << depth) - 1)) for t in sorted(going)}
            above: dict[int, np.ndarray] = {}
            for level in range(depth):
                if not now:
                    return
                start, asked = (1 << level) - 1, {}
                for t, tree in now.items():
                    halves = [2 * n + 1 if tree.weight[2 * n + 1] <= tree.weight[2 * n + 2] else 2 * n + 2 for n in range(start // 2, start) if tree.feature[n] >= 0]
                    asked[t] = (tree, halves if level else [0])
                made = measured(level, asked) if any(nodes for _, nodes in asked.values()) else {t: (np.empty(0), None) for t in asked}
                for t, (tree, nodes) in asked.items():
                    own, (loss, n) = made[t][0], made[t][1] if level == 0 else (0, 0)
                    if level == 0:
                        found[t].losses.append(loss / n if n else 0.0)
                        if len(found[t].losses) > rounds or len(found[t].losses) - 1 - int(np.argmin(found[t].losses)) >= patience:
                            going.discard(t)
                            del now[t]
                            continue
                        sums = own
                    else:
                        sums = np.zeros((1 << level, *above[t].shape[1:]))
                        sums[::2] = above[t]  # nodes without a split send all to the left
                        for i, n in enumerate(nodes):
                            other = n + 1 if n % 2 else n - 1
                            sums[n - start], sums[other - start] = own[i], above[t][(n - start) // 2] - own[i]
                    above[t] = sums
                    split_nodes(tree, level, sums)
            for t, tree in now.items():
                found[t].trees.append(tree)
            if now:
                settled(now)

    width = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-first["n"] // TASK[0]), width * -(-first["n"] // (TASK[1] * width))))
    blocks = durable(kept.select(*names, *targets, train.alias("_train")).repartition(parts).mapInArrow(prepared, "place bigint, block binary")).rdd
    if first["n"] * len(names) <= ALONE:

        def alone(own: Iterator[tuple[int, tuple[int, bytes]]]) -> Iterator[tuple[int, list[Tree], list[float]]]:
            """The ensemble of the partition's target, from all blocks."""
            kept, target = [], None
            for target, (place, block) in own:
                kept.append((place, [(x, y[target], margin[target]) for x, y, margin in pickle.loads(block)]))
            if target is None:
                return
            sides = [[np.concatenate(c, -1) for c in zip(*own, strict=True)] for own in zip(*(b for _, b in sorted(kept, key=lambda k: k[0])), strict=True)]
            kept.clear()
            x, y, margin = sides[0]
            held, held_y, held_margin = sides[1]
            packed, place, turns = _packing(x, bins)

            def measured(level: int, asked: dict[int, tuple[Tree, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
                tree, nodes = asked[target]
                made = _sums(packed, y, margin, tree.leaves(x, level), level, nodes, bins)
                return {target: (np.einsum("nfkj,fbj->nfkb", made[:, place], turns), _loss(held_y, held_margin) if level == 0 else None)}

            def settled(now: dict[int, Tree]) -> None:
                for bins_, to in ((x, margin), (held, held_margin)):
                    to += now[target].value[now[target].leaves(bins_, depth)]

            mine = Ensemble(base[target], cuts, depth)
            grown({target: mine}, {target}, measured, settled)
            yield target, mine.trees, mine.losses

        asking = sorted(going)
        each = blocks.flatMap(lambda r: [(t, (r.place, bytes(r.block))) for t in asking])
        for t, trees, losses in each.partitionBy(max(1, len(asking)), asking.index).mapPartitions(alone).collect():
            found[t].trees, found[t].losses = trees, losses
    else:
        data = blocks.map(lambda r: pickle.loads(r.block)).persist(StorageLevel.MEMORY_AND_DISK)
        pending: list[dict[int, Tree]] = []

        def added(x: np.ndarray, margin: np.ndarray, pending: list[dict[int, Tree]]) -> np.ndarray:
            out = margin.copy()
            for trees in pending:
                for t, tree in trees.items():
                    out[t] += tree.value[tree.leaves(x, depth)]
            return out

        def measured(level: int, asked: dict[int, tuple[Tree, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            sizes, late = {t: len(nodes) * len(names) * 3 * bins for t, (_, nodes) in asked.items()}, list(pending)

            def run(own: Iterator[list[tuple[np.ndarray, ...]]]) -> Iterator[np.ndarray]:
                total, loss = {t: 0.0 for t in asked}, {t: np.zeros(2) for t in asked}
                for (x, y, margin), (held, held_y, held_margin) in own:
                    margin = added(x, margin, late)
                    z = added(held, held_margin, late) if level == 0 else None
                    for t, (tree, nodes) in asked.items():
                        if nodes:
                            total[t] = total[t] + _sums(x, y[t], margin[t], tree.leaves(x, level), level, nodes, bins)
                        if level == 0:
                            loss[t] += _loss(held_y[t], z[t])
                yield np.concatenate([v for t in asked for v in (np.broadcast_to(total[t], (sizes[t],)) if np.isscalar(total[t]) else total[t].ravel(), loss[t])])

            sums = data.mapPartitions(run)
            flat = sum(sums.collect()) if parts <= FEW else sums.treeReduce(np.add)
            out, at = {}, 0
            for t, (_, nodes) in asked.items():
                out[t] = flat[at : at + sizes[t]].reshape(len(nodes), len(names), 3, bins), flat[at + sizes[t] : at + sizes[t] + 2]
                at += sizes[t] + 2
            return out

        def settled(now: dict[int, Tree]) -> None:
            nonlocal data
            pending.append(now)
            if len(pending) == FOLD:
                folded, before = list(pending), data
                data = before.map(lambda block: [(x, y, added(x, margin, folded)) for x, y, margin in block]).persist(StorageLevel.MEMORY_AND_DISK)
                data.checkpoint()  # or every fold would keep all those before it
                data.count()
                before.unpersist()
                pending.clear()

        grown(found, going, measured, settled)
        data.unpersist()
    for own in found.values():  # losses[i] is that of the first i trees
        own.trees = own.trees[: int(np.argmin(own.losses))] if own.losses else []
    return {targets[i]: own for i, own in found.items()}


def margins(rows: DataFrame, columns: tuple[str, ...], ensembles: dict[str, Ensemble]) -> DataFrame:
    """``rows`` (of simple types) with a column ``margin_<target>`` for each ensemble, by Arrow batches."""
    names, carried, made = list(columns), rows.columns, {f"margin_{t}": e for t, e in ensembles.items()}
    used = rows.withColumns({f"_m_{c}": F.col(c).cast("double") for c in names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"_m_{c}").to_numpy(zero_copy_only=False).astype(float) for c in names])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *(pa.array(e.margins(x)) for e in made.values())], [*carried, *made])

    return used.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), *(f"`{m}` double" for m in made)]))

