"""The prefix trie of conversations, with subtree totals by centroid decomposition.

A node is a distinct sequence of first turns.  Its id is a 128-bit running sum of position-tagged turn digests, so prefixes of one long conversation
are numbered by several tasks at once; equal ids with different parents raise an error.  The parent edges form a forest whose components are split at
weighted centroids: by joins while a component has more nodes than one task should hold, within tasks below that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import durable, mix

#: Fewest nodes at which a component is still split by joins; above that, so many that at most 2**16 components are.
COMPONENT = 1 << 14
#: Bytes of listed conversation ids that become one row.
LIST_BYTES = 1 << 16
_ID = ["n1", "n2"]


def _tagged(digests: pa.ChunkedArray | pa.Array, places: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each turn, from its digest's first 16 bytes and its place."""
    words = np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 2)
    d = places.astype(np.uint64)
    return np.stack([mix(words[:, 0] + mix(d + np.uint64(1))), mix(words[:, 1] ^ mix(d * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)))], 1)


def _running(batches: Iterator[pa.RecordBatch], values, carry: tuple[int, np.ndarray] | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with the running sums of ``values(batch)`` within ``conv`` over rows sorted by it; ``carry`` is what earlier partitions summed for a conversation."""
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, v = batch.column("conv").to_numpy(), values(batch)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(conv)) + 1])
        sums = np.cumsum(v, 0)
        before = np.concatenate([np.zeros((1, v.shape[1]), v.dtype), sums])[starts]
        if carry is not None and carry[0] == conv[0]:
            before[0] -= carry[1]
        sums -= np.repeat(before, np.diff(np.append(starts, len(conv))), 0)
        carry = int(conv[-1]), sums[-1].copy()
        yield batch, sums


def _summed(ordered: DataFrame, values, emit, schema: str) -> DataFrame:
    """``emit(batch, sums)`` of every batch of a kept, range-partitioned and sorted table, where a conversation may span partitions.

    The driver gets a row a partition: its first and last conversation and the last one's sums.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch, sums in _running(batches, values, None):
            first = batch.column("conv")[0].as_py() if first is None else first
            last = batch.column("conv")[-1].as_py(), sums[-1].astype(np.uint64).tobytes()
        if last is not None:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": [first], "last": [last[0]], "sums": [last[1]]})

    known = sorted(ordered.mapInArrow(ends, "pid int, first bigint, last bigint, sums binary").collect())
    carries: dict[int, tuple[int, bytes]] = {}
    running: tuple[int, np.ndarray] | None = None
    for pid, first, last, sums in known:
        own = np.frombuffer(sums, np.uint64)
        if running is not None and running[0] == first:
            carries[pid] = first, running[1].tobytes()
            own = own + running[1] if first == last else own
        running = last, own

    def all_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        came = carries.get(TaskContext.get().partitionId())
        for batch, sums in _running(batches, values, came and (came[0], np.frombuffer(came[1], np.uint64).copy())):
            yield emit(batch, sums)

    return ordered.mapInArrow(all_rows, schema)


def ordered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Columns conv, d (1 for the first turn), digest (of role and text) and bytes (of the text).

    Turns are in order of ``turn``, null first, equal ones by their digest; null role or text counts as empty; rows without a conversation are left
    out.  Rows are dealt out by ranges of (conversation, turn), so a conversation of any length is shared between tasks.
    """
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256)), 1, 16)
    turns = rows.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text_).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    ordered = durable(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "bytes"))

    def emit(batch: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(sums[:, 0].astype(np.int64)), batch.column("digest"), batch.column("bytes")], ["conv", "d", "digest", "bytes"])

    return _summed(ordered, lambda b: np.ones((b.num_rows, 1), np.uint64), emit, "conv bigint, d bigint, digest binary, bytes bigint")


def splice(turns: DataFrame, base: Column, reach: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation rebuilt from the first ``reach`` turns (at most ``most``) of conversation ``base`` and its own turns after as many of its own.

    ``base`` and ``reach`` are expressions of the column conv.  Gives the turns (conv, d, digest, bytes, size) and the conversations (conv, size), those
    without a turn included.  A base that is absent lends nothing, a short one all it has.
    """
    lengths = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"base": base, "reach": reach})
    lent = F.least("reach", F.coalesce("base_n", F.lit(0)))
    convs = durable(lengths.join(lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").select("conv", "base", "reach", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("reach"), F.lit(0))).alias("size")))
    heads = turns.where(F.col("d") <= most).withColumnRenamed("conv", "base")
    first = convs.join(heads, "base").where("d <= lent").select("conv", "d", "digest", "bytes", "size")
    rest = turns.where(F.col("d") > reach).join(convs, "conv").select("conv", (F.col("d") - F.col("reach") + F.col("lent")).alias("d"), "digest", "bytes", "size")
    return first.unionByName(rest), convs.select("conv", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth: conv, d, size, bytes, the node's id (n1, n2) and its parent's (p1, p2).  ``turns``: conv, d, digest, bytes, size."""
    ordered = durable(turns.repartitionByRange("conv", "d").sortWithinPartitions("conv", "d"))
    tag = lambda b: _tagged(b.column("digest"), b.column("d").to_numpy())

    def emit(batch: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        parents = sums - tag(batch)
        ids = [pa.array(np.ascontiguousarray(a[:, k]).view(np.int64)) for a in (sums, parents) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "d", "size", "bytes")), *ids], ["conv", "d", "size", "bytes", "n1", "n2", "p1", "p2"])

    return _summed(ordered, tag, emit, "conv bigint, d bigint, size bigint, bytes bigint, n1 bigint, n2 bigint, p1 bigint, p2 bigint")


def _rollup(parents: list[int], weights: list[int], owns: list[list[int]]) -> list[list[int]]:
    """Subtree totals of one component (node 0 is its top, parents precede) by centroid decomposition.

    Each component is cut at its centroid, the deepest node with half of the component's weight below it; the pieces are cut in turn.  Going back, a
    centroid's total is its own value and its pieces' totals, and is added along the path from the centroid to its component's top.
    """
    n = len(parents)
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        children[parents[k]].append(k)
    gone, splits, open_ = [False] * n, [], [0]
    while open_:
        top = open_.pop()
        total, v = weights[top], top
        while True:
            heavy = next((c for c in children[v] if not gone[c] and 2 * weights[c] >= total), None)
            if heavy is None:
                break
            v = heavy
        gone[v] = True
        pieces = [c for c in children[v] if not gone[c]]
        open_ += pieces
        u, lost = v, weights[v]
        while u != top:
            u = parents[u]
            weights[u] -= lost
        if v != top:
            open_.append(top)
        splits.append((v, top, pieces))
    out = [list(o) for o in owns]
    for v, top, pieces in reversed(splits):
        for acc in out:
            acc[v] += sum(acc[c] for c in pieces)
            s, u = acc[v], v
            while u != top:
                u = parents[u]
                acc[u] += s
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of whole components, which come sorted by (c1, c2, depth); at most one component is held besides a batch."""
    names = ("c1", "c2", "n1", "n2", "p1", "p2", "weight", "leaf", "saved", "more_leaves", "more_saved")
    held: list[list[int]] = [[] for _ in names]

    def done(rows: list[list[int]]) -> pa.RecordBatch:
        c1, c2, n1, n2, p1, p2, weight, leaf, saved, more_leaves, more_saved = rows
        leaves, sums, a, n = [], [], 0, len(c1)
        while a < n:
            b = a + 1
            while b < n and c1[b] == c1[a] and c2[b] == c2[a]:
                b += 1
            place = {key: k for k, key in enumerate(zip(n1[a:b], n2[a:b], strict=True))}
            parents = [place.get(key, 0) for key in zip(p1[a:b], p2[a:b], strict=True)]
            found = _rollup(parents, weight[a:b], [leaf[a:b], saved[a:b]])
            leaves += [x + y for x, y in zip(found[0], more_leaves[a:b], strict=True)]
            sums += [x + y for x, y in zip(found[1], more_saved[a:b], strict=True)]
            a = b
        return pa.RecordBatch.from_pydict({"n1": n1, "n2": n2, "n_leaves": leaves, "saved_tokens": sums})

    for batch in batches:
        if not batch.num_rows:
            continue
        for own, name in zip(held, names, strict=True):
            own += batch.column(name).to_pylist()
        c1, c2 = held[0], held[1]
        cut = len(c1) - 1
        while cut > 0 and (c1[cut - 1], c2[cut - 1]) == (c1[-1], c2[-1]):
            cut -= 1
        if cut:
            yield done([h[:cut] for h in held])
            held = [h[cut:] for h in held]
    if held[0]:
        yield done(held)


def subtree_totals(nodes: DataFrame, rows: DataFrame, component: int = COMPONENT) -> DataFrame:
    """Columns n1, n2, n_leaves, saved_tokens: ``leaf`` and ``saved`` summed over each node's subtree.

    ``nodes`` has n1, n2, p1, p2, conv_id (a conversation through the node), depth, weight (more than the children's weights together), leaf and saved;
    ``rows`` are the prefixes.  One round splits every component of more than ``component`` nodes at its centroid.  The nodes with half of the weight
    below them are the path from the top to the centroid, so they get the centroid's total without a walk; what hangs below falls into a component for
    each of the centroid's children, which a node finds as its own conversation's prefix one deeper than the centroid.  Weights halve with each round.
    Only one row a large component is broadcast: at most 2**16 or nodes / component of them.
    """
    most = max(component, nodes.count() >> 16)
    state = nodes.select(*_ID, "p1", "p2", "conv_id", "depth", "weight", "leaf", "saved", F.lit(0).cast("long").alias("c1"), F.lit(0).cast("long").alias("c2"), F.lit(0).cast("long").alias("more_leaves"), F.lit(0).cast("long").alias("more_saved"))
    small, finished = [], []
    while True:
        tops = state.groupBy("c1", "c2").agg(F.max("weight").alias("total"))
        heavy = state.join(F.broadcast(tops), ["c1", "c2"]).where("2 * weight >= total")
        centroids = heavy.groupBy("c1", "c2").agg(F.max("total").alias("total"), F.max(F.struct("depth", "n1", "n2", "weight")).alias("v"))
        met = state.join(F.broadcast(centroids), ["c1", "c2"]).withColumn("next", F.col("v.depth") + 1)
        steps = rows.select(F.col("conv").alias("conv_id"), F.col("d").alias("next"), F.col("n1").alias("x1"), F.col("n2").alias("x2"), F.col("p1").alias("y1"), F.col("p2").alias("y2"))
        deeper = met.where("depth > v.depth").join(steps, ["conv_id", "next"], "left")
        below = F.coalesce((F.col("y1") == F.col("v.n1")) & (F.col("y2") == F.col("v.n2")), F.lit(False))
        others = met.where("depth <= v.depth").withColumns({c: F.lit(None).cast("long") for c in ("x1", "x2", "y1", "y2")})
        labelled = durable(deeper.unionByName(others).withColumns({"below": below, "is_v": (F.col("n1") == F.col("v.n1")) & (F.col("n2") == F.col("v.n2"))}).drop("y1", "y2", "next"))
        sums = labelled.where("below or is_v").groupBy("c1", "c2").agg(F.sum("leaf").alias("v_leaves"), F.sum("saved").alias("v_saved"))
        labelled = labelled.join(F.broadcast(sums), ["c1", "c2"])
        finished.append(labelled.where("is_v").select(*_ID, (F.col("more_leaves") + F.col("v_leaves")).alias("n_leaves"), (F.col("more_saved") + F.col("v_saved")).alias("saved_tokens")))
        path = F.expr("2 * weight >= total")
        # A component's id is its top's: the piece above a centroid keeps it, a piece below takes that of the centroid's child.
        rest = labelled.where("not is_v").select(
            *_ID, "p1", "p2", "conv_id", "depth", (F.col("weight") - F.when(path, F.col("v.weight")).otherwise(0)).alias("weight"), "leaf", "saved",
            F.when(F.col("below"), F.col("x1")).otherwise(F.col("c1")).alias("c1"), F.when(F.col("below"), F.col("x2")).otherwise(F.col("c2")).alias("c2"),
            (F.col("more_leaves") + F.when(path, F.col("v_leaves")).otherwise(0)).alias("more_leaves"), (F.col("more_saved") + F.when(path, F.col("v_saved")).otherwise(0)).alias("more_saved"),
        )
        large = durable(rest.groupBy("c1", "c2").count().where(F.col("count") > most).select("c1", "c2"))
        if large.isEmpty():
            small.append(rest)
            break
        small.append(rest.join(F.broadcast(large), ["c1", "c2"], "left_anti"))
        state = durable(rest.join(F.broadcast(large), ["c1", "c2"], "left_semi"))
    schema = "n1 bigint, n2 bigint, n_leaves bigint, saved_tokens bigint"
    pieces = small[0]
    for more in small[1:]:
        pieces = pieces.unionByName(more)
    out = pieces.repartition("c1", "c2").sortWithinPartitions("c1", "c2", "depth").select("c1", "c2", *_ID, "p1", "p2", "weight", "leaf", "saved", "more_leaves", "more_saved").mapInArrow(_solve, schema)
    for more in finished:
        out = out.unionByName(more)
    return out


def member_lists(ends: DataFrame) -> DataFrame:
    """Columns n1, n2, ends_sha256: SHA-256 of each node's conversation ids, ascending, comma-joined.

    Ids are sorted by ranges of (node, id) and written as text of up to 64 KB a row within the ranges; only these few rows of a node meet in one task,
    which streams them through the hash.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2, conv = (batch.column(c).to_pylist() for c in (*_ID, "conv"))
            rows, a = [], 0
            while a < len(conv):
                b, parts, size = a, [], 0
                while b < len(conv) and n1[b] == n1[a] and n2[b] == n2[a] and size < LIST_BYTES:
                    parts.append(str(conv[b]))
                    size += len(parts[-1]) + 1
                    b += 1
                rows.append((n1[a], n2[a], conv[a], ",".join(parts)))
                a = b
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], [*_ID, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            found = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*_ID, "ids")), strict=True):
                if (a, b) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    found.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], [*_ID, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_pydict({"n1": [key[0]], "n2": [key[1]], "ends_sha256": [state.hexdigest()]})

    order = [*_ID, "conv"]
    lists = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(listed, "n1 bigint, n2 bigint, first bigint, ids string")
    return lists.repartition(*_ID).sortWithinPartitions(*_ID, "first").mapInArrow(hashed, "n1 bigint, n2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, component: int = COMPONENT) -> DataFrame:
    """A row for each node of the trie over conversations: the distinct sequences of first turns, the empty one (the root) included.

    ``turns`` has conv, d, digest, bytes and size, ``convs`` every conversation with its number of turns.  Columns: conv_id (smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (over the subtree: members but one, times the last text's
    bytes), ends_sha256.  Empty tables give no rows, not even a root.  Texts of any length are read once, for their digests.
    """
    rows = prefixes(turns)
    differ = F.when((F.min("p1") != F.max("p1")) | (F.min("p2") != F.max("p2")) | (F.min("d") != F.max("d")), F.raise_error(F.lit("two prefixes share an id")).cast("long"))
    grouped = rows.groupBy(*_ID).agg(F.coalesce(differ, F.min("d")).alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("size") - F.col("d") + 1).alias("weight"), F.max("bytes").alias("bytes"))
    zero = F.lit(0).cast("long")
    root = convs.agg(zero.alias("n1"), zero.alias("n2"), zero.alias("depth"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("size") + 1).alias("weight"), zero.alias("bytes")).where("n_convs > 0")
    nodes = durable(grouped.select(*root.columns).unionByName(root))
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    nodes = durable(nodes.join(children, _ID, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    valued = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    ends = rows.where("d = size").select(*_ID, "conv").unionByName(convs.where("size = 0").select(zero.alias("n1"), zero.alias("n2"), "conv"))
    parents = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.select(*_ID, "p1", "p2", "conv_id", "depth", "n_convs", "n_children").join(parents, ["p1", "p2"], "left")
    out = named.join(subtree_totals(valued, rows, component), _ID).join(member_lists(ends), _ID, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
