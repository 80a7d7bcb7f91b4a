"""Sharding by a hierarchical weighted hash tree, in column expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows are numbered within so many parts of each shard; the parts' counts are all that is gathered.
SLOT_PARTS = 4096


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree.  The weight of a rack or region is the sum of what it holds."""

    region: str
    rack: str
    number: int
    weight: float = 1.0


def even_tree(shards: int) -> tuple[Shard, ...]:
    """``shards`` equal leaves, two to a rack and two racks to a region."""
    return tuple(Shard(f"r{i // 4}", f"k{i // 2 % 2}", i) for i in range(shards))


def grown(tree: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """One more shard, in a new region of its own: no weight within the old regions changes, so none of their rows
    moves between old shards."""
    number = max(s.number for s in tree) + 1
    return (*tree, Shard(f"new{number}", "k0", number, weight))


def _draw(key: Column, node: str, weight: float) -> Column:
    """The smaller, the likelier to win: an exponential draw with rate ``weight`` from 52 bits of an MD5 digest."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + node))), 1, 13), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _winner(key: Column, nodes: list[tuple[str, float, Column]]) -> Column:
    if len(nodes) == 1:
        return nodes[0][2]
    best = F.least(*(F.struct(_draw(key, name, weight).alias("d"), F.lit(i).alias("i")) for i, (name, weight, _) in enumerate(nodes)))["i"]
    out = nodes[-1][2]
    for i, (_, _, below) in reversed(list(enumerate(nodes[:-1]))):
        out = F.when(best == i, below).otherwise(out)
    return out


def shard_of(key: Column, tree: tuple[Shard, ...]) -> Column:
    """The shard that the key's draws lead to, from region to rack to leaf.

    A change of weights below one node moves keys only into or out of that node's subtree.
    """
    key = F.coalesce(key.cast("string"), F.lit("null"))

    def level(leaves: list[Shard], path: str, parts: tuple[str, ...]) -> Column:
        if not parts:
            return _winner(key, [(f"{path}/{s.number}", s.weight, F.lit(s.number)) for s in leaves])
        names = list(dict.fromkeys(getattr(s, parts[0]) for s in leaves))
        own = {n: [s for s in leaves if getattr(s, parts[0]) == n] for n in names}
        return _winner(key, [(f"{path}/{n}", sum(s.weight for s in own[n]), level(own[n], f"{path}/{n}", parts[1:])) for n in names])

    return level([s for s in tree if s.weight > 0], "", ("region", "rack")).cast("int")


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: tuple[Shard, ...] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and part for each row of ``docs``.

    The law is ``key``: only the id and the tree decide, and one more shard takes rows only into itself.  Size is the
    text's bytes plus one (null text: one, CRC of nothing).  Rows without an id share one key.  Rows of a shard are
    numbered by (part, doc_id, size, CRC) without gaps; repeated rows get slots of their own.  Extra columns are left out; an
    empty table gives no rows.  Only ids, sizes and checksums are shuffled, to 4096 parts a shard; the parts' counts, at
    most 4096 a shard whatever the input, are broadcast.
    """
    tree = tree or even_tree(8)
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), shard_of(key, tree).alias("shard"), shard_of(key, grown(tree)).alias("grown_shard"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(SLOT_PARTS)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(order).cast("long") - 1)
    return numbered.join(F.broadcast(starts), ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place")).alias("slot"), "grown_shard", "part")
