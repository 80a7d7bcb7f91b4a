"""Connected components of a link table, by joins and group-bys only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns node, component: the smallest node that each linked node reaches.

    ``links`` has columns a and b.  Alternates the large-star and small-star steps: every node's larger neighbours are
    hung on the smallest one, then the smaller ones are, until each node hangs on its component's smallest node.
    Links never reach the driver; each round is written to the checkpoint folder.  Nodes of one component may be many:
    every step is a minimum by key (summed before the shuffle) and a join that adaptive execution may split.
    Null nodes, self links and repeated links are ignored.
    """
    state = lambda table: table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = durable(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        fresh = durable(small)
        after = state(fresh)
        edges = fresh
        if before == after:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
