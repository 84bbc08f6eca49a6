"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list of integers.

    Returns (node, component), component being the smallest node reachable.
    Alternates big-star and small-star steps until nothing changes; each step
    is a ``min`` with map-side combining and a join, so a node with very many
    neighbours is never gathered in one task.  The edge list only ever shrinks
    to one row a node, lineage is cut by writing to the shared folder each
    round, and the driver sees counts only: no side of a join is broadcast,
    since both grow with the nodes.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        # big star: every larger neighbour of u, and u, point to u's smallest neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        big = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours, and u, point to the smallest
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small)
        sums = after.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        dropped(e)
        e = after
        if tuple(sums) == last or not sums[0]:
            break
        last = tuple(sums)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(out.select(F.col("component").alias("node"), "component")).distinct()
