"""Connected components by repeated contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(id, root): every node of an edge with the least id of its component.

    Alternates large-star and small-star: each step links a node's larger (then smaller) neighbours
    to its least neighbour, which halves path lengths, so few rounds suffice. Stars are minima per
    node, combined before the shuffle; every round is written, so lineage stays short. Self links
    are kept as nodes of their own; null ends are dropped; ids compare in their own order.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = e.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    e = materialize(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node's smaller neighbours, and itself, to its least one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        nxt = materialize(small.filter("u <> v").distinct(), "edges")
        same = nxt.join(e, ["u", "v"], "left_anti").isEmpty() and e.join(nxt, ["u", "v"], "left_anti").isEmpty()
        e = nxt
        if same:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return nodes.join(e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
