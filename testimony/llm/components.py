"""Connected components over an edge table, by rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import cut


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Alternates two steps until nothing changes: every node hooks its larger neighbours to the smallest node of its
    neighbourhood, then its smaller ones. Both keep the components and turn each one into a star within a number
    of rounds that grows with the logarithm of its size. A hub's neighbours are never gathered: its minimum is an
    aggregate with map-side combine, and its join back is an inner sort-merge join that AQE splits where skewed.
    Each round is written to the shared folder, so lost executors cost a re-read. Edges with a null end, loops and
    repeats count as nothing; a node with only a loop is its own component.
    """
    loops = edges.where("a is not null and b is not null")
    nodes = cut(loops.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "component-nodes")
    pairs = cut(loops.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "component-edges")
    count = None
    for _ in range(rounds):
        large = _star(pairs.select("u", "v").union(pairs.select("v", "u")), larger=True)
        pairs = cut(_star(large, larger=False), "component-edges")
        state = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == count:
            break
        count = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """(u, v) with u > v. larger: of each u, neighbours above u are tied to the least of u and its neighbours;
    else pairs have u > v, and u and its smaller neighbours are tied to the least."""
    # Written, so that both sides of the join are shuffled for it and a hub's side can be split.
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "component-least")
    joined = pairs.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    ties = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ties.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
