"""Splits that keep related records together.

Records that share an entity are tied, and ties carry on. The classes are the
connected components, found by alternating two rewritings of the edges until
neither changes anything. *Large star*: every larger neighbour of a node is
tied to the least of the node and its neighbours. *Small star*: every smaller
neighbour is tied to the least of them. Both keep the components and shorten
the paths, so that in the end each component is one star around its least node.

The least neighbour of a node is a combinable ``min``; it joins back to the
edges, of which the hot ones (a node with a third of all) are split by adaptive
skew handling, or the minima broadcast if they prove small when they are there.
No neighbour list is ever collected. The edges of a round are written to the
shared folder, so the plan doesn't grow and a lost executor costs a reread; the
round before is removed then. It ends with the round that leaves only stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.session import cut, discard

#: Hash ranges of a split: 48 bits of the SHA-256 of a component's name.
RANGE = 2**48


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Directed edges u -> v with ``m``, the least of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least_neighbour(down)
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Does every edge lead from a node of one edge to the least node of its class? Then nothing can change any more."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is named by its least node.

    ``edges`` has ``u`` and ``v`` of one type; nulls and loops tie nothing, and
    repeated or reversed edges count once. An empty table gives an empty result.
    """
    now = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = cut(now)
    for _ in range(most_rounds):
        if _only_stars(now):
            break
        before, now = now, cut(_small_star(_large_star(now)))
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def linked_members(edges: DataFrame) -> DataFrame:
    """``(node, component, links)``: every node of an edge with its class and to how many others it is tied directly."""
    both = edges.filter("u is not null and v is not null and u <> v").select("u", "v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    links = both.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("links"))
    return connected_components(edges).join(links, "node")


def proportional_split(weights: DataFrame, parts: dict[str, float], seed: int = 42) -> DataFrame:
    """A part for each component by the hash of its name, in ranges as wide as the parts' shares.

    ``weights``: ``component`` and ``weight`` (its records), a row each. A
    component's part follows from its name alone, so others that come or go don't
    move it, and shares hold by weight as far as no component is large. One that
    holds more than half of the smallest share of all records is too large to be
    left to chance: it goes to the largest part. Null components and those
    without weight don't count.
    """
    total, largest = sum(parts.values()), max(parts, key=parts.get)
    rows = weights.select("component", "weight").filter("component is not null and weight > 0")
    whole = rows.agg(F.sum("weight").alias("whole"))
    spot = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("component")), 256), 1, 12), 16, 10).cast("bigint") / F.lit(float(RANGE))
    part, edge = None, 0.0
    for name, share in parts.items():
        edge += share / total
        part = F.when(spot < edge, name) if part is None else part.when(spot < edge, name)
    heavy = F.col("weight") > F.col("whole") * F.lit(min(parts.values()) / total / 2)
    # the other side is one row, a sum: no pairs are made
    return rows.join(F.broadcast(whole)).select("component", "weight", F.when(heavy, largest).otherwise(part.otherwise(list(parts)[-1])).alias("split"))
