"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, land


#: Shares of all edge ends that make a hub.
HUBS = 1000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every neighbour above u is tied to the least of u and its neighbours.

    A node with more than a 1/HUBS of all ends, of which there are fewer than HUBS, is joined by broadcast: the edges of
    a hub stay where they are instead of meeting in one task."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    many = F.col("n") > 2 * total / HUBS
    hubs = F.broadcast(least.filter(many).select("u", "m"))
    met = both.join(hubs, "u").unionByName(both.join(hubs.select("u"), "u", "left_anti").join(least.filter(~many).select("u", "m"), "u"))
    return met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below u, and u itself, is tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Only edges move: each round is two aggregations and two joins on the node. Each round's edges land in the shared scratch folder. Null ends and loops
    are ignored; without edges the result is empty. More than `most` rounds raise RuntimeError."""
    now = land(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
        .distinct()
    )
    seen = _state(now)
    for _ in range(most):
        if not seen[0]:
            break
        after = land(_small_star(_large_star(now, seen[0])))
        state = _state(after)
        discard(now)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
