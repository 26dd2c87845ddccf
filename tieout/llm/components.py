"""Connected components by alternating large-star and small-star steps (O(log n) rounds of joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm import runtime


SALTS = 16


def _salted(edges: DataFrame, by: str) -> DataFrame:
    return edges.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _least(edges: DataFrame) -> DataFrame:
    """The least smaller neighbour of each node that has one, once for every salt."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step.

    Edges point from the larger to the smaller node (u > v), and both steps keep
    that and the components.  The edges of a hub are dealt by salt to many tasks.
    """
    # Large star: a node's larger neighbours move to its least neighbour (or stay, if it has no smaller one).
    least = _least(edges).select(F.col("u").alias("v"), "m", "salt")
    large = _salted(edges, "u").join(least, ["v", "salt"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
    # Small star: a node and its smaller neighbours move to the least of these.
    least = _least(large)
    moved = _salted(large, "v").join(least, ["u", "salt"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.where("salt = 0").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the least node of its component.

    Each round is checkpointed; only a count and a checksum reach the driver.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = runtime.settled(edges)
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        edges = runtime.settled(_round(edges))
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
