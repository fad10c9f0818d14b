"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours above a node are linked to the least of its neighbourhood; small: those below it are."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        moved = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (the least node reachable), for every node that has a link. edges: a, b, both long and not null.

    Each round halves distances at least, and is written to the shared folder. Groups are aggregated to their minimum,
    never gathered. No edges, no rows.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        edges_new = materialize(_star(_star(edges, True), False), "edges")
        now = edges_new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(edges) if edges.inputFiles() else None
        edges = edges_new
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
