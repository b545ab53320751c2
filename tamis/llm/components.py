"""Connected components by alternating large and small stars, over DataFrames; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, join_groups, materialise


def _near(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Each edge (a > b) as the star of a sees it, and the least neighbour m of each a with the number n of its edges."""
    near = edges.select("a", "b")
    if large:
        near = near.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return near, near.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))


def _linked(joined: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """Large: a node's larger neighbours are linked to its least one. Small: its smaller ones are."""
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def _round(edges: DataFrame, total: int, name: str) -> DataFrame:
    """A large and a small star over edges, total of them. A hub's edges stay where they are: its least neighbour is broadcast to them."""
    now, stored = edges, []
    for large in (True, False):
        near, least = _near(now, large)
        if total <= BROADCAST_ROWS:
            now = _linked(near.join(F.broadcast(least), "a"), least, large)
        else:
            least = materialise(least, f"{name}-least")
            now = materialise(_linked(join_groups(near, least, "a", "n", 2 * total), least, large), f"{name}-star")
            stored += [least, now]
    out = materialise(now, f"{name}-stars")
    discard(*stored)
    return out


def components(edges: DataFrame, name: str) -> DataFrame:
    """edges with long columns a, b, to one row (node, root) per node that has an edge to another; root is the least node.

    Self links are left out. Each round is stored in the shared folder; rounds grow with the logarithm of the longest path.
    """
    edges = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state, before = now, edges
        edges = _round(before, now[0], name)
        discard(before)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
