"""Connected components of an edge table: alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def _step(ws: Workspace, pairs: DataFrame, table: str, large: bool) -> DataFrame:
    """``pairs`` (u, v): the neighbours v of u. Links them to the least of u and its neighbours: in a large step those above u, in a
    small step all (there are only smaller ones). The minima are written first, so that the join is between two plain exchanges
    and a node with very many neighbours can be split."""
    least = ws.save(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{table}-least")
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return ws.save(out.where("a <> b").distinct(), table)


def connected_components(spark: SparkSession, edges: DataFrame, ws: Workspace, name: str = "components") -> DataFrame:
    """(node, component) for every node that has an edge; the component is its least node.

    ``edges``: columns a, b (long), any direction, repeats and loops allowed; an edge with a null end is no edge. Keeps no group
    in one task: minima are taken with partial sums, and joins are between written tables. The number of rounds grows with the
    logarithm of the longest path.
    """
    now = ws.save(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state, k = _state(now), 0
    while state[0]:
        k += 1
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        stars = _step(ws, both, f"{name}-{k}-large", True)
        after = _step(ws, stars.select(F.col("a").alias("u"), F.col("b").alias("v")), f"{name}-{k}", False)
        before, state = state, _state(after)
        for old in (f"{name}-{k - 1}", f"{name}-{k}-large-least", f"{name}-{k}-large", f"{name}-{k}-least"):
            ws.remove(old)
        now = after
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
