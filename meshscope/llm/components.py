"""Connected components as DataFrame rounds (large star / small star).

Every round points all neighbours of a node at the smallest of them, first for
the larger neighbours, then for the smaller ones; the edge list shrinks to one
star per component in a logarithmic number of rounds.  Node minima are written
before they are joined, so both join sides are plain scans and AQE can split a
node with very many neighbours.  No Python code runs on rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshscope.plans.iterate import Workspace


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()


def _large_star(edges: DataFrame, space: Workspace, k: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = space.materialize(
        both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("n"), F.least("u", "m").alias("m")
        ),
        f"large-{k}",
    )
    joined = both.join(least, F.col("u") == F.col("n")).filter("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, space: Workspace, k: int) -> DataFrame:
    least = space.materialize(
        edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"), f"small-{k}"
    )
    joined = edges.join(least, F.col("u") == F.col("n")).select("u", "v", "m")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))


def connected_components(pairs: DataFrame, space: Workspace) -> DataFrame:
    """(node, component) of every node of ``pairs`` (u, v); component is its smallest node.

    Loops until a round changes nothing.  Pairs of equal nodes, repeated pairs
    and either order are allowed; nodes only in such self-pairs are left out.
    """
    signature = {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v"))}
    edges, seen = space.materialize_observed(_edges(pairs), ("edges-0",), **signature)
    k = 0
    while seen["n"]:
        k += 1
        large = space.materialize(_edges(_large_star(edges, space, k)), f"stars-{k}")
        after, now = space.materialize_observed(
            _edges(_small_star(large, space, k)), (f"edges-{k}",), **signature
        )
        edges, same, seen = after, now == seen, now
        if same:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
