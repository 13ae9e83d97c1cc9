"""Connected components over an edge table, without collecting any of it.

Alternates two map-side-combinable steps (Kiveris et al., "Connected Components
in MapReduce and Beyond"): *large-star* links every larger neighbour of a node to
the node's least neighbour, *small-star* does so for the smaller ones. Both end
in stars whose centre is the least node of the component, in about log(n) rounds.
Each round's edges are written to the shared folder, so a lost executor costs a
re-read. So are the least neighbours, one row per node: the join with them then has
a plain shuffle on both sides, which lets Spark split a hub that holds a large
share of all edges, or broadcast them where their size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import drop_table, materialize, table_path


def _large_star(edges: DataFrame, path: str) -> DataFrame:
    """edges: (a, b) with a > b. Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least", path)
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, path: str) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least", path)
    moved = edges.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a > b")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component: the least node reached.

    Raises if ``max_rounds`` rounds, far beyond log(n), leave the edges unsettled.
    """
    spark = edges.sparkSession
    current = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    path = table_path(spark, "edges")
    current = materialize(current, "edges", path)
    state = None
    for _ in range(max_rounds):
        new_path, *between = (table_path(spark, tag) for tag in ("edges", "least", "half", "least"))
        half = materialize(_large_star(current, between[0]), "half", between[1])
        stars = materialize(_small_star(half, between[2]).distinct(), "edges", new_path)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for gone in (path, *between):
            drop_table(spark, gone)
        current, path = stars, new_path
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components unsettled after {max_rounds} rounds")
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
