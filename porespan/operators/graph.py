"""Connected components of one large graph, by alternating large-star and small-star rounds.

Every round is a grouped minimum (combined before its shuffle) and a join; labels never reach the
driver, and each round's edges are written to the shared folder, so that lineage stays short and a
lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespan.session import discard, materialize


def _oriented(pairs: DataFrame) -> DataFrame:
    """Distinct (u, v) with u > v."""
    return (
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge table; component is its least node.

    Edges with a null end and self-loops are ignored; a node that only such edges name is not returned.
    Raises if ``max_rounds`` don't suffice (they halve path lengths, so 60 cover any real graph).
    """
    now = materialize(_oriented(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "cc")
    mark = None
    for _ in range(max_rounds):
        before, now = now, materialize(_oriented(_small_star(_oriented(_large_star(now)))), "cc")
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
