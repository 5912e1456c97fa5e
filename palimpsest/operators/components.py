"""Connected components of an undirected graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.scratch import drop, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("_m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("_m")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node of its component, for every node on an edge between two nodes.

    Alternates large-star and small-star steps until nothing moves; a path of n nodes needs about log2(n) rounds.  Edges with a null end and loops are
    ignored, repeated edges count once; a node without an edge is in no row (it is its own component).
    No group of a node's edges is ever collected: minima are partly aggregated before the shuffle.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a <> b").distinct()
    now, before = stored(now, "edges"), None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before, last = seen, now
        now = stored(_small_star(_large_star(last)), "edges")
        drop(last)
