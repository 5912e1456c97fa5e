"""Type closures over subclass edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.scratch import stored


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """type: the roots and everything below them over (child, parent) edges; cycles end by themselves."""
    found = frontier = stored(roots.select("type").distinct(), "types")
    while True:
        below = edges.join(frontier.withColumnRenamed("type", "parent"), "parent").select(F.col("child").alias("type")).distinct()
        frontier = stored(below.join(found, "type", "left_anti"), "types")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def type_closure(edges: DataFrame, roots: DataFrame, excluded: DataFrame) -> DataFrame:
    """type: the closure of ``roots`` without the whole closures of ``excluded``."""
    return descendants(edges, roots).join(descendants(edges, excluded), "type", "left_anti")


def filter_instances(items: DataFrame, types: DataFrame) -> DataFrame:
    """Items (with an array column ``types``) any of whose types is in the closure; each item at most once."""
    hit = items.select("item", F.explode("types").alias("type")).join(types, "type", "left_semi").select("item").distinct()
    return items.join(hit, "item", "left_semi")
