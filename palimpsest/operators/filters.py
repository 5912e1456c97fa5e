"""Filters of facts by what they cite: references in other systems, and source URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text


def by_reference(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Facts (with system, key) that cite a wanted reference (system, key); each fact once, however often it is wanted."""
    return facts.join(wanted.select("system", "key").distinct(), ["system", "key"], "left_semi")


def by_source_url(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Facts (with source_url) of a wanted source_url, both compared and given in normal form; what is no URL matches nothing."""
    normal = lambda x: x.withColumn("source_url", text.normalize_url(F.col("source_url"))).where(F.col("source_url").isNotNull())
    return normal(facts).join(normal(wanted.select("source_url")).distinct(), "source_url", "left_semi")
