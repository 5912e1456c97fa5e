"""Folds of an entity's facts: brackets, envelopes, keyed support, joins from entities to facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facets(facts: DataFrame) -> DataFrame:
    """Single-valued columns read from a fact's document (``props`` with k) and its kind."""
    doc = F.from_json("props", "k bigint")
    return facts.select("fact_id", "event_type", doc["k"].alias("k"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"))


def mentions(facts: DataFrame, subjects: Column) -> DataFrame:
    """fact_id, kind, subject: each distinct subject of a fact once."""
    return facts.select("fact_id", "kind", F.explode(F.array_distinct(subjects)).alias("subject"))


def witness_views(facts: DataFrame) -> DataFrame:
    """view, fact_id, entity, date_earliest, date_latest: the dated sub-logs as one frame partitioned by view."""
    return facts.select(F.col("kind").alias("view"), "fact_id", "entity", F.col("lo").alias("date_earliest"), F.col("hi").alias("date_latest"))


def backlinks(subjects: DataFrame, facts: DataFrame, key: str = "entity") -> DataFrame:
    """Facts that mention a wanted subject; the plan broadcasts the subjects only when they are few."""
    return facts.join(subjects.select(key).distinct(), key)


def event_owners(edges: DataFrame) -> DataFrame:
    """event, owner, kind of the latest ownership edge (event, owner, kind, fact_id) of each event."""
    return edges.groupBy("event").agg(F.max_by(F.struct("owner", "kind"), "fact_id").alias("_x")).select("event", "_x.owner", "_x.kind")


def entity_fact_bag(reps: DataFrame, facts: DataFrame, owned: DataFrame, event_facts: DataFrame) -> DataFrame:
    """rep, fact_id: facts of the class's members and of the events that they own, each once.

    ``facts`` (entity, fact_id), ``owned`` (entity, event), ``event_facts`` (event, fact_id).
    """
    to = reps.withColumnRenamed("member", "entity")
    direct = facts.select("entity", "fact_id").join(to, "entity").select("rep", "fact_id")
    by_event = owned.join(event_facts, "event").join(to, "entity").select("rep", "fact_id")
    return direct.unionByName(by_event).dropDuplicates(["rep", "fact_id"])


def attribute(located: DataFrame, owners: DataFrame, reps: DataFrame) -> DataFrame:
    """fact_id, rep, quadkey: located facts placed under an entity; an event goes to its owner, an orphan to none."""
    placed = located.join(owners.select("event", "owner"), "event", "left").withColumn("_e", F.coalesce("entity", "owner")).where("_e is not null")
    return placed.join(reps.withColumnRenamed("member", "_e"), "_e", "left").select("fact_id", F.coalesce("rep", "_e").alias("rep"), "quadkey")


def date_bracket(bag: DataFrame, *keys: str) -> DataFrame:
    """Consensus (intersection) and extent (hull) of single-interval claims, with support and conflict.

    Open ends are null: they never bind the consensus and always open the extent.
    """
    lo, hi = F.max("lo"), F.min("hi")
    return bag.groupBy(*keys).agg(lo.alias("consensus_lo"), hi.alias("consensus_hi"), F.coalesce(lo > hi, F.lit(False)).alias("conflict"), *_hull("extent_lo", "extent_hi"), F.count("*").alias("support"))


def _hull(lo: str, hi: str) -> list[Column]:
    return [F.when(~F.bool_or(F.col("lo").isNull()), F.min("lo")).alias(lo), F.when(~F.bool_or(F.col("hi").isNull()), F.max("hi")).alias(hi)]


def envelope(bag: DataFrame, *keys: str) -> DataFrame:
    """lo, hi: the earliest lower and latest upper end; open if any claim is open there."""
    return bag.groupBy(*keys).agg(*_hull("lo", "hi"))


def value_bracket(claims: DataFrame, key: str, value: str) -> DataFrame:
    """key, values (sorted), agreed (the one value, else null), conflict: consensus of discrete claims."""
    values = F.sort_array(F.collect_set(value))
    return claims.groupBy(key).agg(values.alias("values")).select(key, "values", F.when(F.size("values") == 1, F.col("values")[0]).alias("agreed"), (F.size("values") > 1).alias("conflict"))


def keyed_support(claims: DataFrame, *keys: str) -> DataFrame:
    """The supporting fact ids of each key: keys unite, support adds, nothing conflicts."""
    return claims.groupBy(*keys).agg(F.sort_array(F.collect_set("fact_id")).alias("support"))


def outgoing_edges(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """fact_id, rep, far_rep: relations that leave their class; edges inside one class are dropped."""
    near = reps.select(F.col("member").alias("a"), "rep")
    far = reps.select(F.col("member").alias("b"), F.col("rep").alias("far_rep"))
    out = edges.join(near, "a", "left").join(far, "b", "left").select("fact_id", F.coalesce("rep", "a").alias("rep"), F.coalesce("far_rep", "b").alias("far_rep"))
    return out.where("rep <> far_rep")


def coalesce_intervals(spans: DataFrame, key: str) -> DataFrame:
    """key, lo, hi: closed intervals merged where they overlap or are one day apart."""
    w = Window.partitionBy(key).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.select(key, "lo", "hi").distinct().withColumn("_new", F.coalesce((F.col("lo") > reach + 1).cast("int"), F.lit(0)))
    return islands.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")
