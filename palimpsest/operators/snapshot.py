"""Reads of an append-only fact log as of a snapshot, with retraction and retraction of retractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import folds
from palimpsest.scratch import stored

#: Kinds of facts that speak of a day.  Fixed values.
DATED = ["existence", "construction_started", "construction_completed", "demolition_started", "demolition_completed", "event"]


def facts_at(facts: DataFrame, n: int) -> DataFrame:
    """Facts below the exclusive snapshot bound; the filter reaches Parquet row groups."""
    return facts.where(F.col("fact_id") < n)


def mount(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """A frozen base log united with a newer layer of disjoint ids."""
    return base.unionByName(overlay, allowMissingColumns=True)


def next_fact_id(facts: DataFrame) -> DataFrame:
    return facts.agg((F.coalesce(F.max("fact_id"), F.lit(-1)) + 1).alias("next_fact_id"))


def append_ids(new: DataFrame, first: int, order: list[str]) -> DataFrame:
    """``new`` with dense fact_ids from ``first`` in the order of the columns ``order``.

    Rows are range-partitioned by the order; only one count per partition is summed over the whole table.
    """
    n = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = new.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    parts = stored(parts, "append")
    counts = parts.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return parts.join(F.broadcast(before), "_part").withColumn("fact_id", F.col("_before") + F.col("_at") + first).drop("_part", "_at", "_before")


def append_facts(new: DataFrame, first: int, order: list[str], subjects: Column, path: str) -> None:
    """Write ``new`` (kind, entity, lo, hi and more) with dense ids as three tables under ``path``.

    ``facts`` has all columns, ``fact_subjects`` each distinct (fact_id, kind, subject) once, ``witnesses`` the
    dated kinds by view.  The derived tables are made from the facts as written, so a lost task or a repeated
    write (which replaces all three) can't make them differ.
    """
    spark = new.sparkSession
    rows = append_ids(new, first, order)
    rows.write.mode("overwrite").parquet(f"{path}/facts")
    facts = spark.read.schema(rows.schema).parquet(f"{path}/facts")
    folds.mentions(facts, subjects).write.mode("overwrite").parquet(f"{path}/fact_subjects")
    dated = facts.where(F.col("kind").isin(DATED) & (F.col("lo").isNotNull() | F.col("hi").isNotNull()))
    folds.witness_views(dated).write.mode("overwrite").partitionBy("view").parquet(f"{path}/witnesses")


def retraction_edges(facts: DataFrame) -> DataFrame:
    """retractor, target: direct retractions, and one edge per fact of a retracted commit."""
    single = facts.where("retracts_fact_id is not null").select(F.col("fact_id").alias("retractor"), F.col("retracts_fact_id").alias("target"))
    whole = facts.where("retracts_commit_seq is not null").select(F.col("fact_id").alias("retractor"), F.col("retracts_commit_seq").alias("commit_seq"))
    return single.unionByName(whole.join(facts.select("commit_seq", F.col("fact_id").alias("target")), "commit_seq").select("retractor", "target"))


def _dead_retractors(edges: DataFrame) -> DataFrame:
    """node: the retractors among (retractor, target) edges that are themselves retracted in effect.

    An edge (r, x, when_live) makes x dead when r is live (or, the flag being false, when r is dead).  Each
    round settles what follows from settled nodes, drops it, and contracts the rest: an edge from a node with
    one edge of its own is drawn to that edge's begin.  Chains so halve in each round, whatever their length.
    """
    inner = edges.join(edges.select(F.col("retractor").alias("target")).distinct(), "target", "left_semi")
    open_ = stored(inner.select(F.col("retractor").alias("r"), F.col("target").alias("x"), F.lit(True).alias("when_live")), "chains")
    # Retractors that nothing retracts are live.
    settled = open_.select("r").distinct().join(open_.select(F.col("x").alias("r")).distinct(), "r", "left_anti").withColumn("live", F.lit(True))
    dead = edges.select(F.col("retractor").alias("node")).limit(0)
    while not open_.isEmpty():
        known = open_.join(settled, "r", "left")
        hit = F.coalesce(F.bool_or(F.col("live") == F.col("when_live")), F.lit(False))
        fate = stored(known.groupBy("x").agg(hit.alias("dead"), F.count_if(F.col("live").isNull()).alias("n")).where("dead or n = 0").select("x", "dead"), "fates")
        dead = dead.unionByName(fate.where("dead").select(F.col("x").alias("node")))
        rest = known.where("live is null").join(fate, "x", "left_anti").select("r", "x", "when_live")
        one = rest.groupBy("x").agg(F.count("*").alias("n"), F.first("r").alias("_q"), F.first("when_live").alias("_w")).where("n = 1").select(F.col("x").alias("r"), "_q", "_w")
        drawn = rest.join(one, "r", "left").select(F.coalesce("_q", "r").alias("r"), "x", F.when(F.col("_q").isNull(), F.col("when_live")).otherwise(F.col("when_live") != F.col("_w")).alias("when_live"))
        open_ = stored(drawn.distinct(), "chains")
        settled = fate.select(F.col("x").alias("r"), (~F.col("dead")).alias("live"))
    return dead


def effective_retractors(edges: DataFrame) -> DataFrame:
    """target, retractor: the lowest retractor of each target that is itself not retracted.

    A retractor is always younger than its target; other edges retract nothing.  Facts outside the
    retraction graph take no part.
    """
    edges = stored(edges.where("retractor > target").distinct(), "retractions")
    dead = _dead_retractors(edges).withColumnRenamed("node", "retractor")
    return edges.join(dead, "retractor", "left_anti").groupBy("target").agg(F.min("retractor").alias("retractor"))


def live(facts: DataFrame, retractors: DataFrame | None = None) -> DataFrame:
    """Facts without an effective retractor."""
    by = effective_retractors(retraction_edges(facts)) if retractors is None else retractors
    return facts.join(by.select(F.col("target").alias("fact_id")), "fact_id", "left_anti")


def lookup(ids: DataFrame, facts: DataFrame, retractors: DataFrame, n: int) -> DataFrame:
    """fact_id, state, retractor for wanted ids: active, retracted, future (at or past the bound) or unknown."""
    known = facts.select("fact_id", F.lit(True).alias("_known"))
    by = retractors.select(F.col("target").alias("fact_id"), "retractor")
    state = F.when(F.col("_known").isNull(), "unknown").when(F.col("fact_id") >= n, "future").when(F.col("retractor").isNotNull(), "retracted").otherwise("active")
    return ids.join(known, "fact_id", "left").join(by, "fact_id", "left").select("fact_id", state.alias("state"), F.when(state == "retracted", F.col("retractor")).alias("retractor"))


def touched_targets(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """fact_id: all facts that retractions starting from ``seeds`` reach, downward over retraction edges.

    Each round writes only what it newly found; earlier rounds' tables are read, never written again.
    """
    found = frontier = stored(seeds.select("fact_id").distinct(), "touched")
    edges = stored(edges.distinct(), "retractions")
    while True:
        below = edges.join(frontier.withColumnRenamed("fact_id", "retractor"), "retractor").select(F.col("target").alias("fact_id")).distinct()
        frontier = stored(below.join(found, "fact_id", "left_anti"), "touched")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
