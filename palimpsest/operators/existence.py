"""Lifespans, support windows and the five-state existence verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts from weakest to strongest.  Fixed order.
VERDICTS = ["absent", "unknown", "presumed", "contested", "uncontested"]


def lifespan(bag: DataFrame, key: str = "rep") -> DataFrame:
    """Seven bounds per entity from dated facts (kind, lo, hi; null is an open end), by partial aggregation.

    Kinds: construction_started, demolition_started, demolition_completed; any other is a plain witness.
    """
    kind, lo, hi = F.col("kind"), F.col("lo"), F.col("hi")
    done = kind == "demolition_completed"
    return bag.groupBy(key).agg(
        F.min(F.when(hi.isNotNull() & lo.isNull(), hi).otherwise(lo)).alias("earliest"),
        F.max(F.when(lo.isNotNull() & hi.isNull(), lo).otherwise(hi)).alias("affirmed"),
        F.max(F.when(~done, lo)).alias("reached"),
        F.max(F.when(kind == "construction_started", lo)).alias("floor"),
        F.min(F.when(done, hi)).alias("denies_after"),
        F.max(F.when(done, hi)).alias("claimed_through"),
        F.coalesce(F.bool_or((kind == "demolition_started") | (done & hi.isNull())), F.lit(False)).alias("unbounded"),
        F.coalesce(F.bool_or(kind.isin("demolition_started", "demolition_completed")), F.lit(False)).alias("claimed"),
    )


def presumes() -> Column:
    """Whether an entity is taken to go on past its last affirmed day."""
    return ~F.col("claimed") | (~F.col("unbounded") & F.coalesce(F.col("reached") > F.col("claimed_through"), F.lit(False)))


def support_window(spans: DataFrame) -> DataFrame:
    """``spans`` with support_from, support_through (null: without end) and supported (false: no day at all)."""
    earliest, affirmed = F.col("earliest"), F.col("affirmed")
    closed = affirmed.isNotNull() & earliest.isNotNull() & (earliest <= affirmed)
    late = affirmed.isNotNull() & ~F.coalesce(closed, F.lit(False)) & presumes()
    start = F.when(closed, earliest).when(late, affirmed + 1)
    return spans.withColumns({"support_from": start, "support_through": F.when(closed & ~presumes(), affirmed), "supported": start.isNotNull()})


def in_time_range(spans: DataFrame, lo: Column | int, hi: Column | int) -> DataFrame:
    """Entities whose support window meets the days lo to hi."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return support_window(spans).where(F.col("supported") & (F.col("support_from") <= hi) & (F.col("support_through").isNull() | (F.col("support_through") >= lo)))


def verdict(day: Column | int) -> Column:
    """The existence verdict at a day, from the columns of ``lifespan``."""
    t = day if isinstance(day, Column) else F.lit(day)
    no = F.lit(False)
    denied = F.coalesce(t < F.col("floor"), no) | F.coalesce(t > F.col("denies_after"), no)
    affirms = F.coalesce((F.col("earliest") <= t) & (t <= F.col("affirmed")), no)
    supported = affirms | (presumes() & F.coalesce(t > F.col("affirmed"), no))
    return F.when(denied & supported, "contested").when(denied, "absent").when(~supported, "unknown").when(affirms, "uncontested").otherwise("presumed")


def strongest(verdicts: Column) -> Column:
    """The strongest verdict of a group."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), verdicts)
    return F.element_at(F.array(*map(F.lit, VERDICTS)), F.max(rank).cast("int"))


def sightings(depictions: DataFrame, image_facts: DataFrame) -> DataFrame:
    """Witness rows (entity, kind, lo, hi) of depicted entities: an image's subject dates, once per image and date."""
    dates = image_facts.select("image", "lo", "hi").distinct()
    return depictions.select("image", "entity").distinct().join(dates, "image").select("entity", F.lit("existence").alias("kind"), "lo", "hi")
