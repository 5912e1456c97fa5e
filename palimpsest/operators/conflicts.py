"""Temporal bounds, conflicts between witnesses and bookends, and narrowing of bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.records import interval_bracket

START, END = "construction_started", "demolition_completed"
#: Kinds that say an entity was there, and kinds whose upper end a removal bounds.  A finished construction and a begun
#: demolition are neither witnesses nor bounds.
WITNESSES, BUILDING = ("existence", "event"), ("construction_started", "construction_completed")


def lifetime_bounds(bag: DataFrame) -> DataFrame:
    """rep, floor, ceiling: the least start and the greatest completion; null when any is open on that side."""
    start, end = F.col("kind") == START, F.col("kind") == END
    return bag.groupBy("rep").agg(
        F.when(~F.coalesce(F.bool_or(start & F.col("lo").isNull()), F.lit(False)), F.min(F.when(start, F.col("lo")))).alias("floor"),
        F.when(~F.coalesce(F.bool_or(end & F.col("hi").isNull()), F.lit(False)), F.max(F.when(end, F.col("hi")))).alias("ceiling"),
    )


def witness_violations(bag: DataFrame, bounds: DataFrame) -> DataFrame:
    """rep, fact_id, kind, lo, hi, bound (floor or ceiling): witnesses wholly before the floor or after the ceiling.

    Existence and events witness; other kinds don't.  An ``event`` column is kept.
    """
    seen = bag.where(F.col("kind").isin(*WITNESSES)).join(bounds, "rep")
    below = seen.where(F.col("hi") < F.col("floor")).withColumn("bound", F.lit("floor"))
    above = seen.where(F.col("lo") > F.col("ceiling")).withColumn("bound", F.lit("ceiling"))
    return below.unionByName(above).select("rep", "fact_id", "kind", "lo", "hi", "bound", *(["event"] if "event" in bag.columns else []))


def temporal_conflicts(bag: DataFrame) -> DataFrame:
    """rep, bound, witnesses, bookends, witness: one conflict per group of witnesses and bound.

    Existence facts with the same exact dates are a group, and so are the facts of one ``event`` (each event fact by
    itself where the column is absent or null).  ``witness`` is the fact nearest the bound (smallest id on ties),
    ``bookends`` all facts that make the bound.
    """
    event = F.coalesce(F.concat(F.lit("e"), F.col("event").cast("string")), F.concat(F.lit("f"), F.col("fact_id").cast("string"))) if "event" in bag.columns else F.concat(F.lit("f"), F.col("fact_id").cast("string"))
    out = witness_violations(bag, lifetime_bounds(bag))
    group = F.when(F.col("kind") == "event", event).otherwise(F.concat_ws(",", F.lit("x"), F.coalesce(F.col("lo").cast("string"), F.lit("-")), F.coalesce(F.col("hi").cast("string"), F.lit("-"))))
    near = F.when(F.col("bound") == "floor", F.struct((-F.col("hi")).alias("d"), F.col("fact_id").alias("i"))).otherwise(F.struct(F.col("lo").alias("d"), F.col("fact_id").alias("i")))
    found = out.withColumn("_g", group).groupBy("rep", "bound", "_g").agg(F.sort_array(F.collect_set("fact_id")).alias("witnesses"), F.min_by("fact_id", near).alias("witness"))
    ends = bag.where(F.col("kind").isin(START, END)).groupBy("rep", F.when(F.col("kind") == START, "floor").otherwise("ceiling").alias("bound")).agg(F.sort_array(F.collect_set("fact_id")).alias("bookends"))
    return found.join(ends, ["rep", "bound"]).select("rep", "bound", "witnesses", "bookends", "witness")


def narrow(bag: DataFrame) -> DataFrame:
    """``bag`` with new_lo, new_hi and rules: bookends narrowed by what else is known of the entity.

    A begun or finished construction's upper end falls to the latest removal; a completed demolition's lower end rises to the
    strongest of witness reach and earliest start.  Contradictory classes and open moved ends stay as they are.
    """
    start, end = F.col("kind") == START, F.col("kind") == END
    chain = bag.groupBy("rep").agg(
        F.max(F.when(F.col("kind").isin(*WITNESSES), F.col("lo"))).alias("_w"),
        F.when(~F.coalesce(F.bool_or(end & F.col("hi").isNull()), F.lit(False)), F.max(F.when(end, F.col("hi")))).alias("_d"),
        F.when(~F.coalesce(F.bool_or(start & F.col("lo").isNull()), F.lit(False)), F.min(F.when(start, F.col("lo")))).alias("_c"),
        F.coalesce(F.max(F.when(start, F.col("lo"))) > F.min(F.when(end, F.col("hi"))), F.lit(False)).alias("_bad"),
    )
    x = bag.join(chain, "rep")
    no = F.lit(False)
    cut = F.col("kind").isin(*BUILDING) & ~F.col("_bad") & F.coalesce(F.col("hi") > F.col("_d"), no) & (F.col("lo").isNull() | F.coalesce(F.col("lo") <= F.col("_d"), no))
    fits = lambda v: end & ~F.col("_bad") & F.coalesce(F.col("lo") < v, no) & (F.col("hi").isNull() | F.coalesce(v <= F.col("hi"), no))
    best = F.greatest(F.when(fits(F.col("_w")), F.col("_w")), F.when(fits(F.col("_c")), F.col("_c")))
    rules = F.array_compact(F.array(F.when(cut, "construction_before_demolition"), F.when(fits(F.col("_w")) & (F.col("_w") == best), "witness_before_demolition"), F.when(fits(F.col("_c")) & (F.col("_c") == best), "start_before_demolition")))
    return x.withColumns({"new_lo": F.coalesce(best, F.col("lo")), "new_hi": F.when(cut, F.col("_d")).otherwise(F.col("hi")), "rules": rules}).drop("_w", "_d", "_c", "_bad")


def built_by(bag: DataFrame) -> DataFrame:
    """rep, built_by, precision, evidence: the earliest upper end of a witness, where no start is asserted.

    All ties are evidence; ``precision`` is the finest of theirs (null where the column is absent).
    """
    precision = F.max("precision") if "precision" in bag.columns else F.lit(None).cast("int")
    seen = bag.where(F.col("kind").isin(*WITNESSES) & F.col("hi").isNotNull())
    seen = seen.join(bag.where(F.col("kind") == START).select("rep").distinct(), "rep", "left_anti")
    least = seen.groupBy("rep").agg(F.min("hi").alias("built_by"))
    return seen.join(least, "rep").where("hi = built_by").groupBy("rep", "built_by").agg(precision.alias("precision"), F.sort_array(F.collect_set("fact_id")).alias("evidence"))


def fighting_pairs(bag: DataFrame, kind: str) -> DataFrame:
    """rep, a, b: disjoint pairs of claims of one kind, for single intervals.

    A pair is disjoint when one ends before the other begins, so only claims that begin after the entity's
    least end, or end before its greatest begin, can take part; the others never enter the join.
    """
    claims = bag.where(F.col("kind") == kind).select("rep", "fact_id", "lo", "hi")
    edges = claims.groupBy("rep").agg(F.min("hi").alias("_h"), F.max("lo").alias("_l")).where("_h < _l")
    late = claims.join(edges, "rep").where("lo > _h").select("rep", F.col("fact_id").alias("_x"), F.col("lo").alias("_lo"))
    early = claims.join(edges, "rep").where("hi < _l").select("rep", F.col("fact_id").alias("_y"), F.col("hi").alias("_hi"))
    return early.join(late, "rep").where("_hi < _lo").select("rep", F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def _end(side: str, pick) -> Column:
    """The least lo or greatest hi of a union of intervals (column ``date``); null where any is open."""
    ends = F.transform("date", lambda i: i[side].cast("long"))
    return F.when(~F.exists(ends, lambda v: v.isNull()), pick(ends))


def _hulls(claims: DataFrame, key: str) -> DataFrame:
    return claims.select(key, "fact_id", "date", _end("lo", F.array_min).alias("lo"), _end("hi", F.array_max).alias("hi"))


def fighting_blocks(claims: DataFrame, key: str) -> DataFrame:
    """key, day, n_before, n_after: all claims that end on a day fight all claims that begin after it.

    ``claims`` has the key, fact_id and date (array of disjoint closed intervals lo, hi; null is an open end).  Blocks have
    every pair of claims of which one is over before the other begins, each once; there is a row for each day on which one
    ends at most, whatever the number of pairs.  Claims are counted by day before a group's days are walked.
    """
    hulls = _hulls(claims, key)
    ends = hulls.where("hi is not null").select(key, F.col("hi").alias("day"), F.lit(1).alias("e"), F.lit(0).alias("s"))
    begins = hulls.where("lo is not null").select(key, F.col("lo").alias("day"), F.lit(0).alias("e"), F.lit(1).alias("s"))
    days = ends.unionByName(begins).groupBy(key, "day").agg(F.sum("e").alias("n_before"), F.sum("s").alias("_s"))
    later = Window.partitionBy(key).orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("n_after", F.coalesce(F.sum("_s").over(later), F.lit(0))).where("n_before > 0 and n_after > 0").select(key, "day", "n_before", "n_after")


def block_pairs(blocks: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """key, a, b: the pairs of facts that ``blocks`` stand for; for blocks whose pairs somebody wants to read."""
    hulls = _hulls(claims, key)
    early = blocks.select(key, "day").join(hulls.select(key, F.col("hi").alias("day"), F.col("fact_id").alias("_x")), [key, "day"])
    late = hulls.where("lo is not null").select(key, F.col("lo").alias("_lo"), F.col("fact_id").alias("_y"))
    return early.join(late, key).where("_lo > day").select(key, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def gap_pairs(claims: DataFrame, key: str) -> DataFrame:
    """key, a, b, n: dates without a common day although neither is over before the other begins: one lies in the other's gaps.

    Claims with one date are one row, known by their smallest fact; ``n`` is the number of pairs of claims.  Only dates of
    several intervals meet the others of their key.
    """
    dates = _hulls(claims, key).groupBy(key, "date", "lo", "hi").agg(F.min("fact_id").alias("fact"), F.count(F.lit(1)).alias("n"))
    x = dates.where(F.size("date") > 1).select(key, *(F.col(c).alias(f"_{c}") for c in ("date", "lo", "hi", "fact", "n")))
    within = (F.col("lo").isNull() | F.col("_hi").isNull() | (F.col("lo") <= F.col("_hi"))) & (F.col("_lo").isNull() | F.col("hi").isNull() | (F.col("_lo") <= F.col("hi")))
    no_later = lambda a, b: F.coalesce(a <= b, F.lit(True))
    common = F.exists("date", lambda i: F.exists("_date", lambda j: no_later(i["lo"], j["hi"]) & no_later(j["lo"], i["hi"])))
    once = (F.size("date") == 1) | (F.col("_fact") < F.col("fact"))
    return dates.join(x, key).where(once & within & ~common).select(key, F.least("fact", "_fact").alias("a"), F.greatest("fact", "_fact").alias("b"), (F.col("n") * F.col("_n")).alias("n"))


def deletion_minimal(dates: list[list[tuple]]) -> list[int]:
    """Which of some unions of intervals are left when each, in order, is dropped if the rest still has no common day."""
    edges = sorted({d for date in dates for lo, hi in date for d in (lo, hi + 1)})
    place = {d: k for k, d in enumerate(edges)}
    cover = np.zeros((len(dates), len(edges)), np.int32)
    for k, date in enumerate(dates):
        for lo, hi in date:
            cover[k, place[lo] : place[hi + 1]] = 1
    total, left, keep = cover.sum(axis=0), len(dates), []
    for k in range(len(dates)):
        # Without k the rest has a common day where all the others cover one.
        if left > 1 and (total - cover[k]).max(initial=0) < left - 1:
            total, left = total - cover[k], left - 1
        else:
            keep.append(k)
    return keep


def minimal_fighting_set(claims: DataFrame, key: str) -> DataFrame:
    """key, facts: one irreducible set of claims without a common day, for each group that has none but no disjoint pair.

    ``claims`` is as in ``fighting_blocks``.  Where a pair is disjoint, the pairs tell all (``fighting_blocks`` and
    ``gap_pairs``), and there is no set; so every set has three claims or more, and only unions can make one.  Claims are
    dropped in the order of their ids as long as the rest still has no common day.  Of claims with one date the dropping
    leaves the last alone, so only that one of each date is gathered.
    """
    pairs = fighting_blocks(claims, key).select(key).unionByName(gap_pairs(claims, key).select(key)).distinct()
    torn = interval_bracket(claims, key).where("conflict").select(key).join(pairs, key, "left_anti")
    rows = claims.join(torn, key).groupBy(key, "date").agg(F.max("fact_id").alias("fact_id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fact_id")
        end = lambda v, open_: open_ if pd.isna(v) else int(v)
        keep = deletion_minimal([[(end(i["lo"], -(1 << 40)), end(i["hi"], 1 << 40)) for i in date] for date in pdf["date"]])
        return pd.DataFrame({key: pdf[key].iloc[:1], "facts": [[int(pdf["fact_id"].iloc[k]) for k in keep]]})

    return rows.groupBy(key).applyInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, facts array<bigint>")
