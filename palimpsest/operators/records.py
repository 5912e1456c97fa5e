"""Records of events and images, depictions in pages, and brackets of dates that are unions of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.scratch import stored

#: Slots of event facts (event, slot, fact_id, value, lo, hi, lat, lon).  Fixed values.
EVENT_SETS = {"cause": "causes", "method": "methods", "usage": "usages", "designation": "designations", "description": "descriptions"}
EVENT_DATES = ["started", "completed", "occurred"]
UNDETERMINED = "undetermined"


def _claimed(slot: str) -> Column:
    """The distinct values of one slot, sorted; the vocabulary of a slot is closed, so the set is small."""
    return F.sort_array(F.collect_set(F.when(F.col("slot") == slot, F.col("value"))))


def _agreed(values: Column) -> Column:
    """The one value, ``undetermined`` where sources differ, null where none speaks."""
    return F.when(F.size(values) == 1, values[0]).when(F.size(values) > 1, UNDETERMINED)


def _bracket(slot: str) -> list[Column]:
    """Consensus and conflict of a slot's single intervals; open ends never bind."""
    lo, hi = F.max(F.when(F.col("slot") == slot, F.col("lo"))), F.min(F.when(F.col("slot") == slot, F.col("hi")))
    return [lo.alias(f"{slot}_lo"), hi.alias(f"{slot}_hi"), F.coalesce(lo > hi, F.lit(False)).alias(f"{slot}_conflict")]


def event_records(facts: DataFrame, owners: DataFrame, reps: DataFrame) -> DataFrame:
    """One record per owned event: rep, event, kind, dates by role, destination, sets of claims, support.

    ``facts`` has event, slot, fact_id, value, lo, hi, lat, lon; ``owners`` event, owner; ``reps`` member, rep.
    The destination is that of the least fact, with the number of different ones.  An event without an owner
    gives no record.  All slots fold in one aggregation, over rows that are dealt by event once: the distinct counts
    then need no shuffle of rows expanded for each of them.
    """
    place = F.when(F.col("slot") == "destination", F.struct("lat", "lon"))
    folded = facts.select("event", "slot", "fact_id", "value", "lo", "hi", "lat", "lon").repartition("event").groupBy("event").agg(
        _claimed("kind").alias("_kinds"), *[c for slot in EVENT_DATES for c in _bracket(slot)],
        F.min_by(place, F.when(F.col("slot") == "destination", F.col("fact_id"))).alias("_place"), F.count_distinct(place).alias("n_places"),
        *[_claimed(slot).alias(name) for slot, name in EVENT_SETS.items()], F.count_distinct("fact_id").alias("support"),
    )
    owned = folded.join(owners.select("event", "owner"), "event").join(reps.withColumnRenamed("member", "owner"), "owner", "left")
    dates = [f"{slot}_{end}" for slot in EVENT_DATES for end in ("lo", "hi", "conflict")]
    return owned.select(F.coalesce("rep", "owner").alias("rep"), "event", _agreed(F.col("_kinds")).alias("kind"), *dates, "_place.lat", "_place.lon", "n_places", *EVENT_SETS.values(), "support")


def image_records(facts: DataFrame, composites: DataFrame, reps: DataFrame) -> DataFrame:
    """One record per image class: rep, medium, subject dates, urls, depicted entities, parents, sub-images, support.

    ``facts`` has image, slot (medium, subject_date, url, depicts), fact_id, value, lo, hi; ``composites``
    subimage, parent, fact_id; ``reps`` member, rep.  An edge inside one class is none.  Rows are dealt by class once, as
    in ``event_records``.
    """
    to = lambda rows, key: rows.join(reps.select(F.col("member").alias(key), F.col("rep").alias(f"_{key}")), key, "left").withColumn(f"_{key}", F.coalesce(f"_{key}", key))
    edges = to(to(composites, "subimage"), "parent").where("_subimage <> _parent")
    none = [F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi")]
    up = edges.select(F.col("_subimage").alias("rep"), F.lit("parent").alias("slot"), "fact_id", F.col("_parent").alias("far"), *none)
    down = edges.select(F.col("_parent").alias("rep"), F.lit("subimage").alias("slot"), "fact_id", F.col("_subimage").alias("far"), *none)
    own = to(facts, "image").select(F.col("_image").alias("rep"), "slot", "fact_id", F.lit(None).cast("long").alias("far"), "value", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))
    far = lambda slot: F.sort_array(F.collect_set(F.when(F.col("slot") == slot, F.col("far"))))
    rows = own.unionByName(up).unionByName(down).repartition("rep")
    folded = rows.groupBy("rep").agg(_claimed("medium").alias("_media"), *_bracket("subject_date"), _claimed("url").alias("urls"), _claimed("depicts").alias("depicts"), far("parent").alias("parents"), far("subimage").alias("subimages"), F.count_distinct("fact_id").alias("support"))
    return folded.select("rep", _agreed(F.col("_media")).alias("medium"), "subject_date_lo", "subject_date_hi", "subject_date_conflict", "urls", "depicts", "parents", "subimages", "support")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` from 0 inside each group, by ``order``; no task holds a whole group.

    Rows are range-partitioned by group and order, and numbered inside their partition; of a group that
    spans partitions only one count per partition is summed up.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(rows.repartitionByRange(n, group, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    counts = parts.groupBy(group, "_part").count()
    before = counts.select(group, "_part", (F.sum("count").over(Window.partitionBy(group).orderBy("_part")) - F.col("count")).alias("_before"))
    return parts.withColumn("_row", inside).join(before, [group, "_part"]).withColumn("place", F.col("_row") + F.col("_before") - 1).drop("_row", "_before", "_part")


def depictions(depicts: DataFrame, entity_reps: DataFrame, image_reps: DataFrame, images: int) -> DataFrame:
    """rep, image_rep, fact_id, page: depictions of an entity's class under image representatives.

    ``depicts`` has fact_id, image, entity.  A page holds all facts of ``images`` image classes, so none straddles two.
    """
    x = depicts.join(entity_reps.withColumnRenamed("member", "entity").withColumnRenamed("rep", "_rep"), "entity", "left")
    x = x.join(image_reps.select(F.col("member").alias("image"), F.col("rep").alias("_image")), "image", "left")
    x = x.select(F.coalesce("_rep", "entity").alias("rep"), F.coalesce("_image", "image").alias("image_rep"), "fact_id").distinct()
    pages = numbered(x.select("rep", "image_rep").distinct(), "rep", ["image_rep"])
    return x.join(pages, ["rep", "image_rep"]).select("rep", "image_rep", "fact_id", F.expr(f"place div {images}").alias("page"))


#: Days that stand for open ends; outside of any real day.
_FIRST, _LAST = -(1 << 40), 1 << 40


def interval_bracket(claims: DataFrame, *keys: str) -> DataFrame:
    """keys, consensus and extent (arrays of lo, hi; null is an open end), conflict and support of dates that are unions.

    ``claims`` has the keys, fact_id and date, an array of disjoint closed intervals.  The consensus is the
    days that all claims cover, the extent those that any covers.  Claims become steps of coverage that are
    summed by day before a group's days are walked, so copies of an interval cost nothing.
    """
    ends = claims.select(*keys, F.explode("date").alias("_i")).select(*keys, F.coalesce(F.col("_i.lo").cast("long"), F.lit(_FIRST)).alias("_lo"), F.coalesce(F.col("_i.hi").cast("long"), F.lit(_LAST)).alias("_hi"))
    step = F.array(F.struct(F.col("_lo").alias("day"), F.lit(1).alias("by")), F.struct((F.col("_hi") + 1).alias("day"), F.lit(-1).alias("by")))
    steps = ends.select(*keys, F.explode(step).alias("_s")).groupBy(*keys, "_s.day").agg(F.sum("_s.by").alias("_by"))
    w = Window.partitionBy(*keys).orderBy("day")
    spans = steps.select(*keys, "day", F.sum("_by").over(w).alias("_cover"), (F.lead("day").over(w) - 1).alias("_to")).where("_cover > 0 and _to is not null")
    counts = claims.groupBy(*keys).agg(F.count("*").alias("support"))
    spans = spans.join(counts, list(keys))

    def runs(rows: DataFrame, name: str) -> DataFrame:
        fresh = F.coalesce((F.col("day") > F.lag("_to").over(w) + 1).cast("int"), F.lit(0))
        grouped = rows.withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(w)).groupBy(*keys, "_g").agg(F.min("day").alias("_lo"), F.max("_to").alias("_hi"))
        span = F.struct(F.when(F.col("_lo") > _FIRST, F.col("_lo")).alias("lo"), F.when(F.col("_hi") < _LAST, F.col("_hi")).alias("hi"))
        return grouped.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_g", span.alias("s")))), lambda x: x["s"]).alias(name))

    out = counts.join(runs(spans.where("_cover = support"), "consensus"), list(keys), "left").join(runs(spans, "extent"), list(keys), "left")
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    return out.select(*keys, F.coalesce("consensus", none).alias("consensus"), F.coalesce("extent", none).alias("extent"), F.col("consensus").isNull().alias("conflict"), "support")
