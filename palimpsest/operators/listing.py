"""Ranking, paging and display choices over entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import geo
from palimpsest.operators import existence, maps
from palimpsest.operators.records import numbered
from palimpsest.scratch import stored


def class_walk(rows: DataFrame, after: tuple[int, int] | None, limit: int) -> DataFrame:
    """The next ``limit`` distinct (rep, fact_id) rows past a cursor, in order: a distributed top-k."""
    rows = rows.select("rep", "fact_id").distinct()
    if after is not None:
        rows = rows.where((F.col("rep") > after[0]) | ((F.col("rep") == after[0]) & (F.col("fact_id") > after[1])))
    return rows.orderBy("rep", "fact_id").limit(limit)


def keyset_page(rows: DataFrame, time: str, key: str, after: tuple | None, k: int) -> DataFrame:
    """The newest k rows strictly past a (time, key) cursor."""
    if after is not None:
        t, i = F.lit(after[0]).cast(rows.schema[time].dataType), F.lit(after[1])
        rows = rows.where((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < i)))
    return rows.orderBy(F.desc(time), F.desc(key)).limit(k)


def event_pin(edges: DataFrame) -> DataFrame:
    """event, owner, kind of the earliest ownership edge ever, retracted ones included."""
    return edges.groupBy("event").agg(F.min_by(F.struct("owner", "kind"), "fact_id").alias("_x")).select("event", "_x.owner", "_x.kind")


def split_on_rebuild(contributions: DataFrame) -> DataFrame:
    """``contributions`` (entity, at, kind) with ``part``: a construction after a demolition begins a new part.

    On one day constructions come before other kinds.
    """
    first = F.when(F.col("kind") == "construction", 0).otherwise(1)
    w = Window.partitionBy("entity").orderBy("at", first, "kind")
    torn = F.sum((F.col("kind") == "demolition").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = contributions.withColumn("_torn", torn)
    seen = F.last(F.when(F.col("kind") == "construction", F.col("_torn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_new", ((F.col("kind") == "construction") & (F.col("_torn") > F.coalesce(seen, F.lit(0)))).cast("int"))
    return x.withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_torn", "_new")


def representative_image(depictions: DataFrame) -> DataFrame:
    """entity, image: the first exterior depiction, else the first one."""
    return depictions.groupBy("entity").agg(F.min_by("image", F.struct((~F.col("exterior")).alias("x"), F.col("image").alias("y"))).alias("image"))


def negotiate_name(names: DataFrame, wanted: list[str]) -> DataFrame:
    """entity, name, lang: the first wanted language's name, else English, else the first listed."""
    order = [*wanted, *([] if "en" in wanted else ["en"])]
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("lang")), F.lit(0)), F.lit(len(order) + 1))
    best = F.min_by(F.struct("name", "lang"), F.struct(rank.alias("r"), F.col("fact_id").alias("i"))).alias("_x")
    return names.groupBy("entity").agg(best).select("entity", "_x.name", "_x.lang")


def current_location(sites: DataFrame, moves: DataFrame) -> DataFrame:
    """entity, lat, lon: the destination of the latest move (dated above undated), else the construction site.

    ``sites`` and ``moves`` have entity, fact_id, lat, lon; moves also landed (day or null).
    """
    place = F.struct("lat", "lon")
    site = sites.groupBy("entity").agg(F.min_by(place, "fact_id").alias("_s"))
    moved = moves.groupBy("entity").agg(F.max_by(place, F.struct(F.col("landed").isNotNull().alias("a"), F.col("landed").alias("b"), F.col("fact_id").alias("c"))).alias("_m"))
    return site.join(moved, "entity", "full").select("entity", F.coalesce("_m.lat", "_s.lat").alias("lat"), F.coalesce("_m.lon", "_s.lon").alias("lon"))


def picker(members: DataFrame) -> DataFrame:
    """pin, entity, place: the entities of a pin (pin, entity, earliest), oldest first, undated last, ties by entity."""
    x = members.select("pin", "entity", F.col("earliest").isNull().cast("int").alias("_undated"), "earliest")
    return numbered(x, "pin", ["_undated", "earliest", "entity"]).select("pin", "entity", "place")


def moments(events: DataFrame) -> DataFrame:
    """event, role, day: one row per dated end; an event without any is one undated start."""
    start, end = F.struct(F.lit("started").alias("role"), F.col("started").alias("day")), F.struct(F.lit("completed").alias("role"), F.col("completed").alias("day"))
    dated = F.filter(F.array(start, end), lambda m: m["day"].isNotNull())
    return events.select("event", F.explode(F.when(F.size(dated) == 0, F.array(start)).otherwise(dated)).alias("_m")).select("event", "_m.role", "_m.day")


#: Lifecycle order of kinds where dates don't decide.  Fixed order.
STAGES = ["construction", "other", "demolition"]


def timeline_order(rows: DataFrame) -> DataFrame:
    """``rows`` (rep, event, role, stage, day) with ``place`` from 0: dates first, then lifecycle rules.

    Dated moments stand in the order of their days; on one day, and where dates are missing, constructions
    come before other kinds and these before demolitions, and a start before its own completion.  So an
    undated construction comes first, an undated demolition last, and another undated moment right after
    the constructions, each drawn to its own event's dated end if that lies on the wrong side.  Ties go by
    role (started first) and event.  Every moment has one sort key, so no task holds a whole entity.
    """
    rank = F.coalesce(F.create_map(*[F.lit(x) for k, s in enumerate(STAGES) for x in (s, k)])[F.col("stage")], F.lit(1))
    x = rows.select("rep", "event", "role", "stage", F.col("day").cast("double").alias("day")).withColumn("_s", rank).withColumn("_r", (F.col("role") != "started").cast("int"))
    built = x.where("_s = 0").groupBy("rep").agg(F.max("day").alias("_built"))
    own = x.groupBy("rep", "event").agg(F.max(F.when(F.col("_r") == 0, F.col("day"))).alias("_begun"), F.min(F.when(F.col("_r") == 1, F.col("day"))).alias("_done"))
    low, high, start = F.lit(float("-inf")), F.lit(float("inf")), F.col("_r") == 0
    usual = F.when(F.col("_s") == 0, low).when(F.col("_s") == 1, F.coalesce("_built", low)).otherwise(high)
    at = F.coalesce("day", F.when(start, F.least(usual, "_done")).otherwise(F.greatest(usual, "_begun")))
    keyed = x.join(built, "rep", "left").join(own, ["rep", "event"], "left").withColumn("_at", at).withColumn("_undated", F.col("day").isNull().cast("int"))
    placed = numbered(keyed.select("rep", "event", "role", "stage", "day", "_at", "_s", "_r", "_undated"), "rep", ["_at", "_s", "_r", "_undated", "event"])
    return placed.select("rep", "event", "role", "stage", "day", F.col("place").cast("int").alias("place"))


def list_entities(box: DataFrame, sites: DataFrame, moves: DataFrame, spans: DataFrame, witnesses: DataFrame, names: DataFrame, depicts: DataFrame, day: int, k: int) -> DataFrame:
    """The first ``k`` entities whose current place is in the box: entity, lat, lon, verdict, earliest, latest, names, thumbnail.

    ``sites`` and ``moves`` as in ``current_location``; ``spans`` has entity and the columns of a lifespan,
    ``witnesses`` entity, lo, hi, ``names`` entity, name, ``depicts`` entity, image, exterior.  Any place that an
    entity ever had in the box makes it a candidate; one that has since moved out is dropped before the
    limit, so it takes no slot.  The rest is joined to the ``k`` kept entities only.
    """
    keyed = lambda x: x.withColumn("quadkey", geo.quadkey(F.col("lat"), F.col("lon")))
    ever = sites.select("entity", "lat", "lon").unionByName(moves.select("entity", "lat", "lon")).withColumnRenamed("entity", "fact_id")
    may = maps.viewport_join(box, keyed(ever)).select(F.col("fact_id").alias("entity")).distinct()
    now = current_location(sites.join(may, "entity", "left_semi"), moves.join(may, "entity", "left_semi"))
    inside = maps.viewport_join(box, keyed(now.withColumnRenamed("entity", "fact_id"))).select(F.col("fact_id").alias("entity"))
    page = stored(inside.distinct().orderBy("entity").limit(k).join(now, "entity"), "page")
    own = lambda x: x.join(F.broadcast(page.select("entity")), "entity", "left_semi")
    verdicts = own(spans).select("entity", existence.verdict(day).alias("verdict"))
    span = own(witnesses).groupBy("entity").agg(F.min("lo").alias("earliest"), F.max("hi").alias("latest"))
    called = own(names).groupBy("entity").agg(F.sort_array(F.collect_set("name")).alias("names"))
    out = page.join(verdicts, "entity", "left").join(span, "entity", "left").join(called, "entity", "left").join(representative_image(own(depicts)).withColumnRenamed("image", "thumbnail"), "entity", "left")
    return out.select("entity", "lat", "lon", F.coalesce("verdict", F.lit("unknown")).alias("verdict"), "earliest", "latest", F.coalesce("names", F.array().cast("array<string>")).alias("names"), "thumbnail")


def followed(items: DataFrame, follows: DataFrame, k: int) -> DataFrame:
    """user, item, created_at: the ``k`` newest items (item, subject, created_at) of what each user follows (user, subject).

    The rank limit reaches below the shuffle, so at most ``k`` rows of a user leave each task.
    """
    rows = items.join(follows.select("user", "subject").distinct(), "subject").select("user", "item", "created_at")
    w = Window.partitionBy("user").orderBy(F.desc("created_at"), F.desc("item"))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
