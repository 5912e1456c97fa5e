"""Map reads: tiles, viewports and cluster cells over Morton keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import geo

#: Facts of a tile that clustering looks at, lowest (quadkey, fact_id) first.
TILE_TOP = 32


def tile_top_n(located: DataFrame, level: int, n: int = TILE_TOP) -> DataFrame:
    """The first n facts of each tile by (quadkey, fact_id), with the column ``tile``."""
    w = Window.partitionBy("tile").orderBy("quadkey", "fact_id")
    return located.withColumn("tile", geo.tile_prefix(F.col("quadkey"), level)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def cluster_cells(top: DataFrame) -> DataFrame:
    """tile, rep, kind, members, split_level of live, attributed facts (tile, fact_id, rep, quadkey).

    The representative is that of the lowest (quadkey, fact_id).  One entity is a singleton; several at one
    key are co-located, with all of them as members; else the cell splits at ``split_level``.
    """
    cells = top.groupBy("tile").agg(F.min_by("rep", F.struct("quadkey", "fact_id")).alias("rep"), F.sort_array(F.collect_set("rep")).alias("_all"), F.min("quadkey").alias("_lo"), F.max("quadkey").alias("_hi"))
    kind = F.when(F.size("_all") == 1, "singleton").when(F.col("_lo") == F.col("_hi"), "co_located").otherwise("cluster")
    return cells.select("tile", "rep", kind.alias("kind"), F.when(kind == "co_located", F.col("_all")).alias("members"), F.when(kind == "cluster", geo.split_level(F.col("_lo"), F.col("_hi"))).alias("split_level"))


def viewport_join(boxes: DataFrame, located: DataFrame, level: int = 4) -> DataFrame:
    """box, fact_id: located facts (fact_id, lat, lon, quadkey) inside each box, once each.

    Boxes become tiles and meet facts by equality on the tile; the exact range test follows.
    """
    halves = geo.half_boxes(boxes)
    tiles = geo.viewport_tiles(boxes, level)
    near = located.withColumn("tile", geo.tile_prefix(F.col("quadkey"), level)).join(tiles, "tile")
    inside = near.join(halves, "box").where("lat between south and north and lon between west and east")
    return inside.select("box", "fact_id").dropDuplicates()


def circles_in_viewport(boxes: DataFrame, circles: DataFrame, level: int = 4) -> DataFrame:
    """box, fact_id: circles (fact_id, lat, lon, radius_m) that meet a box.

    Circle rectangles become tiles too; a candidate is kept when the nearest point of a half box is within
    the radius on the ellipsoid.  Beside a box that is the foot of the great circle onto its nearer meridian edge.
    """
    rects = circles.select("fact_id", F.explode(geo.bounding_rects(F.col("lat"), F.col("lon"), F.col("radius_m"))).alias("_r")).select(F.col("fact_id").alias("box"), "_r.*")
    mine = geo.viewport_tiles(rects, level).withColumnRenamed("box", "fact_id")
    pairs = mine.join(geo.viewport_tiles(boxes, level), "tile").select("box", "fact_id").distinct().join(geo.half_boxes(boxes), "box").join(circles, "fact_id")
    clamp = lambda v, a, b: F.greatest(F.col(a), F.least(F.col(b), v))
    gap = lambda edge: F.abs(F.pmod(F.col("lon") - F.col(edge) + 540.0, F.lit(360.0)) - 180.0)
    near_lon = F.when(F.col("lon").between(F.col("west"), F.col("east")), F.col("lon")).when(gap("west") <= gap("east"), F.col("west")).otherwise(F.col("east"))
    y, away = F.radians("lat"), F.radians(F.col("lon") - near_lon)
    near_lat = F.when(F.col("lon").between(F.col("west"), F.col("east")), F.col("lat")).otherwise(F.degrees(F.atan2(F.sin(y), F.cos(y) * F.cos(away))))
    pairs = pairs.withColumn("_m", geo.geodesic_m("lat", "lon", clamp(near_lat, "south", "north"), near_lon))
    return pairs.where("_m <= radius_m").select("box", "fact_id").distinct()


#: Which fact kind places which kind of subject.  Fixed values.
PLACES = [("construction_location", "entity"), ("moved_to_location", "event"), ("captured_location", "image")]


def located(facts: DataFrame) -> DataFrame:
    """fact_id, subject_kind, subject_id, lat, lon, radius_m of the facts that place a subject.

    A construction site places its entity, a move's destination its event, a capture point its image; other
    kinds, and facts without a known place, give no row.
    """
    subject = F.coalesce(*[F.when(F.col("kind") == kind, F.struct(F.lit(what).alias("kind"), F.col(what).alias("id"))) for kind, what in PLACES])
    rows = facts.where(F.col("kind").isin([k for k, _ in PLACES]) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("_s", subject)
    return rows.where("_s.id is not null").select("fact_id", F.col("_s.kind").alias("subject_kind"), F.col("_s.id").alias("subject_id"), "lat", "lon", "radius_m")


def attributed(placed: DataFrame, owners: DataFrame, reps: DataFrame) -> DataFrame:
    """fact_id, rep, lat, lon of the located subjects (see ``located``) that an entity has: its sites and its owned events' places.

    An image's capture point and an orphan event's place belong to no entity.
    """
    own = placed.where("subject_kind = 'entity'").select("fact_id", F.col("subject_id").alias("_e"), "lat", "lon")
    moved = placed.where("subject_kind = 'event'").withColumnRenamed("subject_id", "event").join(owners.select("event", F.col("owner").alias("_e")), "event").select("fact_id", "_e", "lat", "lon")
    return own.unionByName(moved).join(reps.withColumnRenamed("member", "_e"), "_e", "left").select("fact_id", F.coalesce("rep", "_e").alias("rep"), "lat", "lon")


def in_viewport_and_time(boxes: DataFrame, places: DataFrame, supported: DataFrame) -> DataFrame:
    """box, rep: classes with a place (fact_id, rep, lat, lon) in the box that are also in ``supported`` (rep).

    The two conditions meet per class, not per fact: the place and the time may come from different facts.
    """
    keyed = places.withColumn("quadkey", geo.quadkey(F.col("lat"), F.col("lon")))
    inside = viewport_join(boxes, keyed).join(places.select("fact_id", "rep"), "fact_id").select("box", "rep").distinct()
    return inside.join(supported.select("rep"), "rep", "left_semi").select("box", "rep")
