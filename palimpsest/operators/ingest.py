"""From dump items to facts: names, references, lifecycle contributions and images, one bundle per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import dates, geo, text
from palimpsest.operators import listing
from palimpsest.scratch import stored

#: Significant events by item id: (ids, contribution, payload, dates taken).  Fixed values.
EVENTS = [
    (["Q385378"], "construction", None, "span"),
    (["Q27136782", "Q1068633"], "construction_started", None, "point"),
    (["Q59913255"], "construction_completed", None, "point"),
    (["Q1417098", "Q3010369", "Q15051339"], "usage_changed", None, "points"),
    (["Q125375"], "usage_changed", "religious", "points"),
    (["Q1370468", "Q2478058", "Q217102"], "repaired", None, "span"),
    (["Q2144402", "Q19841649", "Q1441983"], "modified", None, "span"),
    (["Q168983"], "damaged", "fire", "points"),
    (["Q7944"], "damaged", "earthquake", "points"),
    (["Q8068"], "damaged", "flood", "points"),
    (["Q331483", "Q17781833"], "demolition", None, "span"),
    (["Q5135520"], "usage_changed", "none", "points"),
]
#: Lifecycle properties: (property, contribution, payload).  Fixed values.
PROPERTIES = [("P571", "construction_started", None), ("P576", "demolition_completed", None), ("P1619", "usage_changed", None), ("P3999", "usage_changed", "none"), ("P729", "usage_changed", "transportation"), ("P730", "usage_changed", "none")]
#: Picture properties: (property, medium, perspective).  Fixed values.
PICTURES = [("P18", "photograph", "exterior"), ("P3451", "photograph", "exterior"), ("P5775", "photograph", "interior"), ("P3311", "plan", None)]
#: Link properties that give references: (property, system).  Fixed values.
LINKS = [("P856", "url"), ("P973", "url"), ("P402", "osm"), ("P1584", "pleiades")]

#: Records that are items, not properties or lexemes.
IS_ITEM = "id rlike '^Q[1-9][0-9]*$'"


def asserted(claims: Column) -> Column:
    """Claims that the item still asserts: deprecated ones are dropped."""
    return F.filter(claims, lambda c: ~F.coalesce(c["rank"] == "deprecated", F.lit(False)))


def claim_rows(items: DataFrame) -> DataFrame:
    """id, property, value_type, value (JSON), qualifiers: one row per asserted claim with a value."""
    rows = items.select("id", F.explode("claims").alias("property", "_claims")).select("id", "property", F.explode(asserted(F.col("_claims"))).alias("_c"))
    return rows.select("id", "property", F.col("_c.mainsnak.datavalue.type").alias("value_type"), F.col("_c.mainsnak.datavalue.value").alias("value"), F.col("_c.qualifiers").alias("qualifiers")).where("value is not null")


def _time(value: Column) -> Column:
    return dates.parse_item_time(F.get_json_object(value, "$.time"), F.get_json_object(value, "$.precision").cast("int"))


def _qualifier(prop: str) -> Column:
    return _time(F.col("qualifiers")[prop][0]["datavalue"]["value"])


def _rules(spark: SparkSession) -> DataFrame:
    rows = [(e, kind, payload, take) for ids, kind, payload, take in EVENTS for e in ids]
    return spark.createDataFrame(rows, "event_item string, kind string, payload string, take string")


def _lifecycle(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, kind, payload, started, completed, at; warnings id, property, reason) from claim rows.

    ``at`` is the earliest day of the contribution that the dates belong to: all inceptions of an item are one
    contribution, and so are all its removals.
    """
    spark = claims.sparkSession
    plain = spark.createDataFrame(PROPERTIES, "property string, kind string, payload string")
    own = claims.join(F.broadcast(plain), "property").withColumn("_t", _time(F.col("value")))
    end = F.col("kind").isin("demolition_completed", "construction_completed")
    pooled = F.when(F.col("property").isin("P571", "P576"), F.min("_t.day").over(Window.partitionBy("id", "property"))).otherwise(F.col("_t.day"))
    by_property = own.where("_t is not null").withColumn("at", pooled).select("id", "kind", "payload", F.when(~end, F.col("_t.day")).alias("started"), F.when(end, F.col("_t.day")).alias("completed"), "at")
    events = claims.where("property = 'P793'").withColumn("event_item", F.get_json_object("value", "$.id")).join(F.broadcast(_rules(spark)), "event_item", "left")
    points = F.array_distinct(F.filter(F.transform(F.coalesce(F.col("qualifiers")["P585"], F.array()), lambda q: _time(q["datavalue"]["value"])["day"]), lambda d: d.isNotNull()))
    events = events.withColumn("_start", _qualifier("P580")["day"]).withColumn("_end", _qualifier("P582")["day"]).withColumn("_points", points)
    span = events.where("take = 'span'").select("id", "kind", "payload", F.col("_start").alias("started"), F.coalesce("_end", F.get("_points", F.lit(0))).alias("completed"))
    point = events.where("take = 'point'").withColumn("_d", F.get("_points", F.lit(0))).select("id", "kind", "payload", F.when(~end, F.col("_d")).alias("started"), F.when(end, F.col("_d")).alias("completed"))
    many = events.where("take = 'points'").select("id", "kind", "payload", F.explode("_points").alias("started")).withColumn("completed", F.lit(None).cast("long"))
    dated = span.unionByName(point).unionByName(many).where("started is not null or completed is not null").withColumn("at", F.least("started", "completed"))
    unread = own.where("_t is null").select("id", "property", F.lit("unreadable date").alias("reason"))
    unknown = events.where("kind is null").select("id", "property", F.concat(F.lit("unknown event "), F.coalesce("event_item", F.lit("?"))).alias("reason"))
    return by_property.unionByName(dated), unread.unionByName(unknown)


def contributions(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, kind, payload, started, completed as days; warnings id, property, reason) from claim rows.

    Properties give one date each; significant events give start and end, a point, or one contribution per
    distinct point, by the rule table.  Events that the table lacks and unreadable dates are warnings.  Claims of
    lifecycle properties are written once, since each rule reads them.
    """
    claims = stored(claims.where(F.col("property").isin("P793", *(p for p, _, _ in PROPERTIES))), "claims")
    found, warnings = _lifecycle(claims)
    return found.drop("at").distinct(), warnings


def split_contributions(found: DataFrame) -> DataFrame:
    """``found`` (a lifecycle with ``at``) with ``part``: what is built after a demolition is a new building at the same item.

    Construction kinds count as constructions, demolition kinds as demolitions; on one day constructions lead.
    """
    phase = F.when(F.col("kind").startswith("construction"), "construction").when(F.col("kind").startswith("demolition"), "demolition").otherwise("other")
    keyed = found.select(F.col("id").alias("entity"), "at", phase.alias("kind"), F.struct("kind", "payload", "started", "completed").alias("_x"))
    return listing.split_on_rebuild(keyed).select(F.col("entity").alias("id"), F.col("part").cast("int").alias("part"), "_x.kind", "_x.payload", "_x.started", "_x.completed").distinct()


def sites(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, lat, lon, radius_m; warnings id, property, reason) from the coordinates of an item.

    The precision is an angle; the radius is its length along the meridian, toward the equator near a pole, and null without one.
    """
    rows = claims.where("property = 'P625'")
    number = lambda k: F.get_json_object("value", f"$.{k}").cast("double")
    lat, lon, angle = number("latitude"), number("longitude"), F.abs(number("precision"))
    good = (F.col("value_type") == "globecoordinate") & lat.between(-90, 90) & lon.between(-180, 180)
    radius = F.abs(geo.meridian_m(lat) - geo.meridian_m(F.when(lat + angle <= 90, lat + angle).otherwise(lat - angle)))
    found = rows.where(good).select("id", lat.alias("lat"), lon.alias("lon"), radius.alias("radius_m")).distinct()
    return found, rows.where(~F.coalesce(good, F.lit(False))).select("id", "property", F.lit("unreadable coordinate").alias("reason"))


def names(items: DataFrame, claims: DataFrame) -> DataFrame:
    """id, name, lang, name_type: labels are common names, P1448 gives official ones."""
    labels = items.select("id", F.explode("labels").alias("_k", "_v")).select("id", F.col("_v.value").alias("name"), text.language_subtag(F.coalesce("_v.language", "_k")).alias("lang"), F.lit("common").alias("name_type"))
    official = claims.where("property = 'P1448'").select("id", F.get_json_object("value", "$.text").alias("name"), text.language_subtag(F.get_json_object("value", "$.language")).alias("lang"), F.lit("official").alias("name_type"))
    return labels.unionByName(official).where("name is not null and name <> '' and lang is not null")


def references(items: DataFrame, claims: DataFrame) -> DataFrame:
    """id, system, key: the item itself, its site links and its link properties."""
    own = items.select("id", F.lit("wikidata").alias("system"), F.col("id").alias("key"))
    sites = items.select("id", F.explode("sitelinks").alias("_s", "_v")).select("id", text.reference_from_sitelink(F.col("_s"), F.col("_v.title")).alias("_r")).where("_r is not null").select("id", "_r.system", "_r.key")
    rules = claims.sparkSession.createDataFrame(LINKS, "property string, system string")
    raw = F.regexp_replace("value", '^"|"$', "")
    linked = claims.join(F.broadcast(rules), "property").select("id", F.when(F.col("system") == "url", text.reference_from_url(raw)["system"]).otherwise(F.col("system")).alias("system"), F.when(F.col("system") == "url", text.reference_from_url(raw)["key"]).when(F.col("system") == "osm", F.concat(F.lit("relation/"), raw)).otherwise(raw).alias("key"))
    return own.unionByName(sites).unionByName(linked.where("key is not null")).distinct()


def image_facts(claims: DataFrame) -> DataFrame:
    """id, file, medium, perspective from the picture properties."""
    rules = claims.sparkSession.createDataFrame(PICTURES, "property string, medium string, perspective string")
    return claims.join(F.broadcast(rules), "property").select("id", F.regexp_replace("value", '^"|"$', "").alias("file"), "medium", "perspective").distinct()


#: Columns of a bundle's facts.
FACTS = "id string, part int, kind string, key string, value string, lang string, day long, lat double, lon double, radius_m double"


def build_bundles(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts as ``FACTS``; warnings): all facts of every item, one bundle per item.

    An item that was torn down and built again is several entities, ``part`` 0, 1 and on.  Names and references are said
    of each, pictures of the latest.  Each stands on the item's site (``construction_location``, whether or not its
    construction is dated), and each but the first ``replaces`` the one before (``value``).  Items whose id isn't that of an
    item (Q and a number) have nothing to model and give no fact.  Items, claims and parts are written once, since each kind
    of fact reads them, and parsing a dump is most of the work.
    """
    items = stored(items.where(IS_ITEM).select("id", "labels", "claims", "sitelinks"), "items")
    claims = stored(claim_rows(items), "claims")
    found, warnings = _lifecycle(claims)
    life = stored(split_contributions(found), "parts")
    place, unplaced = sites(claims)
    last = items.select("id").distinct().join(life.groupBy("id").agg(F.max("part").alias("_last")), "id", "left").select("id", F.coalesce("_last", F.lit(0)).alias("_last"))
    parts = last.select("id", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("part"))

    def fact(rows: DataFrame, kind, **columns) -> DataFrame:
        given = {"part": F.col("part"), "kind": kind, **columns}
        names_ = [c.split() for c in FACTS.split(", ")]
        return rows.select("id", *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names_[1:]])

    name = fact(names(items, claims).join(parts, "id"), F.lit("name"), key=F.col("name_type"), value=F.col("name"), lang=F.col("lang"))
    ref = fact(references(items, claims).join(parts, "id"), F.lit("reference"), key=F.col("system"), value=F.col("key"))
    both = F.when(F.col("completed").isNotNull() & F.col("started").isNotNull(), F.concat_ws("/", F.col("started").cast("string"), F.col("completed").cast("string")))
    event = fact(life, F.col("kind"), key=F.col("payload"), value=both, day=F.coalesce("started", "completed"))
    image = fact(image_facts(claims).join(last, "id"), F.lit("image"), part=F.col("_last"), key=F.col("medium"), value=F.col("file"))
    site = fact(place.join(parts, "id"), F.lit("construction_location"), lat=F.col("lat"), lon=F.col("lon"), radius_m=F.col("radius_m"))
    newer = fact(parts.where("part > 0"), F.lit("replaces"), value=F.col("part") - 1)
    facts = name.unionByName(ref).unionByName(event).unionByName(image).unionByName(site).unionByName(newer)
    return facts, warnings.unionByName(unplaced)


def ingest_stats(items: DataFrame, bad: DataFrame, facts: DataFrame, warnings: DataFrame) -> DataFrame:
    """n_items, n_malformed, n_facts, n_warnings, n_commits, n_entities, n_skipped, n_failed in one row.

    Every item gives a commit, for it has a reference to itself, and one entity per part; records with another id are
    skipped.  An item that gives no fact for all that has failed.
    """
    per = facts.groupBy("id").agg(F.count("*").alias("n"), F.max("part").alias("last"))
    kept = items.where(IS_ITEM).select("id").distinct().join(per, "id", "left").agg(F.count("n").alias("n_commits"), F.coalesce(F.sum(F.col("last") + 1), F.lit(0)).alias("n_entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_facts"), F.count_if(F.col("n").isNull()).alias("n_failed"))
    seen = items.agg(F.count("*").alias("n_items"), F.count_if(~F.expr(IS_ITEM)).alias("n_skipped"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return seen.crossJoin(count(bad, "n_malformed")).crossJoin(kept).crossJoin(count(warnings, "n_warnings"))


def infer_usage(items: DataFrame, by_use: DataFrame, by_type: DataFrame) -> DataFrame:
    """item, usage of items (item, uses, types): by the first known use, else by the first known type, else unknown."""
    pick = lambda col, rules, out: items.select("item", F.posexplode(col).alias("_p", "_k")).join(rules.select(F.col("key").alias("_k"), "usage"), "_k").groupBy("item").agg(F.min_by("usage", "_p").alias(out))
    return items.select("item").join(pick("uses", by_use, "_u"), "item", "left").join(pick("types", by_type, "_t"), "item", "left").select("item", F.coalesce("_u", "_t", F.lit("unknown")).alias("usage"))
