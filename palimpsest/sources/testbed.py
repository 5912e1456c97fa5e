"""Claim-log views over the star-schema tables, as DataFrames and as the same SQL.

Days count from 2024-01-01.  Each view exists twice: a function of (spark, sf_dir), and a common table
expression in ``VIEWS`` for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c):
    return F.datediff(F.to_date(c), F.lit(EPOCH).cast("date"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_id, commit_seq, entity, kind, lo, hi, value, retracts_fact_id, retracts_commit_seq from ``events``."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "existence").when((F.col("event_type") == "signup") & (i % 4 == 1), "construction_completed").when(F.col("event_type") == "signup", "construction_started").when((F.col("event_type") == "purchase") & (i % 12 == 0), "demolition_started").when((F.col("event_type") == "purchase") & (i % 3 == 0), "demolition_completed").when(F.col("event_type") == "purchase", "event").when(F.col("event_type") == "click", "name").otherwise("retract")
    error, whole = F.col("event_type") == "error", i % 11 == 0
    d = day("ts")
    return e.select(
        i.alias("fact_id"), F.expr("event_id div 10").alias("commit_seq"), (F.col("user_id") * 20 + i % 20).alias("entity"), kind.alias("kind"),
        F.when((i % 17 == 0) & (i % 19 != 0), None).otherwise(d).alias("lo"), F.when(i % 19 == 0, None).otherwise(d + (F.floor("value") % 30).cast("int")).alias("hi"), "value",
        F.when(error & ~whole & (i - 1 - i % 7 >= 0), i - 1 - i % 7).alias("retracts_fact_id"), F.when(error & whole & (F.expr("event_id div 10") >= 1), F.expr("event_id div 10") - 1).alias("retracts_commit_seq"),
    )


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dated kinds of ``facts``."""
    return facts(spark, sf_dir).where("kind in ('existence', 'construction_started', 'construction_completed', 'demolition_started', 'demolition_completed', 'event')")


def events_of(facts: DataFrame) -> DataFrame:
    """``facts`` with event, which several facts of kind event share, and precision (9 year, 10 month, 11 day)."""
    event = F.when(F.col("kind") == "event", F.col("entity") * 2 + F.expr("fact_id div 20 % 2"))
    return facts.withColumns({"event": event, "precision": F.col("fact_id") % 3 + 9})


def same_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: identity edges between an entity and the one before it, for entities ending in 1 or 2."""
    e = facts(spark, sf_dir).select("entity").distinct().where("entity % 10 in (1, 2)")
    return e.select(F.col("entity").alias("a"), (F.col("entity") - 1).alias("b"))


def rep_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, as_of, rep from ``orders``."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("member"), F.col("o_orderkey").alias("as_of"), F.least("o_custkey", F.col("o_orderkey") % (F.col("o_custkey") + 1)).alias("rep"))


def owned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, owner, kind, started, completed from ``orders`` and the last ``lineitem`` ship date."""
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("_last"))
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("modified", "damaged", "repaired", "moved", "usage_changed"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("owner"), kind.alias("kind"), day("o_orderdate").alias("started"), day("_last").alias("completed"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_id, lat, lon of customers."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("fact_id"), ((k * 7919) % 170000 / 1000.0 - 85).alias("lat"), ((k * 104729) % 360000 / 1000.0 - 180).alias("lon"))


def viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """box, south, north, west, east of nations: boxes of 20 degrees; west > east crosses the antimeridian."""
    k = F.col("n_nationkey").cast("long")
    lat, lon = (k * 37) % 140 - 70, (k * 83) % 360 - 180
    east = F.when(lon + 10 >= 180, lon - 350).otherwise(lon + 10)
    west = F.when(lon - 10 < -180, lon + 350).otherwise(lon - 10)
    return table(spark, sf_dir, "nation").select(k.alias("box"), (lat - 10).cast("double").alias("south"), (lat + 10).cast("double").alias("north"), west.cast("double").alias("west"), east.cast("double").alias("east"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_id, entity, name, lang from ``part``, with case and padding varied."""
    k = F.col("p_partkey")
    spelled = F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(k.alias("fact_id"), (F.expr("p_partkey div 3")).alias("entity"), spelled.alias("name"), F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (k % 4 + 1).cast("int")).alias("lang"))


def depicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_id, image, entity, exterior, subject_day from ``lineitem``."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fact_id"), F.col("l_orderkey").alias("image"), F.col("l_partkey").alias("entity"), (F.col("l_returnflag") == "R").alias("exterior"), day("l_shipdate").alias("subject_day"))


def place_of(k):
    """lat, lon that belong to a key."""
    return ((k * 7919) % 170000 / 1000.0 - 85).alias("lat"), ((k * 104729) % 360000 / 1000.0 - 180).alias("lon")


def placing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_id, kind, entity, event, image, lat, lon, radius_m: sites of customers, destinations of orders, capture points of shipments, and names."""
    none = F.lit(None).cast("long")
    radius = lambda k: (k % 50 * 1000.0).alias("radius_m")
    c, o, e = F.col("c_custkey"), F.col("o_orderkey"), F.col("event_id")
    sites = table(spark, sf_dir, "customer").select((c * 4).alias("fact_id"), F.lit("construction_location").alias("kind"), c.alias("entity"), none.alias("event"), none.alias("image"), *place_of(c), radius(c))
    moves = table(spark, sf_dir, "orders").select((o * 4 + 1).alias("fact_id"), F.lit("moved_to_location").alias("kind"), none.alias("entity"), o.alias("event"), none.alias("image"), *(F.when(o % 13 != 0, x).alias(n) for x, n in zip(place_of(o + 17), ("lat", "lon"), strict=True)), radius(o))
    shots = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i")).distinct().select((F.col("i") * 4 + 2).alias("fact_id"), F.lit("captured_location").alias("kind"), none.alias("entity"), none.alias("event"), F.col("i").alias("image"), *place_of(F.col("i") + 31), radius(F.col("i")))
    named = table(spark, sf_dir, "events").select((e * 4 + 3).alias("fact_id"), F.lit("name").alias("kind"), F.col("user_id").alias("entity"), none.alias("event"), none.alias("image"), *(F.lit(None).cast("double").alias(n) for n in ("lat", "lon", "radius_m")))
    return sites.unionByName(moves).unionByName(shots).unionByName(named)


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, slot, fact_id, value, lo, hi, lat, lon: what sources say of events, from ``orders`` and ``lineitem``.

    Every 11th event has a second source that calls it a modification.
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.element_at(F.array(*map(F.lit, ("modified", "damaged", "repaired", "moved", "usage_changed"))), F.substring("o_orderpriority", 1, 1).cast("int")).alias("kind"), day("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"))
    none, text, number = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("double")

    def rows(x, slot, at, value=text, lo=none, hi=none, lat=number, lon=number):
        return x.select("event", F.lit(slot).alias("slot"), (F.col("event") * 16 + at).alias("fact_id"), value.alias("value"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), lat.alias("lat"), lon.alias("lon"))

    lat, lon = place_of(F.col("event") + 17)
    out = rows(o, "kind", 0, F.col("kind")).unionByName(rows(o.where("event % 11 = 0"), "kind", 1, F.lit("modified"))).unionByName(rows(o, "started", 2, lo=F.col("day"), hi=F.col("day") + 10))
    out = out.unionByName(rows(o.where("kind = 'moved'"), "destination", 3, lat=lat, lon=lon)).unionByName(rows(o.where("kind = 'moved'"), "method", 4, F.col("status"))).unionByName(rows(o.where("kind = 'damaged'"), "cause", 5, F.col("status"))).unionByName(rows(o.where("kind = 'usage_changed'"), "usage", 6, F.col("status")))
    ends = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), day("l_shipdate").alias("day"), F.col("l_linenumber").alias("n"))
    return out.unionByName(rows(ends, "completed", F.col("n") + 7, lo=F.col("day"), hi=F.when(F.col("n") != 1, F.col("day") + 40))).unionByName(rows(ends.where("n = 2"), "description", 15, F.concat(F.lit("d"), (F.col("day") % 5).cast("string"))))


def image_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, slot, fact_id, value, lo, hi: medium, subject date, source url and depicted entity of images from ``lineitem``."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("f"), day("l_shipdate").alias("day"), "l_partkey", "l_linestatus", "l_linenumber")
    none = F.lit(None).cast("int")
    rows = lambda y, slot, at, value, lo=none, hi=none: y.select("image", F.lit(slot).alias("slot"), (F.col("f") * 4 + at).alias("fact_id"), value.cast("string").alias("value"), lo.alias("lo"), hi.alias("hi"))
    url = F.concat(F.lit("https://img.example.org/"), F.col("image").cast("string"), F.lit("/"), (F.col("l_linenumber") % 2).cast("string"))
    return rows(x.where("l_linenumber < 3"), "medium", 0, F.when(F.col("l_linestatus") == "O", "photograph").otherwise("painting")).unionByName(rows(x, "subject_date", 1, F.lit(None), F.col("day"), F.col("day") + 60)).unionByName(rows(x, "url", 2, url)).unionByName(rows(x, "depicts", 3, F.col("l_partkey")))


def composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subimage, parent, fact_id: every fourth image is a part of the image before it."""
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(i % 4 == 1).select(i.alias("subimage"), (i - 1).alias("parent"), (i + 10_000_000).alias("fact_id"))


def image_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member, rep: of every twenty images the first two are one artifact."""
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(i.alias("member"), F.when(i % 20 == 1, i - 1).otherwise(i).alias("rep"))


def place_trees(spark: SparkSession, sf_dir: str, radius: bool = False) -> DataFrame:
    """location, path, kind, lat, lon, radius_m: a location of every four customers, in five shapes; every third has its members at one place.

    Circles are points, or have radii of up to 600 km.
    """
    k = F.col("c_custkey")
    at, j, shape = F.expr("c_custkey div 4"), k % 4, F.expr("c_custkey div 4 % 5")
    key = F.when(at % 3 == 0, at).otherwise(k)
    lat, lon = place_of(key)
    size = F.when(F.lit(radius), k % 13 * 50_000.0).otherwise(F.lit(0.0))
    none = F.lit(None).cast("double")
    path = lambda *v: F.array(*[(F.lit(x) if isinstance(x, int) else x).cast("long") for x in v]) if v else F.array().cast("array<long>")
    base = table(spark, sf_dir, "customer").withColumns({"location": at, "_j": j, "_s": shape})
    leaf = base.where("_s in (0, 1) or (_s in (2, 3) and _j < 2) or (_s = 4 and _j < 3)")
    circles = leaf.select("location", F.when(F.col("_s").isin(2, 3), path(0, F.col("_j"))).otherwise(path(F.col("_j"))).alias("path"), F.lit("circle").alias("kind"), lat, lon, size.alias("radius_m"))
    trees = base.select("location", "_s").distinct()
    inner = lambda rows, where, kind: rows.select("location", where.alias("path"), kind.alias("kind"), none.alias("lat"), none.alias("lon"), none.alias("radius_m"))
    out = circles.unionByName(inner(trees, path(), F.when(F.col("_s").isin(0, 2), "one_of").otherwise("all_of")))
    out = out.unionByName(inner(trees.where("_s in (2, 3)"), path(0), F.when(F.col("_s") == 2, "all_of").otherwise("one_of")))
    return out.unionByName(inner(trees.where("_s in (2, 3)"), path(1), F.lit("reference"))).unionByName(inner(trees.where("_s = 4"), path(3), F.when(F.col("location") % 2 == 0, "empty").otherwise("unbounded")))


_DAY = "date_diff('day', date '2024-01-01', cast({} as date))"
VIEWS = {
    "facts": f"""facts as (select event_id as fact_id, event_id // 10 as commit_seq, user_id * 20 + event_id % 20 as entity,
 case when event_type = 'view' then 'existence' when event_type = 'signup' and event_id % 4 = 1 then 'construction_completed' when event_type = 'signup' then 'construction_started' when event_type = 'purchase' and event_id % 12 = 0 then 'demolition_started' when event_type = 'purchase' and event_id % 3 = 0 then 'demolition_completed' when event_type = 'purchase' then 'event' when event_type = 'click' then 'name' else 'retract' end as kind,
 case when event_id % 17 = 0 and event_id % 19 <> 0 then null else {_DAY.format("ts")} end as lo, case when event_id % 19 = 0 then null else {_DAY.format("ts")} + cast(floor(value) as bigint) % 30 end as hi, value,
 case when event_type = 'error' and event_id % 11 <> 0 and event_id - 1 - event_id % 7 >= 0 then event_id - 1 - event_id % 7 end as retracts_fact_id,
 case when event_type = 'error' and event_id % 11 = 0 and event_id // 10 >= 1 then event_id // 10 - 1 end as retracts_commit_seq from events)""",
    "dated": "dated as (select * from facts where kind in ('existence', 'construction_started', 'construction_completed', 'demolition_started', 'demolition_completed', 'event'))",
    "same_edges": "same_edges as (select distinct entity as a, entity - 1 as b from facts where entity % 10 in (1, 2))",
    "rep_log": "rep_log as (select o_custkey as member, o_orderkey as as_of, least(o_custkey, o_orderkey % (o_custkey + 1)) as rep from orders)",
    "owned_events": f"""owned_events as (select o_orderkey as event, o_custkey as owner, ['modified', 'damaged', 'repaired', 'moved', 'usage_changed'][cast(substr(o_orderpriority, 1, 1) as int)] as kind, {_DAY.format("o_orderdate")} as started, {_DAY.format("m")} as completed
 from orders left join (select l_orderkey, max(l_shipdate) as m from lineitem group by l_orderkey) on o_orderkey = l_orderkey)""",
    "points": "points as (select c_custkey as fact_id, (c_custkey * 7919) % 170000 / 1000.0::double - 85 as lat, (c_custkey * 104729) % 360000 / 1000.0::double - 180 as lon from customer)",
    "viewports": """viewports as (select box, cast(lat - 10 as double) as south, cast(lat + 10 as double) as north, cast(case when lon - 10 < -180 then lon + 350 else lon - 10 end as double) as west, cast(case when lon + 10 >= 180 then lon - 350 else lon + 10 end as double) as east
 from (select cast(n_nationkey as bigint) as box, (n_nationkey * 37) % 140 - 70 as lat, (n_nationkey * 83) % 360 - 180 as lon from nation))""",
    "names": "names as (select p_partkey as fact_id, p_partkey // 3 as entity, case when p_partkey % 3 = 0 then upper(p_name) when p_partkey % 3 = 1 then '  ' || p_name || ' ' else p_name end as name, ['en', 'fr', 'de', 'es'][p_partkey % 4 + 1] as lang from part)",
    "depicts": f"depicts as (select l_orderkey * 8 + l_linenumber as fact_id, l_orderkey as image, l_partkey as entity, l_returnflag = 'R' as exterior, {_DAY.format('l_shipdate')} as subject_day from lineitem)",
}


_AT = "({0} * 7919) % 170000 / 1000.0::double - 85 as lat, ({0} * 104729) % 360000 / 1000.0::double - 180 as lon"
VIEWS["placing_facts"] = f"""placing_facts as (select c_custkey * 4 as fact_id, 'construction_location' as kind, c_custkey as entity, null::bigint as event, null::bigint as image, {_AT.format("c_custkey")}, c_custkey % 50 * 1000.0::double as radius_m from customer
 union all select o_orderkey * 4 + 1, 'moved_to_location', null, o_orderkey, null, case when o_orderkey % 13 <> 0 then lat end, case when o_orderkey % 13 <> 0 then lon end, o_orderkey % 50 * 1000.0::double from (select *, {_AT.format("(o_orderkey + 17)")} from orders)
 union all select i * 4 + 2, 'captured_location', null, null, i, {_AT.format("(i + 31)")}, i % 50 * 1000.0::double from (select distinct l_orderkey as i from lineitem)
 union all select event_id * 4 + 3, 'name', user_id, null, null, null, null, null from events)"""
VIEWS["members"] = f"""members as (select c_custkey // 4 as location, c_custkey % 4 as j, c_custkey // 4 % 5 as shape, {_AT.format("(case when c_custkey // 4 % 3 = 0 then c_custkey // 4 else c_custkey end)")} from customer)"""
VIEWS["said"] = f"""o_ as (select o_orderkey as event, ['modified', 'damaged', 'repaired', 'moved', 'usage_changed'][cast(substr(o_orderpriority, 1, 1) as int)] as kind, {_DAY.format("o_orderdate")} as d, o_orderstatus as status, {_AT.format("(o_orderkey + 17)")} from orders),
l_ as (select l_orderkey as event, {_DAY.format("l_shipdate")} as d, l_linenumber as n from lineitem)"""
VIEWS["shown"] = f"""shown as (select l_orderkey as image, l_orderkey * 8 + l_linenumber as f, {_DAY.format("l_shipdate")} as d, l_partkey, l_linestatus, l_linenumber as n, case when l_orderkey % 20 = 1 then l_orderkey - 1 else l_orderkey end as rep from lineitem)"""


#: Depth to which the SQL unrolls chains of retractions.
DEPTH = 12


def _retraction_sql() -> str:
    out = ["redges as (select fact_id as r, retracts_fact_id as x from facts where retracts_fact_id is not null union select a.fact_id, b.fact_id from facts a join facts b on a.retracts_commit_seq = b.commit_seq)"]
    out.append("dead0 as (select x from redges where false)")
    out += [f"dead{k} as materialized (select distinct x from redges where r not in (select x from dead{k - 1}))" for k in range(1, DEPTH + 1)]
    out.append(f"retracted as (select x as fact_id, min(r) as retractor from redges where r not in (select x from dead{DEPTH}) group by x)")
    return ",\n".join(out)


VIEWS["retracted"] = _retraction_sql()
VIEWS["live"] = "live as (select * from facts where fact_id not in (select fact_id from retracted))"
VIEWS["reps"] = """reach(a, b) as (select a, b from same_edges union select b, a from same_edges union select reach.a, e.b from reach join (select a, b from same_edges union select b, a from same_edges) e on reach.b = e.a),
reps as (select a as member, least(a, min(b)) as rep from reach group by a)"""
VIEWS["bag"] = "bag as (select f.*, case when kind = 'event' then entity * 2 + fact_id // 20 % 2 end as event, 9 + fact_id % 3 as precision, coalesce(rep, entity) as rep from live f left join reps on entity = member where kind in ('existence', 'construction_started', 'construction_completed', 'demolition_started', 'demolition_completed', 'event'))"
_NEEDS = {"dated": ["facts"], "same_edges": ["facts"], "retracted": ["facts"], "live": ["facts", "retracted"], "reps": ["facts", "same_edges"], "bag": ["facts", "retracted", "live", "same_edges", "reps"]}


def sql(views: str, body: str) -> str:
    """``body`` after the named views and those that they need."""
    order: list[str] = []
    for v in views.split():
        for need in [*_NEEDS.get(v, []), v]:
            if need not in order:
                order.append(need)
    return "with recursive " + ",\n".join(VIEWS[v] for v in order) + "\n" + body
