"""Queries over located subjects, event and image records, depictions, listings and appended logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import geo, text
from palimpsest.operators import conflicts, existence, filters, folds, identity, listing, maps, records, snapshot
from palimpsest.plans.claim_queries import _LIFE, _VERDICT, _WINDOW, bag
from palimpsest.plans.map_queries import _NORM, _REF_URL, urls
from palimpsest.plans.registry import query
from palimpsest.scratch import scratch, stored
from palimpsest.sources import testbed as T
from palimpsest.sources.testbed import sql

_joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query(sql("placing_facts", """select fact_id, case kind when 'construction_location' then 'entity' when 'moved_to_location' then 'event' else 'image' end as subject_kind, coalesce(entity, event, image) as subject_id, lat, lon, radius_m from placing_facts where kind <> 'name' and lat is not null"""))
def prj4_located_subjects(spark, d):
    return maps.located(T.placing_facts(spark, d))


@query(sql("placing_facts owned_events", """select p.fact_id, e - e % 5 as rep, lat, lon from (select fact_id, lat, lon, coalesce(entity, (select owner from owned_events o where o.event = placing_facts.event and o.kind = 'moved')) as e from placing_facts where kind in ('construction_location', 'moved_to_location') and lat is not null) p where e is not null"""))
def jn7_attribute_classes(spark, d):
    """Sites and moves of classes of customers; moves whose event no move is recorded for are orphans."""
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("member"))
    reps = identity.representatives(c, c.where("member % 5 <> 0").select(F.col("member").alias("a"), (F.col("member") - 1).alias("b")))
    return maps.attributed(maps.located(T.placing_facts(spark, d)), T.owned_events(spark, d).where("kind = 'moved'"), reps)


@query(sql("points viewports bag", f""", {_LIFE},
{_WINDOW}
select distinct box, coalesce(r.rep, p.fact_id) as rep from viewports, points p left join reps r on r.member = p.fact_id where lat between south and north and ((west <= east and lon between west and east) or (west > east and (lon >= west or lon <= east)))
and coalesce(r.rep, p.fact_id) in (select rep from win where support_from <= 30 and (support_through is null or support_through >= 5))""").replace("\n, life", ",\nlife"))  # fmt: skip
def flt7_viewport_and_time(spark, d):
    p = T.points(spark, d).withColumn("member", F.col("fact_id"))
    reps = identity.representatives(p.select("member"), T.same_edges(spark, d))
    places = p.join(reps, "member").select("fact_id", "rep", "lat", "lon")
    return maps.in_viewport_and_time(T.viewports(spark, d), places, existence.in_time_range(existence.lifespan(bag(spark, d)), 5, 30))


@query(f"select event_id as fact_id, 'Q' || (event_id + 1) as key from events where event_id % 7 = 0 and event_id % 3 = 0 union all select event_id, 'way/' || event_id from events where event_id % 7 = 1 and event_id % 3 = 0")
def flt3_by_reference(spark, d):
    """Facts that cite one of a set of references in another system; the set is a third of the log's own."""
    ref = text.reference_from_url(F.expr(_REF_URL))
    cited = T.table(spark, d, "events").select(F.col("event_id").alias("fact_id"), ref.alias("r")).select("fact_id", "r.system", "r.key")
    wanted = T.table(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("i"))
    wanted = wanted.select(F.lit("wikidata").alias("system"), F.concat(F.lit("Q"), (F.col("i") + 1).cast("string")).alias("key")).unionByName(wanted.select(F.lit("osm").alias("system"), F.concat(F.lit("way/"), F.col("i").cast("string")).alias("key")))
    return filters.by_reference(cited, wanted).select("fact_id", "key")


@query(f"select page_id as image, norm as source_url from {_NORM} where norm in (select norm from {_NORM} where page_id % 3 = 1)")
def flt4_by_source_url(spark, d):
    u = urls(spark, d).select(F.col("page_id").alias("image"), F.col("u").alias("source_url"))
    return filters.by_source_url(u, u.where("image % 3 = 1").select("source_url")).select("image", "source_url")


@query(sql("depicts", """select rep, image_rep, fact_id, (dense_rank() over (partition by rep order by image_rep) - 1) // 3 as page from (select distinct entity - entity % 3 as rep, case when image % 20 = 1 then image - 1 else image end as image_rep, fact_id from depicts)"""))
def jn8_depiction_pages(spark, d):
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("member"), (F.col("p_partkey") - F.col("p_partkey") % 3).alias("rep"))
    return records.depictions(T.depicts(spark, d), p, T.image_reps(spark, d), 3)


_SET = "array_to_string(list_sort(list(distinct status)), ',')"


@query(sql("said owned_events", f"""select owner - owner % 5 as rep, o_.event, case when o_.event % 11 = 0 and o_.kind <> 'modified' then 'undetermined' else o_.kind end as kind, d as started_lo, d + 10 as started_hi, false as started_conflict,
c.lo as completed_lo, c.hi as completed_hi, coalesce(c.lo > c.hi, false) as completed_conflict, null::int as occurred_lo, null::int as occurred_hi, false as occurred_conflict,
case when o_.kind = 'moved' then lat end as lat, case when o_.kind = 'moved' then lon end as lon, (o_.kind = 'moved')::bigint as n_places,
case when o_.kind = 'damaged' then status else '' end as causes, case when o_.kind = 'moved' then status else '' end as methods, case when o_.kind = 'usage_changed' then status else '' end as usages, '' as designations, coalesce(descriptions, '') as descriptions,
2 + (o_.event % 11 = 0)::bigint + case o_.kind when 'moved' then 2 when 'damaged' then 1 when 'usage_changed' then 1 else 0 end + coalesce(c.n, 0) as support
from o_ join owned_events w on w.event = o_.event left join (select event, max(d) as lo, min(case when n <> 1 then d + 40 end) as hi, count(distinct n) + bool_or(n = 2)::bigint - bool_or(n = 8)::bigint as n, array_to_string(list_sort(list(distinct case when n = 2 then 'd' || (d % 5) end)), ',') as descriptions from l_ group by event) c on c.event = o_.event"""))  # fmt: skip
def agg21_event_folds(spark, d):
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("member"))
    reps = c.withColumn("rep", F.col("member") - F.col("member") % 5)
    r = records.event_records(T.event_facts(spark, d), T.owned_events(spark, d), reps)
    sets = list(records.EVENT_SETS.values())
    return r.select(*[_joined(x) if x in sets else x for x in r.columns])


_LIST = "array_to_string(list_sort(list(distinct {})), ',')"


@query(sql("shown", f""", edges as (select s, p, i from (select case when o_orderkey % 20 = 1 then o_orderkey - 1 else o_orderkey end as s, o_orderkey - 1 as p, o_orderkey + 10000000 as i from orders where o_orderkey % 4 = 1) where s <> p),
reps_ as (select rep from shown union select s from edges union select p from edges)
select rep, case when count(distinct l_linestatus) filter (n < 3) = 1 then min(case when l_linestatus = 'O' then 'photograph' else 'painting' end) filter (n < 3) when count(distinct l_linestatus) filter (n < 3) > 1 then 'undetermined' end as medium,
max(d) as subject_date_lo, min(d + 60) as subject_date_hi, coalesce(max(d) > min(d + 60), false) as subject_date_conflict,
coalesce({_LIST.format("'https://img.example.org/' || image || '/' || (n % 2)")}, '') as urls, coalesce({_LIST.format("l_partkey::varchar")}, '') as depicts,
coalesce(any_value(up.x), '') as parents, coalesce(any_value(down.x), '') as subimages,
count(distinct f) * 3 + count(distinct f) filter (n < 3) + coalesce(any_value(up.m), 0) + coalesce(any_value(down.m), 0) as support
from reps_ left join shown using (rep) left join (select s as rep, {_LIST.format("p")} as x, count(distinct i) as m from edges group by s) up using (rep) left join (select p as rep, {_LIST.format("s")} as x, count(distinct i) as m from edges group by p) down using (rep) group by rep""").replace("\n, edges", ",\nedges"))  # fmt: skip
def agg22_image_folds(spark, d):
    r = records.image_records(T.image_facts(spark, d), T.composites(spark, d), T.image_reps(spark, d))
    return r.select(*[_joined(x) if x in ("urls", "depicts", "parents", "subimages") else x for x in r.columns])


@query(sql("bag points owned_events names depicts", f""", {_LIFE},
{_VERDICT},
moved_ as (select owner, arg_max(p.lat, (landed is not null, coalesce(landed, -1), event)) as lat, arg_max(p.lon, (landed is not null, coalesce(landed, -1), event)) as lon from (select event, owner, coalesce(completed, started) as landed from owned_events where kind = 'moved') join points p on p.fact_id = event group by owner),
page as (select c.fact_id as entity, coalesce(m.lat, c.lat) as lat, coalesce(m.lon, c.lon) as lon from points c left join moved_ m on m.owner = c.fact_id where coalesce(m.lat, c.lat) between -40 and 40 and coalesce(m.lon, c.lon) between -90 and 90 order by 1 limit 40)
select entity, lat, lon, coalesce((select verdict from verdicts where day = 25 and verdicts.rep = page.entity), 'unknown') as verdict, (select min(lo) from bag where bag.rep = page.entity) as earliest, (select max(hi) from bag where bag.rep = page.entity) as latest,
coalesce((select {_LIST.format("lower(trim(name))")} from names n where n.entity = page.entity), '') as names, (select arg_min(image, (not exterior, image)) from depicts x where x.entity = page.entity) as thumbnail from page""").replace("\n, life", ",\nlife"))  # fmt: skip
def win10_viewport_listing(spark, d):
    p, b = T.points(spark, d), bag(spark, d)
    sites = p.select(F.col("fact_id").alias("entity"), "fact_id", "lat", "lon")
    moves = T.owned_events(spark, d).where("kind = 'moved'").join(p, F.col("event") == F.col("fact_id")).select(F.col("owner").alias("entity"), F.col("event").alias("fact_id"), "lat", "lon", F.coalesce("completed", "started").alias("landed"))
    box = spark.range(1).select(F.col("id").alias("box"), *[F.lit(v).alias(k) for k, v in (("south", -40.0), ("north", 40.0), ("west", -90.0), ("east", 90.0))])
    named = T.names(spark, d).select("entity", text.normalize_name(F.col("name")).alias("name"))
    spans = existence.lifespan(b).withColumnRenamed("rep", "entity")
    out = listing.list_entities(box, sites, moves, spans, b.select(F.col("rep").alias("entity"), "lo", "hi"), named, T.depicts(spark, d), 25, 40)
    return out.select(*[_joined(x) if x == "names" else x for x in out.columns])


@query("""select n_nationkey::bigint as "user", o_orderkey as item, o_orderdate as created_at from (select n_nationkey, o_orderkey, o_orderdate, row_number() over (partition by n_nationkey order by o_orderdate desc, o_orderkey desc) as rn from nation, customer, orders where (c_custkey + n_nationkey) % 7 = 0 and o_custkey = c_custkey) where rn <= 100""")
def jn15_followed_items(spark, d):
    """The 100 newest orders of the customers that each nation follows, every seventh one."""
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("subject"))
    start = F.pmod(-F.col("subject"), F.lit(7))
    follows = c.select(F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long")), lambda n: n % 7 == start)).alias("user"), "subject")
    items = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("created_at"))
    return listing.followed(items, follows, 100)


@query(sql("facts", """, numbered as (select *, row_number() over (order by fact_id) - 1 + 5000 as id from facts where kind <> 'retract')
select 'fact' as part, id as fact_id, kind, null::bigint as subject from numbered
union all select 'mention', id, kind, entity from numbered union all select 'mention', id, kind, entity + 1 from numbered where kind = 'event'
union all select 'witness', id, kind, entity from numbered where kind <> 'name' and (lo is not null or hi is not null)""").replace("\n, numbered", ",\nnumbered"))  # fmt: skip
def snk2_append_facts(spark, d):
    path = scratch(spark, "appended")
    new = T.facts(spark, d).where("kind <> 'retract'").withColumnRenamed("fact_id", "seq")
    subjects = F.when(F.col("kind") == "event", F.array("entity", F.col("entity") + 1, F.col("entity"))).otherwise(F.array("entity"))
    snapshot.append_facts(new, 5000, ["seq"], subjects, path)
    f, m, w = (spark.read.parquet(f"{path}/{x}") for x in ("facts", "fact_subjects", "witnesses"))
    out = f.select(F.lit("fact").alias("part"), "fact_id", "kind", F.lit(None).cast("long").alias("subject")).unionByName(m.select(F.lit("mention").alias("part"), "fact_id", "kind", "subject"))
    return out.unionByName(w.select(F.lit("witness").alias("part"), "fact_id", F.col("view").alias("kind"), F.col("entity").alias("subject")))


_UNION = """claims as (select fact_id, rep, kind, unnest(case when fact_id % 4 = 0 and lo is not null and hi is not null then [{'lo': lo, 'hi': hi}, {'lo': hi + 5, 'hi': hi + 9}] else [{'lo': lo, 'hi': hi}] end) as i from bag where lo is null or hi is null or lo <= hi),
ends as (select fact_id, rep, kind, coalesce(i.lo, -100000) as lo, coalesce(i.hi, 100000) as hi from claims),
days as (select distinct rep, kind, lo as day from ends union select rep, kind, hi + 1 from ends),
segs as (select rep, kind, day, lead(day) over (partition by rep, kind order by day) - 1 as upto from days),
covered as (select s.rep, s.kind, s.day, s.upto, count(*) as c from segs s join ends e on e.rep = s.rep and e.kind = s.kind and e.lo <= s.day and e.hi >= s.upto where s.upto is not null group by all),
n as (select rep, kind, count(distinct fact_id) as support from claims group by rep, kind)"""


@query(sql("bag", ", " + _UNION + """
select rep, kind, support, coalesce(sum(case when c = support then least(upto, 99999) - greatest(day, -99999) + 1 end), 0)::bigint as agreed_days, sum(least(upto, 99999) - greatest(day, -99999) + 1)::bigint as any_days, max(c) < support as conflict from n join covered using (rep, kind) group by rep, kind, support""").replace("\n, claims", ",\nclaims"))  # fmt: skip
def agg1_interval_unions(spark, d):
    """Days that all, or any, of the claims of a class and kind cover; every fourth claim has two intervals."""
    one = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    two = F.array(one(F.col("lo"), F.col("hi")), one(F.col("hi") + 5, F.col("hi") + 9))
    date = F.when((F.col("fact_id") % 4 == 0) & F.col("lo").isNotNull() & F.col("hi").isNotNull(), two).otherwise(F.array(one(F.col("lo"), F.col("hi"))))
    b = bag(spark, d).where("lo is null or hi is null or lo <= hi").withColumn("date", date)
    days = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, i: s + F.least(F.coalesce(i["hi"], F.lit(99999)), F.lit(99999)) - F.greatest(F.coalesce(i["lo"], F.lit(-99999)), F.lit(-99999)) + 1)
    return records.interval_bracket(b, "rep", "kind").select("rep", "kind", "support", days(F.col("consensus")).alias("agreed_days"), days(F.col("extent")).alias("any_days"), "conflict")


@query("select event_id, 'Q' || (event_id % 30) as q, event_id % 30 <> 0 as item, event_id % 3 = 1 and event_id % 7 <> 0 as property, case event_id % 4 when 0 then 'de' when 1 then 'en' when 2 then 'zh' end as subtag from events")
def sca17_ids_and_subtags(spark, d):
    i = F.col("event_id")
    q = F.concat(F.lit("Q"), (i % 30).cast("string"))
    p = F.concat(F.element_at(F.array(*map(F.lit, ("p", "P", "PP"))), (i % 3 + 1).cast("int")), (i % 7).cast("string"))
    tag = F.element_at(F.array(*map(F.lit, ("de", "EN-gb", "zh-Hant-TW", "1x"))), (i % 4 + 1).cast("int"))
    return T.table(spark, d, "events").select("event_id", q.alias("q"), text.is_item_id(q).alias("item"), text.is_property_id(p).alias("property"), text.language_subtag(tag).alias("subtag"))


@query("""select c as seq, sha256('{"author":"u' || min(user_id) || '","recorded_at":"' || strftime(date_trunc('second', min(ts)), '%Y-%m-%dT%H:%M:%SZ') || '","facts":[' || array_to_string(list_sort(list(event_id)), ',') || ']}') as commit_id from (select *, event_id // 10 as c from events) group by c""")
def sca14_commit_ids(spark, d):
    e = T.table(spark, d, "events").groupBy(F.expr("event_id div 10").alias("seq")).agg(F.min("user_id").alias("u"), F.min("ts").alias("ts"), F.collect_list("event_id").alias("facts"))
    return e.select("seq", text.commit_id(F.concat(F.lit("u"), F.col("u").cast("string")), F.col("ts"), F.col("facts")).alias("commit_id"))


@query()
def sca9_circle_rectangles(spark, d):
    """Distance of each point to the next one, and the rectangles that hold the circle through it."""
    p = T.points(spark, d)
    far = p.select((F.col("fact_id") - 1).alias("fact_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    x = p.join(far, "fact_id").withColumn("metres", geo.geodesic_m("lat", "lon", "lat2", "lon2"))
    return x.select("fact_id", "lat", "lon", "lat2", "lon2", "metres", geo.bounding_rects(F.col("lat"), F.col("lon"), F.col("metres")).alias("rects"))


def _unions(spark, d):
    """rep, fact_id, date of existence claims, every fourth of two intervals."""
    one = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    two = F.array(one(F.col("lo"), F.col("hi")), one(F.col("hi") + 5, F.col("hi") + 9))
    date = F.when((F.col("fact_id") % 4 == 0) & F.col("lo").isNotNull() & F.col("hi").isNotNull(), two).otherwise(F.array(one(F.col("lo"), F.col("hi"))))
    return bag(spark, d).where("kind = 'existence' and (lo is null or hi is null or lo <= hi)").select("rep", "fact_id", date.alias("date"))


_PAIRS = """, said as (select rep, fact_id, lo, hi from bag where kind = 'existence' and (lo is null or hi is null or lo <= hi)),
parts as (select rep, fact_id, coalesce(lo, -100000) as lo, coalesce(hi, 100000) as hi from said union all select rep, fact_id, hi + 5, hi + 9 from said where fact_id % 4 = 0 and lo is not null and hi is not null),
hulls as (select rep, fact_id, min(lo) as lo, max(hi) as hi from parts group by rep, fact_id),
pairs as (select x.rep, x.fact_id as a, y.fact_id as b, x.hi < y.lo or y.hi < x.lo as apart, not exists (select 1 from parts p join parts q on p.lo <= q.hi and q.lo <= p.hi where p.fact_id = x.fact_id and q.fact_id = y.fact_id) as fights from hulls x join hulls y on x.rep = y.rep and x.fact_id < y.fact_id)
"""


@query(sql("bag", _PAIRS + "select rep, count(*) filter (where apart) as n_apart, count(*) filter (where fights and not apart) as n_in_gaps from pairs where fights group by rep").replace("\n, said", ",\nsaid"))
def agg15_fighting_counts(spark, d):
    """How many pairs of claims have no common day: those one of which is over first, by blocks, and those that lie in each other's gaps."""
    claims = stored(_unions(spark, d), "claims")
    apart = conflicts.fighting_blocks(claims, "rep").groupBy("rep").agg(F.sum(F.col("n_before") * F.col("n_after")).alias("n_apart"))
    gaps = conflicts.gap_pairs(claims, "rep").groupBy("rep").agg(F.sum("n").alias("n_in_gaps"))
    return apart.join(gaps, "rep", "full").select("rep", F.coalesce("n_apart", F.lit(0)).alias("n_apart"), F.coalesce("n_in_gaps", F.lit(0)).alias("n_in_gaps"))


@query(sql("bag", _PAIRS + "select rep, a, b from pairs where apart").replace("\n, said", ",\nsaid"))
def agg15_block_pairs(spark, d):
    """The pairs that the blocks stand for."""
    claims = stored(_unions(spark, d), "claims")
    return conflicts.block_pairs(conflicts.fighting_blocks(claims, "rep"), claims, "rep")


@query(sql("bag", """select rep, array_to_string(list_sort(list(fact_id)), ',') as facts from (select rep // 40 as rep, max(fact_id) as fact_id from bag where kind = 'existence' group by rep // 40, fact_id % 3) group by rep having count(*) = 3"""))
def agg15_minimal_sets(spark, d):
    """Claims of three unions of intervals, each two of which have common days but not all three: an irreducible set of each forty classes that have all."""
    day, k = (F.col("rep") % 50).cast("int"), F.col("fact_id") % 3
    span = lambda *ends: F.array(*[F.struct((day + a).alias("lo"), (day + b).alias("hi")) for a, b in ends])
    date = F.when(k == 0, span((0, 10))).when(k == 1, span((5, 20))).otherwise(span((0, 3), (15, 20)))
    claims = stored(bag(spark, d).where("kind = 'existence'").withColumn("rep", F.expr("rep div 40")).select("rep", "fact_id", date.alias("date")), "claims")
    return conflicts.minimal_fighting_set(claims, "rep").select("rep", F.array_join(F.array_sort("facts").cast("array<string>"), ",").alias("facts"))


@query(sql("rep_log", """, e(a, b) as (select c_custkey, c_custkey - 1 from customer where c_custkey % 5 <> 0),
now as (select c_custkey as member, c_custkey - c_custkey % 5 as rep from customer),
was as (select member, arg_max(greatest(rep, member - member % 5), as_of) as rep from rep_log where member % 10 < 5 group by member),
touched as (select now.member from now where now.rep % 10 = 0)
select now.member, 1000000000::bigint as as_of, now.rep from now join touched using (member) left join was using (member) where now.rep <> coalesce(was.rep, now.member) and now.rep % 10 = 0""").replace("\n, e(", ",\ne("))  # fmt: skip
def gr5_update_touched(spark, d):
    """Upkeep of every other class, over a log that is right for its own members."""
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("member"))
    rep = F.col("member") - F.col("member") % 5
    log = T.rep_log(spark, d).where("member % 10 < 5").withColumn("rep", F.greatest("rep", F.col("member") - F.col("member") % 5))
    edges = c.where("member % 5 <> 0").select(F.col("member").alias("a"), (F.col("member") - 1).alias("b"))
    return identity.update_touched(log, edges, c.where(rep % 10 == 0), 1_000_000_000)
