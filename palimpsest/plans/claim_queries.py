"""Queries over the claim log: snapshots, identity, existence, conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import conflicts, existence, folds, graph, identity, snapshot
from palimpsest.plans.registry import query
from palimpsest.scratch import stored
from palimpsest.sources import testbed as T
from palimpsest.sources.testbed import sql

#: Days at which verdicts are asked, and the snapshot bound of the as-of reads.
DAYS = [5, 15, 25, 45]
BOUND = 700


def live_facts(spark, d):
    return snapshot.live(T.facts(spark, d))


def bag(spark, d):
    """Live dated facts with the representative of their entity's class."""
    facts = T.events_of(live_facts(spark, d).where(F.col("kind").isin(snapshot.DATED)))
    reps = identity.representatives(facts.select(F.col("entity").alias("member")), T.same_edges(spark, d))
    return stored(facts.join(reps.withColumnRenamed("member", "entity"), "entity"), "bag")


@query(sql("facts", f"select fact_id, kind, entity from facts where fact_id < {BOUND}"))
def src5_facts_at(spark, d):
    return snapshot.facts_at(T.facts(spark, d), BOUND).select("fact_id", "kind", "entity")


@query(sql("facts", "select count(*) as n_facts, max(fact_id) + 1 as next_fact_id from facts"))
def src6_mount(spark, d):
    f = T.facts(spark, d)
    both = snapshot.mount(f.where(F.col("fact_id") < BOUND), f.where(F.col("fact_id") >= BOUND))
    return both.agg(F.count("*").alias("n_facts"), (F.max("fact_id") + 1).alias("next_fact_id"))


@query("select event_id, row_number() over (order by ts, event_id) - 1 + 1000000 as fact_id from events")
def snk2_append_ids(spark, d):
    return snapshot.append_ids(T.table(spark, d, "events").select("ts", "event_id"), 1_000_000, ["ts", "event_id"]).select("event_id", "fact_id")


@query(sql("retracted", "select fact_id as target, retractor from retracted"))
def gr2_effective_retractor(spark, d):
    return snapshot.effective_retractors(snapshot.retraction_edges(T.facts(spark, d)))


@query(sql("live", "select fact_id, kind from live"))
def jn1_live_facts(spark, d):
    return live_facts(spark, d).select("fact_id", "kind")


@query(sql("retracted", f"""select i as fact_id, case when f.fact_id is null then 'unknown' when i >= {BOUND} then 'future' when r.fact_id is not null then 'retracted' else 'active' end as state,
case when f.fact_id is not null and i < {BOUND} then r.retractor end as retractor
from (select event_id * 2 as i from events) left join (select * from facts) f on f.fact_id = i
left join (select x as fact_id, min(r) as retractor from redges where r < {BOUND} and r not in (select x from dead{T.DEPTH}) group by x) r on r.fact_id = i"""))  # fmt: skip
def flt8_lookup(spark, d):
    f = T.facts(spark, d)
    by = snapshot.effective_retractors(snapshot.retraction_edges(f)).where(F.col("retractor") < BOUND)
    return snapshot.lookup(T.table(spark, d, "events").select((F.col("event_id") * 2).alias("fact_id")), f, by, BOUND)


@query(sql("retracted", """, touched(x) as (select fact_id from facts where kind = 'retract' and fact_id % 29 = 0 union select e.x from touched t join redges e on e.r = t.x)
select x as fact_id from touched""").replace("\n, touched", ",\ntouched"))  # fmt: skip
def gr4_touched_targets(spark, d):
    f = T.facts(spark, d)
    return snapshot.touched_targets(f.where("kind = 'retract' and fact_id % 29 = 0"), snapshot.retraction_edges(f))


def share_bound(f):
    """A snapshot bound that follows the log: seven tenths of the greatest id."""
    return f.agg(F.expr("max(fact_id) * 7 div 10")).first()[0]


_SHARE = "(select max(fact_id) * 7 // 10 from facts)"
#: The retraction views of ``testbed`` as of that bound.
_KNOWN = f", known as (select * from facts where fact_id < {_SHARE}),\n{T.VIEWS['retracted'].replace('from facts', 'from known').replace('join facts', 'join known')}\n"


@query(sql("facts", f"select fact_id, kind, entity from facts where fact_id < {_SHARE}"))
def src5_facts_at_share(spark, d):
    f = T.facts(spark, d)
    return snapshot.facts_at(f, share_bound(f)).select("fact_id", "kind", "entity")


@query(sql("facts", f"select count(*) as n_facts, max(fact_id) + 1 as next_fact_id, count(*) filter (where fact_id < {_SHARE}) as n_base from facts"))
def src6_mount_share(spark, d):
    f = T.facts(spark, d)
    n = share_bound(f)
    both = snapshot.mount(snapshot.facts_at(f, n).withColumn("base", F.lit(1)), f.where(F.col("fact_id") >= n))
    return both.agg(F.count("*").alias("n_facts"), (F.max("fact_id") + 1).alias("next_fact_id"), F.count("base").alias("n_base"))


@query(sql("facts", _KNOWN + f"""select i as fact_id, case when f.fact_id is null then 'unknown' when i >= {_SHARE} then 'future' when r.fact_id is not null then 'retracted' else 'active' end as state, r.retractor
from (select event_id * 2 as i from events) left join facts f on f.fact_id = i left join retracted r on r.fact_id = i and f.fact_id is not null and i < {_SHARE}""").replace("\n, known", ",\nknown"))  # fmt: skip
def flt8_lookup_share(spark, d):
    f = T.facts(spark, d)
    n = share_bound(f)
    by = snapshot.effective_retractors(snapshot.retraction_edges(snapshot.facts_at(f, n)))
    return snapshot.lookup(T.table(spark, d, "events").select((F.col("event_id") * 2).alias("fact_id")), f, by, n)


@query(sql("retracted", """, touched(x) as (select fact_id from facts where kind = 'retract' union select e.x from touched t join redges e on e.r = t.x)
select x as fact_id from touched""").replace("\n, touched", ",\ntouched"))  # fmt: skip
def gr4_touched_by_all(spark, d):
    f = T.facts(spark, d)
    return snapshot.touched_targets(f.where("kind = 'retract'"), snapshot.retraction_edges(f))


@query("""with recursive e(a, b) as (select c_custkey, c_custkey - 1 from customer where c_custkey % 5 <> 0),
both_(a, b) as (select a, b from e union select b, a from e),
reach(a, b) as (select a, b from both_ union select reach.a, both_.b from reach join both_ on reach.b = both_.a)
select c_custkey as member, least(c_custkey, coalesce(min(b), c_custkey)) as rep from customer left join reach on a = c_custkey group by c_custkey""")
def gr1_components(spark, d):
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("member"))
    return identity.representatives(c, c.where("member % 5 <> 0").select(F.col("member").alias("a"), (F.col("member") - 1).alias("b")))


@query("""with recursive e(child, parent) as (select p_partkey, p_partkey // 4 from part),
up(t) as (select 0::bigint union select child from up join e on parent = t where child <> t),
ex(t) as (select unnest([3, 7])::bigint union select child from ex join e on parent = t)
select t as type from up where t not in (select t from ex)""")
def gr3_type_closure(spark, d):
    edges = T.table(spark, d, "part").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 4").alias("parent")).where("child <> parent")
    roots = lambda *x: spark.range(0, 8).where(F.col("id").isin(*x)).select(F.col("id").alias("type"))
    return graph.type_closure(edges, roots(0), roots(3, 7))


@query("""with recursive e(child, parent) as (select p_partkey, p_partkey // 4 from part where p_partkey <> 0),
up(t) as (select 1::bigint union select child from up join e on parent = t), ex(t) as (select 7::bigint union select child from ex join e on parent = t)
select ps as item from (select l_orderkey as ps, list(distinct l_partkey) as types from lineitem group by l_orderkey) where list_has_any(types, (select list(t) from up where t not in (select t from ex)))""")
def jn13_filter_instances(spark, d):
    edges = T.table(spark, d, "part").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 4").alias("parent")).where("child <> 0")
    one = lambda x: spark.range(x, x + 1).select(F.col("id").alias("type"))
    items = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_set("l_partkey").alias("types"))
    return graph.filter_instances(items, graph.type_closure(edges, one(1), one(7))).select("item")


@query(sql("rep_log", f"select c_custkey as member, coalesce(r, c_custkey) as rep from customer left join (select member, arg_max(rep, as_of) as r from rep_log where as_of < {BOUND * 20} group by member) on member = c_custkey"))
def jn3_resolve_reps(spark, d):
    return identity.resolve_reps(T.table(spark, d, "customer").select(F.col("c_custkey").alias("member")), T.rep_log(spark, d), BOUND * 20)


@query(sql("rep_log", f"select arg_max(rep, as_of) as rep, member from rep_log where as_of < {BOUND * 20} group by member"))
def jn4_class_members(spark, d):
    return identity.class_members(T.rep_log(spark, d), BOUND * 20)


@query(sql("rep_log", """, e(a, b) as (select c_custkey, c_custkey - 1 from customer where c_custkey % 5 <> 0),
both_(a, b) as (select a, b from e union select b, a from e),
reach(a, b) as (select a, b from both_ union select reach.a, both_.b from reach join both_ on reach.b = both_.a),
now as (select c_custkey as member, least(c_custkey, coalesce(min(b), c_custkey)) as rep from customer left join reach on a = c_custkey group by c_custkey),
was as (select member, arg_max(rep, as_of) as rep from rep_log where as_of < 1000000000 group by member)
select now.member, 1000000000::bigint as as_of, now.rep from now left join was using (member) where now.rep <> coalesce(was.rep, now.member)""").replace("\n, e(", ",\ne("))  # fmt: skip
def gr5_update_reps(spark, d):
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("member"))
    return identity.update_reps(T.rep_log(spark, d), c, c.where("member % 5 <> 0").select(F.col("member").alias("a"), (F.col("member") - 1).alias("b")), 1_000_000_000)


_LIFE = """life as (select rep, min(case when lo is null then hi else lo end) as earliest, max(case when hi is null then lo else hi end) as affirmed,
 max(case when kind <> 'demolition_completed' then lo end) as reached, max(case when kind = 'construction_started' then lo end) as floor,
 min(case when kind = 'demolition_completed' then hi end) as denies_after, max(case when kind = 'demolition_completed' then hi end) as claimed_through,
 coalesce(bool_or(kind = 'demolition_started' or (kind = 'demolition_completed' and hi is null)), false) as unbounded, coalesce(bool_or(kind in ('demolition_started', 'demolition_completed')), false) as claimed from bag group by rep),
pres as (select *, (not claimed or (not unbounded and coalesce(reached > claimed_through, false))) as presumes from life)"""
_DAYS = "(select unnest([5, 15, 25, 45]) as day)"
_VERDICT = f"""verdicts as (select rep, day, case when denied and supported then 'contested' when denied then 'absent' when not supported then 'unknown' when affirms then 'uncontested' else 'presumed' end as verdict
 from (select *, affirms or (presumes and coalesce(day > affirmed, false)) as supported from
 (select *, coalesce(day < floor, false) or coalesce(day > denies_after, false) as denied, coalesce(earliest <= day and day <= affirmed, false) as affirms from pres, {_DAYS})))"""
_WINDOW = """win as (select *, case when closed then earliest when not closed and affirmed is not null and presumes then affirmed + 1 end as support_from, case when closed and not presumes then affirmed end as support_through
 from (select *, coalesce(earliest <= affirmed, false) as closed from pres))"""


def _bag_sql(parts: str, body: str) -> str:
    return sql("bag", "," + parts + "\n" + body).replace("\n,", ",\n", 1) if parts else sql("bag", body)


@query(_bag_sql(_LIFE, "select rep, earliest, affirmed, reached, floor, denies_after, claimed_through, unbounded, claimed from life"))
def agg7_lifespan(spark, d):
    return existence.lifespan(bag(spark, d))


@query(_bag_sql(f"{_LIFE},\n{_WINDOW}", "select rep, support_from, support_through, support_from is not null as supported from win"))
def agg8_support_window(spark, d):
    return existence.support_window(existence.lifespan(bag(spark, d))).select("rep", "support_from", "support_through", "supported")


@query(_bag_sql(f"{_LIFE},\n{_VERDICT}", "select rep, day, verdict from verdicts"))
def agg9_existence_verdict(spark, d):
    days = F.explode(F.array(*map(F.lit, DAYS)))
    return existence.lifespan(bag(spark, d)).withColumn("day", days).select("rep", "day", existence.verdict(F.col("day")).alias("verdict"))


@query(_bag_sql(f"{_LIFE},\n{_VERDICT}", "select day, verdict, count(*) as n_entities from verdicts group by day, verdict"))
def standing_entities(spark, d):
    """Which entities stood on each probe day, and how surely."""
    return agg9_existence_verdict(spark, d).groupBy("day", "verdict").agg(F.count("*").alias("n_entities"))


@query(_bag_sql(f"{_LIFE},\n{_WINDOW}", "select rep from win where support_from <= 20 and (support_through is null or support_through >= 10)"))
def flt6_in_time_range(spark, d):
    return existence.in_time_range(existence.lifespan(bag(spark, d)), 10, 20).select("rep")


@query(_bag_sql(f"{_LIFE},\n{_VERDICT}", "select rep % 97 as pin, arg_max(verdict, list_position(['absent', 'unknown', 'presumed', 'contested', 'uncontested'], verdict)) as verdict from verdicts where day = 25 group by rep % 97"))
def agg18_pin_existence(spark, d):
    v = existence.lifespan(bag(spark, d)).select("rep", existence.verdict(25).alias("verdict"))
    return v.groupBy((F.col("rep") % 97).alias("pin")).agg(existence.strongest(F.col("verdict")).alias("verdict"))


@query(sql("depicts", """select entity, min(lo) as earliest, max(lo) as affirmed, count(*) as n_sightings from
(select distinct a.image, a.entity, b.subject_day as lo from depicts a join depicts b using (image)) group by entity"""))
def agg10_sightings(spark, d):
    x = T.depicts(spark, d)
    seen = existence.sightings(x, x.select("image", F.col("subject_day").alias("lo"), F.col("subject_day").alias("hi")))
    return seen.groupBy("entity").agg(F.min("lo").alias("earliest"), F.max("hi").alias("affirmed"), F.count("*").alias("n_sightings"))


_BOUNDS = """bounds as (select rep, case when not coalesce(bool_or(kind = 'construction_started' and lo is null), false) then min(case when kind = 'construction_started' then lo end) end as floor,
 case when not coalesce(bool_or(kind = 'demolition_completed' and hi is null), false) then max(case when kind = 'demolition_completed' then hi end) end as ceiling from bag group by rep),
viol as (select w.rep, fact_id, kind, event, lo, hi, 'floor' as bound from bag w join bounds using (rep) where kind in ('existence', 'event') and hi < floor
 union all select w.rep, fact_id, kind, event, lo, hi, 'ceiling' from bag w join bounds using (rep) where kind in ('existence', 'event') and lo > ceiling)"""


@query(_bag_sql(_BOUNDS, "select rep, floor, ceiling from bounds"))
def agg11_lifetime_bounds(spark, d):
    return conflicts.lifetime_bounds(bag(spark, d))


@query(_bag_sql(_BOUNDS, "select rep, fact_id, lo, hi, bound from viol"))
def jn10_witness_violations(spark, d):
    b = bag(spark, d)
    return conflicts.witness_violations(b, conflicts.lifetime_bounds(b)).drop("kind", "event")


@query(_bag_sql(_BOUNDS, """select rep, bound, witness, array_to_string(witnesses, ',') as witnesses, array_to_string(list_sort(list_distinct(bookends)), ',') as bookends from
(select rep, bound, list_sort(list(distinct fact_id)) as witnesses, case when bound = 'floor' then arg_min(fact_id, (-hi, fact_id)) else arg_min(fact_id, (lo, fact_id)) end as witness
 from viol group by rep, bound, case when kind = 'event' then 'e' || event else coalesce(lo::varchar, '-') || ',' || coalesce(hi::varchar, '-') end)
join (select rep, case when kind = 'construction_started' then 'floor' else 'ceiling' end as bound, list(fact_id) as bookends from bag where kind in ('construction_started', 'demolition_completed') group by all) using (rep, bound)"""))
def agg12_temporal_conflicts(spark, d):
    c = conflicts.temporal_conflicts(bag(spark, d))
    return c.select("rep", "bound", "witness", F.array_join(F.col("witnesses").cast("array<string>"), ",").alias("witnesses"), F.array_join(F.col("bookends").cast("array<string>"), ",").alias("bookends"))


@query(_bag_sql("""chain as (select rep, max(case when kind in ('existence', 'event') then lo end) as w, case when not coalesce(bool_or(kind = 'demolition_completed' and hi is null), false) then max(case when kind = 'demolition_completed' then hi end) end as dd,
 case when not coalesce(bool_or(kind = 'construction_started' and lo is null), false) then min(case when kind = 'construction_started' then lo end) end as c,
 coalesce(max(case when kind = 'construction_started' then lo end) > min(case when kind = 'demolition_completed' then hi end), false) as bad from bag group by rep),
x as (select bag.*, w, dd, c, bad, kind in ('construction_started', 'construction_completed') and not bad and coalesce(hi > dd, false) and (lo is null or coalesce(lo <= dd, false)) as cut,
 kind = 'demolition_completed' and not bad and coalesce(lo < w, false) and (hi is null or coalesce(w <= hi, false)) as fw, kind = 'demolition_completed' and not bad and coalesce(lo < c, false) and (hi is null or coalesce(c <= hi, false)) as fc from bag join chain using (rep))""",
"""select fact_id, coalesce(greatest(case when fw then w end, case when fc then c end), lo) as new_lo, case when cut then dd else hi end as new_hi,
array_to_string(list_filter([case when cut then 'construction_before_demolition' end, case when fw and w = greatest(case when fw then w end, case when fc then c end) then 'witness_before_demolition' end, case when fc and c = greatest(case when fw then w end, case when fc then c end) then 'start_before_demolition' end], lambda r: r is not null), '+') as rules from x"""))  # fmt: skip
def agg13_narrow(spark, d):
    return conflicts.narrow(bag(spark, d)).select("fact_id", "new_lo", "new_hi", F.array_join("rules", "+").alias("rules"))


@query(_bag_sql("""w as (select * from bag where kind in ('existence', 'event') and hi is not null and rep not in (select rep from bag where kind = 'construction_started'))""",
"select rep, m as built_by, max(precision) as precision, array_to_string(list_sort(list(distinct fact_id)), ',') as evidence from w join (select rep, min(hi) as m from w group by rep) using (rep) where hi = m group by rep, m"))
def agg14_built_by(spark, d):
    return conflicts.built_by(bag(spark, d)).select("rep", "built_by", "precision", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


@query(_bag_sql("", "select p.rep, least(p.fact_id, q.fact_id) as a, greatest(p.fact_id, q.fact_id) as b from bag p join bag q on p.rep = q.rep and p.kind = q.kind and p.hi < q.lo where p.kind = 'construction_started'"))
def agg15_fighting_pairs(spark, d):
    return conflicts.fighting_pairs(bag(spark, d), "construction_started")


@query(_bag_sql("", "select rep, kind, max(lo) as consensus_lo, min(hi) as consensus_hi, coalesce(max(lo) > min(hi), false) as conflict, case when bool_or(lo is null) then null else min(lo) end as extent_lo, case when bool_or(hi is null) then null else max(hi) end as extent_hi, count(*) as support from bag group by rep, kind"))
def agg1_date_bracket(spark, d):
    return folds.date_bracket(bag(spark, d), "rep", "kind")


@query(_bag_sql("", "select rep, case when bool_or(lo is null) then null else min(lo) end as lo, case when bool_or(hi is null) then null else max(hi) end as hi from bag group by rep"))
def agg2_envelope(spark, d):
    return folds.envelope(bag(spark, d), "rep")


@query(_bag_sql("", "select rep, min(lo) as first_day, max(hi) as last_day, count(*) as n from bag where kind = 'event' group by rep"))
def agg17_timeline_span(spark, d):
    return bag(spark, d).where("kind = 'event'").groupBy("rep").agg(F.min("lo").alias("first_day"), F.max("hi").alias("last_day"), F.count("*").alias("n"))


@query(_bag_sql("", """select rep, sum(new)::bigint as n_spans, sum(len) as n_days from (
 select rep, g, 1 as new, max(hi) - min(lo) + 1 as len from (select *, sum(fresh) over (partition by rep order by lo, hi, fact_id rows unbounded preceding) as g from (
  select *, case when lo > 1 + max(hi) over (partition by rep order by lo, hi, fact_id rows between unbounded preceding and 1 preceding) then 1 else 0 end as fresh from bag where lo is not null and hi is not null and lo <= hi)) group by rep, g) group by rep"""))
def win9_coalesce_intervals(spark, d):
    spans = folds.coalesce_intervals(bag(spark, d).where("lo is not null and hi is not null and lo <= hi"), "rep")
    return spans.groupBy("rep").agg(F.count("*").alias("n_spans"), F.sum(F.col("hi") - F.col("lo") + 1).alias("n_days"))


@query(sql("facts", "select fact_id, kind, entity as subject from facts where kind <> 'retract' union all select fact_id, kind, entity + 1 from facts where kind = 'event'"))
def prj2_mentions(spark, d):
    return folds.mentions(T.facts(spark, d).where("kind <> 'retract'"), F.when(F.col("kind") == "event", F.array("entity", F.col("entity") + 1, F.col("entity"))).otherwise(F.array("entity")))


@query(sql("dated", "select kind as view, fact_id, entity, lo as date_earliest, hi as date_latest from dated"))
def prj3_witness_views(spark, d):
    return folds.witness_views(T.dated(spark, d))


@query(sql("facts", """select event_id as fact_id, event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k, case when event_type = 'purchase' then value end as amount from events"""))
def prj1_facets(spark, d):
    e = T.table(spark, d, "events")
    return folds.facets(e.select(F.col("event_id").alias("fact_id"), "event_type", "value", "props"))


@query(sql("live", "select l.fact_id, kind, entity from live l join (select distinct c_custkey as entity from customer where c_custkey % 3 = 0) using (entity)"))
def jn2_backlinks(spark, d):
    wanted = T.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("entity"))
    return folds.backlinks(wanted, live_facts(spark, d)).select("fact_id", "kind", "entity")


@query(sql("bag owned_events", """select coalesce(rep, entity) as rep, count(distinct fact_id) as n_facts from (
 select entity, fact_id from live where kind <> 'retract' union select owner as entity, event + 1000000000 from owned_events) left join reps on member = entity group by 1"""))
def jn6_entity_fact_bag(spark, d):
    facts = live_facts(spark, d).where("kind <> 'retract'").select("entity", "fact_id")
    events = T.owned_events(spark, d)
    members = facts.select(F.col("entity").alias("member")).unionByName(events.select(F.col("owner").alias("member")))
    reps = identity.representatives(members, T.same_edges(spark, d))
    owned = events.select(F.col("owner").alias("entity"), "event")
    out = folds.entity_fact_bag(reps, facts, owned, events.select("event", (F.col("event") + 1_000_000_000).alias("fact_id")))
    return out.groupBy("rep").agg(F.countDistinct("fact_id").alias("n_facts"))
