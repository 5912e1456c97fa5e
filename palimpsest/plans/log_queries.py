"""Queries over the appended log: its ledger of results and its walk."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import walks
from palimpsest.plans.registry import query
from palimpsest.scratch import scratch
from palimpsest.sources import testbed as T
from palimpsest.sources.testbed import sql
from palimpsest.streaming import jobs, ledger


@query(sql("facts", """, b as (select commit_seq as c, count(*) as n, commit_seq % 7 = 3 and bool_or(lo is not null and fact_id % 10 = 2) as inverted, commit_seq % 11 = 5 as unknown from facts group by 1)
select sha256(c::varchar) as commit_id, case when inverted or unknown then 'rejected' else 'accepted' end as outcome, case when inverted or unknown then 0 else n end as n_facts,
 concat_ws(',', case when inverted then 'inverted_window' end, case when unknown then 'unknown_target' end) as rules, true as dense, true as replayed from b""").replace("\n, b as", ",\nb as"))  # fmt: skip
def str1_ledger(spark, d):
    """Bundles that come in pieces, some broken, some sent twice: the result of each, whether ids are dense and replays give the first result."""
    f = T.facts(spark, d)
    c, i = F.col("commit_seq"), F.col("fact_id")
    sizes = f.groupBy("commit_seq").agg(F.count("*").cast("long").alias("n_facts"))
    rows = f.join(sizes, "commit_seq").select(
        F.sha2(c.cast("string"), 256).alias("commit_id"), F.timestamp_seconds(c * 86400).alias("ts"), i.alias("fact"), "n_facts", "kind", "entity", "lo",
        F.when((c % 7 == 3) & (i % 10 == 2) & F.col("lo").isNotNull(), F.col("lo") - 1).when(F.col("hi") >= F.col("lo"), F.col("hi")).alias("hi"),
        F.when(c % 11 == 5, F.lit(1 << 40)).alias("retracts_fact_id"), c.alias("_c"))
    # The last facts of a bundle come some bundles later, and every tenth bundle comes again at the end.
    sent = rows.withColumn("_at", F.col("_c") + F.when(F.col("fact") % 10 > 7, 40).otherwise(0)).unionByName(rows.where("_c % 10 = 0").withColumn("_at", F.lit(1 << 30)))
    folder = scratch(spark, "ledger")
    plain = rows.drop("_c").schema
    ledger.append(jobs.log_stream(spark, sent.drop("_c"), 4, "_at").drop("_at"), folder)
    results = ledger.results(spark, folder)
    first = results.where("outcome <> 'replayed'").select("commit_id", "outcome", "n_facts", "first_id", F.array_join("rules", ",").alias("rules")).distinct()
    again = results.where("outcome = 'replayed'").select("commit_id", F.col("first_id").alias("_f"), F.col("n_facts").alias("_n")).distinct()
    log = ledger.facts(spark, folder, plain).agg((F.coalesce(F.max("fact_id") + 1, F.lit(0)) == F.countDistinct("fact_id")).alias("dense"))
    same = F.coalesce((F.col("_f") == F.col("first_id")) & (F.col("_n") == F.col("n_facts")), F.lit(True))
    return first.join(again, "commit_id", "left").crossJoin(F.broadcast(log)).select("commit_id", "outcome", "n_facts", "rules", "dense", same.alias("replayed"))


def walk(spark, d):
    """The walk of the log's facts by entity, written, and an entity in its middle."""
    f, path = T.facts(spark, d), scratch(spark, "walk")
    walks.write_class_walk(f.select(F.col("entity").alias("rep"), "fact_id"), path)
    return path, f.agg(F.expr("max(entity) div 2")).first()[0]


@query(sql("facts", """, w as (select distinct entity as rep, fact_id from facts), m as (select max(entity) // 2 as m from facts),
p as (select rep, fact_id from w, m where (rep, fact_id) > (m, 50) order by 1, 2 limit 256), z as (select max(rep) as rep from p)
select rep, fact_id, (select count(*) from w, m where (rep, fact_id) > (m, 50)) > 256 as more, (select max(rep) from w) > (select rep from z) as more_classes from p""").replace("\n, w as", ",\nw as"))  # fmt: skip
def win2_walk_page(spark, d):
    """A page of the written walk, whether rows remain past it, and whether classes do."""
    path, middle = walk(spark, d)
    got = walks.page(spark, path, (middle, 50), 256)
    return got.rows.select("rep", "fact_id", F.lit(got.next is not None).alias("more"), F.lit(got.next_class is not None).alias("more_classes"))


@query(sql("facts", """, w as (select distinct entity as rep, fact_id from facts), m as (select max(entity) // 2 as m from facts),
c as (select distinct rep from w, m where rep > m order by 1 limit 100) select rep, fact_id from w where rep in (select rep from c)""").replace("\n, w as", ",\nw as"))
def win2_class_page(spark, d):
    """The next hundred classes past a class, each with all its rows."""
    path, middle = walk(spark, d)
    return walks.class_page(spark, path, (middle, walks.LAST), 100).rows
