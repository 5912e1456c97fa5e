"""Walks against a sorted list, splits and sites of ingested items, and the length of a meridian."""

import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import geo
from palimpsest.operators import ingest, walks
from palimpsest.scratch import scratch


def test_walk_pages(spark):
    """Pages by row and by class equal those of a sorted list, one class holding a third of the rows and many parts."""
    pick = random.Random(4)
    rows = sorted({(7 if pick.random() < 0.33 else pick.randrange(40), pick.randrange(400)) for _ in range(400)})
    path = scratch(spark, "walk")
    walks.write_class_walk(spark.createDataFrame(rows * 2, "rep long, fact_id long"), path, 9)
    top = rows[-1][0]
    for after, limit in [(None, 70), ((7, 100), 1), ((7, 390), 60), (rows[-2], 5), (rows[-1], 5), ((3, walks.LAST), 200), ((41, 0), 3)]:
        got, left = walks.page(spark, path, after, limit), [r for r in rows if after is None or r > after]
        assert [tuple(r) for r in got.rows.collect()] == left[:limit]
        assert got.next == (left[limit - 1] if len(left) > limit else None)
        assert got.next_class == ((left[:limit][-1][0], walks.LAST) if left and left[:limit][-1][0] < top else None)
    for after, n in [(None, 3), ((7, 100), 1), ((7, 100), 2), ((7, walks.LAST), 4), ((38, 0), 50), ((41, 0), 2)]:
        got, left = walks.class_page(spark, path, after, n), [r for r in rows if after is None or r > after]
        kept = sorted({r for r, _ in left})[:n]
        assert sorted(tuple(r) for r in got.rows.collect()) == [r for r in left if r[0] in kept]
        assert got.next_class == ((kept[-1], walks.LAST) if kept and kept[-1] < top else None)


def test_walk_page_reads_few_parts(spark):
    """A page's plan names the parts that it reads, and sorts no more than a page."""
    path = scratch(spark, "walk")
    walks.write_walk(spark.range(10_000).select(F.col("id").alias("rep"), F.col("id").alias("fact_id")), path, 16)
    got = walks.page(spark, path, (5000, 0), 20)
    plan = got.rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "PartitionFilters: [part#" in plan and len(walks._parts(spark, path, (5000, 0), 21)) <= 2
    empty = scratch(spark, "walk")
    walks.write_class_walk(spark.createDataFrame([], "rep long, fact_id long"), empty)
    assert walks.page(spark, empty, None, 5).rows.collect() == [] and walks.class_page(spark, empty, None, 5).next_class is None


def test_meridian(spark):
    pairs = [(0.0, 1.0), (45.0, 45.01), (-89.99, -89.0), (88.0, 90.0), (-10.0, 10.0)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a double, b double").select(geo.meridian_m(F.col("b")) - geo.meridian_m(F.col("a"))).collect()]
    a, b = np.array(pairs).T
    assert np.allclose(got, geo.ellipsoid_metres(a, a * 0, b, b * 0), atol=1e-4)


def item(i, **claims):
    time = lambda y: {"mainsnak": {"datavalue": {"type": "time", "value": f'{{"time":"+{y}-00-00T00:00:00Z","precision":9}}'}}, "rank": "normal", "qualifiers": {}}
    site = lambda lat, lon, p: {"mainsnak": {"datavalue": {"type": "globecoordinate", "value": f'{{"latitude":{lat},"longitude":{lon},"precision":{p}}}'}}, "rank": "normal", "qualifiers": {}}
    return (i, {}, {k: [site(*v) if k == "P625" else time(v) for v in vs] for k, vs in claims.items()}, {})


SCHEMA = "id string, labels map<string,struct<language:string,value:string>>, claims map<string,array<struct<mainsnak:struct<datavalue:struct<type:string,value:string>>,rank:string,qualifiers:map<string,array<struct<datavalue:struct<type:string,value:string>>>>>>>, sitelinks map<string,struct<title:string>>"


def test_splits_and_sites(spark):
    items = spark.createDataFrame([
        item("Q1", P571=[1500, 1800], P576=[1700], P625=[(10, 20, 0.1)]),  # inceptions are one contribution: no rebuild
        item("Q2", P625=[(10, 20, "null"), (95, 0, 1)]),  # a site alone, and one outside the globe
        item("Q3", P571=[1900], P576=[1900], P625=[(89.95, 0, 0.1)]),  # built and torn down in one year
        item("P5", P571=[1900]),  # not an item
        item("Q4"),
    ], SCHEMA)
    facts, warnings = ingest.build_bundles(items)
    rows = facts.collect()
    assert {(r.id, r.part) for r in rows} == {("Q1", 0), ("Q2", 0), ("Q3", 0), ("Q4", 0)}
    place = {r.id: r for r in rows if r.kind == "construction_location"}
    assert set(place) == {"Q1", "Q2", "Q3"} and place["Q2"].radius_m is None
    one, near = geo.ellipsoid_metres(np.array([10.0, 89.95]), np.zeros(2), np.array([10.1, 89.85]), np.zeros(2))
    assert abs(place["Q1"].radius_m - one) < 1e-3 and abs(place["Q3"].radius_m - near) < 1e-3
    assert [(w.id, w.property) for w in warnings.collect()] == [("Q2", "P625")]
    none = spark.createDataFrame([], "value string")
    (got,) = ingest.ingest_stats(items, none, facts, warnings).collect()
    assert got.asDict() == {"n_items": 5, "n_malformed": 0, "n_facts": len(rows), "n_warnings": 1, "n_commits": 4, "n_entities": 4, "n_skipped": 1, "n_failed": 0}
