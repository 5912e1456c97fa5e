"""Queries that do the whole job where older ones, as their SQL has it, read a part."""

import random

import numpy as np

from palimpsest.functions import geo
from palimpsest.operators import capture, maps
from palimpsest.plans import QUERIES, map_queries
from palimpsest.sources import testbed as T

DIR = "/root/testdata/sf0.001"


def edge_points(south, north, west, east):
    """Many points of the edges of a box, west > east across the antimeridian."""
    lat, lon = np.linspace(south, north, 201), np.linspace(west, east + 360 * (west > east), 201)
    return np.concatenate([lat, lat, np.full(201, south), np.full(201, north)]), np.concatenate([np.full(201, west), np.full(201, east), lon, lon])


def test_circles_in_viewport(spark):
    boxes, circles = T.viewports(spark, DIR).collect(), map_queries.circles(spark, DIR).collect()
    got = {tuple(r) for r in QUERIES["flt5_circles_in_viewport"](spark, DIR).collect()}
    assert {b for b, _ in got} == {b["box"] for b in boxes}
    for b in boxes:
        lat, lon = edge_points(b["south"], b["north"], b["west"], b["east"])
        for c in circles:
            in_lon = b["west"] <= c["lon"] <= b["east"] if b["west"] <= b["east"] else c["lon"] >= b["west"] or c["lon"] <= b["east"]
            inside = b["south"] <= c["lat"] <= b["north"] and in_lon
            m = 0 if inside else geo.ellipsoid_metres(np.full(lat.size, c["lat"]), np.full(lat.size, c["lon"]), lat, lon).min()
            if abs(m - c["radius_m"]) > 500:  # the sampled edge is at most so much farther
                assert ((b["box"], c["fact_id"]) in got) == (m < c["radius_m"]), (b, c, m)
            elif inside:
                assert (b["box"], c["fact_id"]) in got


def test_circle_beside_a_high_box(spark):
    """The nearest point of the edge lies farther north than the centre."""
    box = spark.createDataFrame([(1, 50.0, 80.0, 0.0, 20.0)], "box long, south double, north double, west double, east double")
    lat, lon = edge_points(50.0, 80.0, 0.0, 20.0)
    m = float(geo.ellipsoid_metres(np.full(lat.size, 60.0), np.full(lat.size, -40.0), lat, lon).min())
    rows = [(1, 60.0, -40.0, m + 1000), (2, 60.0, -40.0, m - 1000)]
    found = maps.circles_in_viewport(box, spark.createDataFrame(rows, "fact_id long, lat double, lon double, radius_m double")).collect()
    assert [tuple(r) for r in found] == [(1, 1)]


def test_bounds_follow_the_log(spark):
    ids = sorted(r[0] for r in T.facts(spark, DIR).select("fact_id").collect())
    bound = max(ids) * 7 // 10
    assert sorted(r[0] for r in QUERIES["src5_facts_at_share"](spark, DIR).select("fact_id").collect()) == [i for i in ids if i < bound]
    larger = "/root/testdata/sf0.01"
    top = T.facts(spark, larger).count()
    assert QUERIES["src5_facts_at_share"](spark, larger).count() > top // 2
    states = {r["state"]: r["count"] for r in QUERIES["flt8_lookup_share"](spark, larger).groupBy("state").count().collect()}
    assert set(states) == {"active", "retracted", "future", "unknown"} and states["active"] > states["future"]


def test_touched_by_all_starts_from_every_retraction(spark):
    got = {r[0] for r in QUERIES["gr4_touched_by_all"](spark, DIR).collect()}
    assert got >= {r[0] for r in T.facts(spark, DIR).where("kind = 'retract'").select("fact_id").collect()}


def test_near_dups_of_whole_contents(spark):
    """Texts that differ at their first sign only are pairs; texts with a common head only are not."""
    pick = random.Random(4)
    words = lambda n: [f"w{pick.randrange(10**6)}" for _ in range(n)]
    head, body = " ".join(words(20)), words(3000)
    rows = [(1, " ".join(body)), (2, "Other " + " ".join(body)), (3, f"{head} {' '.join(words(400))}"), (4, f"{head} {' '.join(words(400))}"), (5, None), (6, " \n"), (7, " ".join(body)), (8, "one")]
    hashes = capture.content_hashes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    by_id = {r["id"]: r["hash"] for r in hashes.collect()}
    assert set(by_id) == {1, 2, 3, 4, 7, 8} and by_id[1] == by_id[7] != by_id[2]
    bits = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True))
    assert bits(by_id[3], by_id[4]) > 6 >= bits(by_id[1], by_id[2])
    assert (1, 2) in {(r["a"], r["b"]) for r in capture.near_dups_wide(hashes, 6).collect()}
    base = [[pick.getrandbits(64) - 2**63 for _ in range(4)] for _ in range(10)]
    table = []
    for i in range(60):
        h = list(base[i % 10])
        for _ in range(pick.randrange(5)):
            k, n = pick.randrange(4), pick.randrange(63)
            h[k] ^= 1 << n
        table.append((i, h))
    got = {tuple(r) for r in capture.near_dups_wide(spark.createDataFrame(table, "id long, hash array<long>"), 3).collect()}
    least = {}
    for i, h in table:
        least.setdefault(tuple(h), i)
    ids = {i: h for h, i in least.items()}
    assert got == {(i, j, bits(ids[i], ids[j])) for i in ids for j in ids if i < j and bits(ids[i], ids[j]) <= 3} and got
