"""Operators that SQL can't express, or whose laws are stronger than one table shows, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import geo
from palimpsest.operators import capture, conflicts, identity, labels, listing, maps, records
from palimpsest.plans import QUERIES, job_queries
from palimpsest.sources import testbed as T

DIR = "/root/testdata/sf0.001"


def plain_order_ok(moments, place):
    """Whether an order keeps every rule: dates, then lifecycle unless dates speak against it."""
    stage = {"construction": 0, "other": 1, "demolition": 2}
    for a, b in itertools.permutations(moments, 2):
        dated = a["day"] is not None and b["day"] is not None
        if dated and a["day"] != b["day"]:
            first = a["day"] < b["day"]
        else:
            first = stage[a["stage"]] < stage[b["stage"]] or (a["event"] == b["event"] and (a["role"], b["role"]) == ("started", "completed"))
        if first and place[a["event"], a["role"]] > place[b["event"], b["role"]]:
            return False
    return True


def acyclic(moments):
    """Whether the rules can all be kept at once."""
    return any(plain_order_ok(moments, {(m["event"], m["role"]): k for k, m in enumerate(p)}) for p in itertools.permutations(moments))


def test_timeline_keeps_every_rule_that_can_be_kept(spark):
    pick, out = random.Random(4), []
    for rep in range(150):
        events = [(rep * 10 + k, pick.choice(["construction", "other", "demolition"])) for k in range(3)]
        for event, stage in events:
            start, end = sorted(pick.choices(range(6), k=2))
            out += [(rep, event, "started", stage, pick.choice([None, start])), (rep, event, "completed", stage, pick.choice([None, end]))]
    rows = spark.createDataFrame(out, "rep long, event long, role string, stage string, day int")
    got = {}
    for r in listing.timeline_order(rows).collect():
        got.setdefault(r["rep"], {})[r["event"], r["role"]] = r["place"]
    checked = 0
    for rep in range(150):
        moments = [dict(zip(("rep", "event", "role", "stage", "day"), x, strict=True)) for x in out if x[0] == rep]
        assert sorted(got[rep].values()) == list(range(6))
        if acyclic(moments):
            checked += 1
            assert plain_order_ok(moments, got[rep]), moments
    assert checked > 30


def test_timeline_of_a_hot_entity(spark):
    rows = spark.range(20_000).selectExpr("1L as rep", "id as event", "'started' as role", "'other' as stage", "cast(id % 977 as int) as day")
    got = listing.timeline_order(rows).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(20_000)) and all(a["day"] <= b["day"] for a, b in itertools.pairwise(got))


def test_caps_meet_like_a_dense_search():
    pick = random.Random(9)
    grid = [(lat, lon) for lat in np.linspace(-89, 89, 120) for lon in np.linspace(-180, 179, 240)]
    points = labels._unit(*np.array(grid).T)
    for _ in range(60):
        n = pick.randrange(1, 6)
        lat, lon, radius = [pick.uniform(-80, 80) for _ in range(n)], [pick.uniform(-180, 180) for _ in range(n)], [pick.uniform(1e6, 8e6) for _ in range(n)]
        gap = np.arccos(np.clip(points @ labels._unit(np.array(lat), np.array(lon)).T, -1, 1)) * labels._EARTH - np.array(radius)
        nearest = gap.max(axis=1).min()
        if nearest < 0 or nearest > 200_000:  # nearer than the grid is fine, it can't tell
            assert labels.caps_meet(lat, lon, radius) == (nearest < 0)
    n = 1000
    assert not labels.caps_meet([0] * n, np.linspace(-170, 170, n), [500_000.0] * n)


def test_minimal_fighting_sets(spark):
    pick, out = random.Random(7), []
    for rep in range(80):
        for k in range(pick.randrange(2, 7)):
            a = sorted(pick.sample(range(30), 4))
            date = [(a[0], a[1]), (a[2], a[3])] if pick.random() < 0.6 else [(pick.choice([None, a[0]]), pick.choice([None, a[3]]))]
            out.append((rep, rep * 10 + k, date))
    claims = spark.createDataFrame(out, "rep long, fact_id long, date array<struct<lo:int,hi:int>>")
    inf = math.inf
    days = lambda date: {d for d in range(-5, 40) if any((-inf if lo is None else lo) <= d <= (inf if hi is None else hi) for lo, hi in date)}
    by_rep = {}
    for rep, fact, date in out:
        by_rep.setdefault(rep, []).append((fact, days(date)))
    want, pairs = {}, {(rep, f, g) for rep, claimed in by_rep.items() for f, x in claimed for g, y in claimed if f < g and not x & y}
    for rep, claimed in by_rep.items():
        if not set.intersection(*(d for _, d in claimed)) and rep not in {p[0] for p in pairs}:
            keep = dict(claimed)
            for fact, _ in claimed:
                rest = {f: d for f, d in keep.items() if f != fact}
                if rest and not set.intersection(*rest.values()):
                    keep = rest
            want[rep] = sorted(keep)
    assert {r["rep"]: sorted(r["facts"]) for r in conflicts.minimal_fighting_set(claims, "rep").collect()} == want and all(len(x) > 2 for x in want.values()) and want
    blocks = conflicts.fighting_blocks(claims, "rep")
    apart = {tuple(r) for r in conflicts.block_pairs(blocks, claims, "rep").collect()}
    gaps = conflicts.gap_pairs(claims, "rep").collect()
    same = {}
    for rep, fact, date in out:
        same.setdefault((rep, str(date)), []).append(fact)
    copies = {(rep, min(facts)): facts for (rep, _), facts in same.items()}
    inside = {(r["rep"], min(f, g), max(f, g)) for r in gaps for f in copies[r["rep"], r["a"]] for g in copies[r["rep"], r["b"]]}
    assert not apart & inside and apart | inside == pairs and inside and len(inside) == sum(r["n"] for r in gaps)
    assert sum(r["n_before"] * r["n_after"] for r in blocks.collect()) == len(apart)
    brackets = {r["rep"]: r for r in records.interval_bracket(claims, "rep").collect()}
    for rep, claimed in by_rep.items():
        r, wide = brackets[rep], lambda spans: days([(s["lo"], s["hi"]) for s in spans])
        assert wide(r["consensus"]) == set.intersection(*(d for _, d in claimed)) and wide(r["extent"]) == set.union(*(d for _, d in claimed))
        assert r["conflict"] == (not set.intersection(*(d for _, d in claimed))) and r["support"] == len(claimed)


def test_near_dups_find_every_pair_and_keep_keys_wide(spark):
    pick = random.Random(3)
    base = [pick.getrandbits(64) - 2**63 for _ in range(8)]
    table = []
    for i in range(120):
        h = base[i % 8]
        for _ in range(pick.randrange(5)):
            h ^= 1 << pick.randrange(63)
        table.append((i, h))
    got = {tuple(r) for r in capture.near_dups(spark.createDataFrame(table, "id long, hash long"), 3).collect()}
    least = {}
    for i, h in table:
        least.setdefault(h, i)
    bits = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    assert got == {(i, j, bits(x, y)) for x, i in least.items() for y, j in least.items() if i < j and bits(x, y) <= 3} and got


def test_extract_pages(spark):
    html = """<html><head><title> An  old
house </title><meta name="author" content="A. Smith"><meta property="article:published_time" content="2020-01-02">
<style>p { color: red }</style></head><body><p>Built &amp; rebuilt</p><script>var x = "<p>no</p>";</script><p>twice</p>
<img src="/a.jpg"><img src="data:image/png;base64,AA"><img src="b.png" alt="x"></body></html>"""
    rows = [(1, "https://example.org/dir/page", html), (2, "https://example.org/", None), (3, None, "<p>open <b>tags"), (4, "https://example.org/", '<meta property="og:title" content="Only this">')]
    got = {r["page_id"]: r for r in capture.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert tuple(got[1])[1:] == ("An old house", "A. Smith", "2020-01-02", "Built & rebuilt twice", ["https://example.org/a.jpg", "https://example.org/dir/b.png"])
    assert tuple(got[2])[1:] == (None, None, None, "", []) and got[3]["text"] == "open tags" and got[4]["title"] == "Only this"


def plain_detections(masks, k):
    kept, taken, out = [], set(), []
    for _, mask, score, width, runs in sorted(masks, key=lambda m: (-m[2], m[1])):
        mine = {p for a, b in runs for p in range(a, b)}
        if not mine or any(len(mine & m) / len(mine | m) > 0.7 for m in kept):
            continue
        kept.append(mine)
        left = mine - taken
        if len(left) >= 0.1 * len(mine):
            taken |= mine
            out.append((mask, score, len(left), sum(p % width for p in left) / len(left)))
    best = sorted(out[:k], key=lambda x: (x[3], x[0]))
    return [(*x, i) for i, x in enumerate(best)]


def test_clean_detections(spark):
    pick, out = random.Random(12), []
    for image in range(30):
        for mask in range(pick.randrange(1, 9)):
            start, n = pick.randrange(300), pick.randrange(0, 12)
            out.append((image, mask, round(pick.random(), 2), 32, [(start + r * 32, start + r * 32 + n) for r in range(4)]))
    frame = spark.createDataFrame(out, "image long, mask long, score double, width int, runs array<struct<start:int,end:int>>")
    got = {}
    for r in capture.clean_detections(frame, 3).collect():
        got.setdefault(r["image"], []).append((r["mask"], r["score"], r["pixels"], r["column"], r["place"]))
    placed = capture.clean_detections(spark.createDataFrame([(1, 1, 0.9, 100, [(0, 2), (60, 90)]), (1, 2, 0.8, 100, [(10, 20)])], frame.schema), 5)
    assert {r["mask"]: r["place"] for r in placed.collect()} == {2: 0, 1: 1}
    for image in range(30):
        assert sorted(got.get(image, []), key=lambda x: x[4]) == plain_detections([m for m in out if m[0] == image], 3)


def test_circle_rectangles_hold_their_circle(spark):
    rows = QUERIES["sca9_circle_rectangles"](spark, DIR).collect()
    assert len(rows) > 100
    for r in rows:
        want = float(geo.ellipsoid_metres([r["lat"]], [r["lon"]], [r["lat2"]], [r["lon2"]])[0])
        h = math.sin(math.radians(r["lat2"] - r["lat"]) / 2) ** 2 + math.cos(math.radians(r["lat"])) * math.cos(math.radians(r["lat2"])) * math.sin(math.radians(r["lon2"] - r["lon"]) / 2) ** 2
        assert r["metres"] == pytest.approx(want) == pytest.approx(2 * 6371008.8 * math.asin(math.sqrt(h)), rel=0.006)
        inside = [x for x in r["rects"] if x["south"] - 1e-6 <= r["lat2"] <= x["north"] + 1e-6 and x["west"] - 1e-6 <= r["lon2"] <= x["east"] + 1e-6]
        assert inside, r


def test_glue_joins_the_members_of_a_value(spark):
    edges = [(1, 10, 11), (2, 11, 12), (3, 12, 13), (4, 10, 12), (5, 10, 10)]
    support = [("both ends", 10), ("both ends", 11), ("both ends", 11), ("one member", 12), ("a chain", 11), ("a chain", 12), ("a chain", 13), ("ends of a path", 11), ("ends of a path", 13), ("all", 10), ("all", 11), ("all", 12)]
    got = {}
    for r in labels.connecting_glue(spark.createDataFrame(support, "value string, member long"), spark.createDataFrame(edges, "edge_id long, a long, b long"), "value").collect():
        got.setdefault(r["value"], set()).add(r["edge_id"])
    assert got == {"both ends": {1}, "a chain": {2, 3}, "all": {1, 2, 4}}


def plain_minimal(envs):
    return {e for e in envs if not any(o < e for o in envs)}


def test_labels_obey_the_laws_of_a_semiring(spark):
    pick, rows = random.Random(3), {}
    for side in "abc":
        for key in range(40):
            rows[side, key] = {frozenset(pick.sample("uvwxyz", pick.choice([0, 1, 1, 2, 2, 3]) if pick.random() < 0.9 else 4)) for _ in range(pick.randrange(0, 5))}
    frame = {s: spark.createDataFrame([(k, sorted(e)) for (x, k), envs in rows.items() if x == s for e in envs], "k long, env array<string>") for s in "abc"}

    def read(df):
        out = {}
        for r in df.collect():
            assert frozenset(r["env"]) not in out.setdefault(r["k"], set())
            out[r["k"]].add(frozenset(r["env"]))
        return out

    want = {k: plain_minimal({x | y for x in rows["a", k] for y in rows["b", k]}) for k in range(40)}
    product = labels.times(frame["a"], frame["b"], "k")
    assert read(product) == {k: v for k, v in want.items() if v} == read(labels.times(frame["b"], frame["a"], "k"))
    assert read(labels.plus(frame["a"], frame["b"], "k")) == {k: m for k in range(40) if (m := plain_minimal(rows["a", k] | rows["b", k]))}
    spread = labels.plus(labels.times(frame["a"], frame["c"], "k"), labels.times(frame["b"], frame["c"], "k"), "k")
    assert read(labels.times(labels.plus(frame["a"], frame["b"], "k"), frame["c"], "k")) == read(spread)
    assert all("stamp" in e for envs in read(labels.stamped(frame["a"], "stamp")).values() for e in envs)
    summed = {r["k"]: {frozenset(e) for e in r["label"]} for r in labels.label_sum(frame["a"].selectExpr("k", "array(env, env) as label"), "k", "label").collect()}
    assert summed == {k: m for k in range(40) if (m := plain_minimal(rows["a", k]))}



def test_upkeep_of_touched_classes_equals_the_whole(spark):
    pick = random.Random(8)
    edges, log = set(), spark.createDataFrame([], "member long, as_of long, rep long")
    everyone = spark.range(40).withColumnRenamed("id", "member")
    for step in range(1, 6):
        added = {tuple(sorted(pick.sample(range(40), 2), reverse=True)) for _ in range(6)}
        gone = set(pick.sample(sorted(edges), min(len(edges), 3)))
        edges = (edges | added) - gone
        now = spark.createDataFrame(sorted(edges), "a long, b long")
        ends = spark.createDataFrame([(x,) for e in added | gone for x in e], "member long")
        rows = identity.update_touched(log, now, ends, step).collect()
        log = spark.createDataFrame([*log.collect(), *rows], log.schema)
        whole = {r["member"]: r["rep"] for r in identity.representatives(everyone, now).collect()}
        assert {r["member"]: r["rep"] for r in identity.resolve_reps(everyone, log, step + 1).collect()} == whole


def test_boxes_across_the_antimeridian(spark):
    box = spark.createDataFrame([(1, -10.0, 10.0, 170.0, -170.0)], "box long, south double, north double, west double, east double")
    places = spark.createDataFrame([(1, 5, 0.0, 175.0), (2, 5, 0.0, -175.0), (3, 6, 0.0, 160.0), (4, 7, 0.0, 180.0), (5, 8, 0.0, -169.0)], "fact_id long, rep long, lat double, lon double")
    seen = spark.createDataFrame([(5,), (6,), (8,)], "rep long")
    assert [tuple(r) for r in maps.in_viewport_and_time(box, places, seen).collect()] == [(1, 5)]


def test_an_entity_that_moved_out_takes_no_slot(spark):
    box = spark.createDataFrame([(1, -10.0, 10.0, -10.0, 10.0)], "box long, south double, north double, west double, east double")
    sites = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 2, 1.0, 1.0), (3, 3, 50.0, 50.0), (4, 4, 2.0, 2.0)], "entity long, fact_id long, lat double, lon double")
    moves = spark.createDataFrame([(1, 9, 40.0, 40.0, 5), (3, 8, 3.0, 3.0, None)], "entity long, fact_id long, lat double, lon double, landed int")
    none = "entity long, earliest int, affirmed int, reached int, floor int, denies_after int, claimed_through int, unbounded boolean, claimed boolean"
    got = listing.list_entities(box, sites, moves, spark.createDataFrame([(2, 1, 9, 9, None, None, None, False, False)], none), spark.createDataFrame([], "entity long, lo int, hi int"), spark.createDataFrame([(2, "b"), (2, "a")], "entity long, name string"), spark.createDataFrame([(3, 7, False), (3, 8, True)], "entity long, image long, exterior boolean"), 5, 2).collect()
    assert sorted((r["entity"], r["verdict"], tuple(r["names"]), r["thumbnail"]) for r in got) == [(2, "uncontested", ("a", "b"), None), (3, "unknown", (), 8)]


def test_a_replayed_url_batch_changes_nothing(spark):
    got = [r["url"] for r in job_queries.str5_seen_urls(spark, DIR).collect()]
    assert len(got) == len(set(got)) == T.table(spark, DIR, "events").select("user_id").distinct().count()


def test_clean_detections_in_any_batches(spark):
    """Images go in batches of rows, not as groups of their own, and a batch may end inside an image."""
    pick, rows = random.Random(21), []
    for image in range(40):
        for mask in range(pick.randrange(1, 12)):
            start, n = pick.randrange(3000), pick.randrange(0, 40)
            rows.append((image, mask, round(pick.random(), 1), 64, [(start + r * 64, start + r * 64 + n) for r in range(pick.randrange(0, 4))]))
    frame = spark.createDataFrame(rows, "image long, mask long, score double, width int, runs array<struct<start:int,end:int>>").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        out = capture.clean_detections(frame, 4)
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
        got = {}
        for r in out.collect():
            got.setdefault(r["image"], []).append((r["mask"], r["score"], r["pixels"], r["column"], r["place"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for image in range(40):
        assert sorted(got.get(image, []), key=lambda x: x[4]) == plain_detections([m for m in rows if m[0] == image], 4)


def test_matching_of_a_popular_name_is_linear(spark):
    """Declarations of one name don't each meet all facts of it; several references of one declaration count together."""
    decls = spark.range(3000).select(F.col("id").alias("decl"), F.lit("a").alias("name_norm"), F.lit("en").alias("lang"))
    known = spark.range(3000).select(F.col("id").alias("entity"), F.lit("a").alias("name_norm"), F.lit("en").alias("lang"), F.col("id").alias("fact_id"))
    refs = spark.createDataFrame([(0, 7), (0, 8), (1, 7), (2, -1), (3, None)], "decl long, ref long")
    cited = spark.createDataFrame([(5, 7, 70), (6, 8, 80), (5, 7, 71)], "entity long, ref long, fact_id long")
    reps = spark.createDataFrame([(6, 5)], "member long, rep long")
    got = {r["decl"]: tuple(r)[1:] for r in identity.match_entities(decls, refs, known, cited, reps).collect()}
    assert got == {0: (1, 5, "matched"), 1: (1, 5, "matched"), 2: (0, None, "new"), 3: (0, None, "new"), **{k: (2999, None, "ambiguous") for k in range(4, 3000)}}
    assert sorted(map(tuple, identity.match_basis(decls, refs, known, cited, reps).collect())) == [(0, 5, 70), (0, 5, 71), (0, 5, 80), (1, 5, 70), (1, 5, 71)]
    sets, facts = identity._anchored(decls, refs, known, cited, reps)
    assert identity._candidates(sets, facts).count() == 3
