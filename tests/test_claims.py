"""Scenarios of the claim log as exact small tables, and laws on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import dates, geo, text
from palimpsest.operators import conflicts, existence, folds, identity, labels, listing, maps, snapshot, validate
from palimpsest.operators.components import components

FACTS = "fact_id long, commit_seq long, retracts_fact_id long, retracts_commit_seq long"
BAG = "rep long, fact_id long, kind string, lo int, hi int"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def retractors(spark, facts):
    return dict(rows(snapshot.effective_retractors(snapshot.retraction_edges(spark.createDataFrame(facts, FACTS))), "target", "retractor"))


def test_retraction_of_a_retraction_restores(spark):
    assert retractors(spark, [(1, 0, None, None), (2, 1, 1, None), (3, 2, 2, None)]) == {2: 3}


def test_lowest_effective_retractor_is_reported(spark):
    assert retractors(spark, [(1, 0, None, None), (2, 1, 1, None), (3, 2, 1, None), (4, 3, 2, None)]) == {1: 3, 2: 4}


def test_retracted_commit_hides_each_fact(spark):
    assert retractors(spark, [(1, 0, None, None), (2, 0, None, None), (3, 1, None, 0)]) == {1: 3, 2: 3}


def test_random_retractions(spark):
    pick = random.Random(4)
    facts = [(i, i // 3, pick.randrange(i) if i and pick.random() < 0.5 else None, None) for i in range(120)]
    want: dict[int, int] = {}
    for i in range(119, -1, -1):  # a retractor is decided before its targets
        live = [r for r, _, t, _ in facts if t == i and r not in want]
        if live:
            want[i] = min(live)
    assert retractors(spark, facts) == want


def test_split_and_merge_of_classes(spark):
    log = spark.createDataFrame([(2, 5, 1), (3, 5, 1), (3, 9, 3)], "member long, as_of long, rep long")
    members = spark.createDataFrame([(1,), (2,), (3,)], "member long")
    assert rows(identity.resolve_reps(members, log, 6), "member", "rep") == [(1, 1), (2, 1), (3, 1)]
    assert rows(identity.resolve_reps(members, log, 10), "member", "rep") == [(1, 1), (2, 1), (3, 3)]
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert rows(identity.update_reps(log, members, edges, 12), "member", "as_of", "rep") == [(3, 12, 1)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(8, 60)] + [(3, 3), (None, 4), (101, 100)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(7, 60), 7)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_references_outrank_a_shared_name(spark):
    s = spark.createDataFrame
    decls, refs = s([(1, "a", "en"), (2, "a", "en"), (3, "z", "en")], "decl long, name_norm string, lang string"), s([(1, "r9")], "decl long, ref string")
    got = identity.match_entities(decls, refs, s([(10, "a", "en"), (11, "a", "en")], "entity long, name_norm string, lang string"), s([(12, "r9")], "entity long, ref string"), s([(11, 10)], "member long, rep long"))
    assert rows(got, "decl", "rep", "outcome") == [(1, 12, "matched"), (2, 10, "matched"), (3, None, "new")]


def test_verdicts(spark):
    bag = [(1, 1, "construction_started", 10, 12), (1, 2, "existence", 20, 30), (2, 3, "existence", 5, 9), (2, 4, "demolition_completed", 20, 22), (3, 5, "existence", 30, 40), (3, 6, "demolition_completed", 20, 25)]
    spans = existence.lifespan(spark.createDataFrame(bag, BAG))
    at = lambda day: dict(rows(spans.select("rep", existence.verdict(day).alias("v")), "rep", "v"))
    assert at(5) == {1: "absent", 2: "uncontested", 3: "unknown"}
    assert at(25) == {1: "uncontested", 2: "absent", 3: "uncontested"}
    assert at(35) == {1: "presumed", 2: "absent", 3: "contested"}


def test_lifespan_is_the_same_under_any_grouping(spark):
    pick = random.Random(9)
    bag = [(pick.randrange(5), i, pick.choice(["existence", "construction_started", "demolition_completed", "event"]), pick.choice([None, i % 30]), pick.choice([None, 30 + i % 20])) for i in range(300)]
    df = spark.createDataFrame(bag, BAG)
    assert rows(existence.lifespan(df.repartition(7)), "rep", "earliest", "affirmed", "reached") == rows(existence.lifespan(df.coalesce(1)), "rep", "earliest", "affirmed", "reached")


def test_conflicts(spark):
    bag = [(1, 1, "construction_started", 50, 55), (1, 2, "existence", 10, 20), (1, 3, "existence", 10, 20), (1, 4, "event", 12, 13), (1, 5, "existence", 60, 61)]
    got = conflicts.temporal_conflicts(spark.createDataFrame(bag, BAG))
    assert rows(got, "bound", "witnesses", "bookends", "witness") == [("floor", [2, 3], [1], 2), ("floor", [4], [1], 4)]
    got = conflicts.built_by(spark.createDataFrame([(1, 1, "existence", None, 9), (1, 2, "event", 3, 9), (2, 3, "construction_started", 1, 2)], BAG))
    assert rows(got, "rep", "built_by", "evidence") == [(1, 9, [1, 2])]


def test_fighting_pairs(spark):
    pick = random.Random(1)
    bag = [(1, i, "construction_started", a := pick.choice([None, pick.randrange(30)]), pick.choice([None, (a or 0) + pick.randrange(9)])) for i in range(40)]
    want = sorted((min(x[1], y[1]), max(x[1], y[1])) for x in bag for y in bag if x[4] is not None and y[3] is not None and x[4] < y[3])
    assert rows(conflicts.fighting_pairs(spark.createDataFrame(bag, BAG), "construction_started"), "a", "b") == sorted(want, key=str)


def test_dates(spark):
    import datetime

    pick = random.Random(2)
    days = [(datetime.date.fromordinal(pick.randrange(1, 3_000_000)).toordinal(), p) for p in range(6) for _ in range(60)]
    got = spark.createDataFrame(days, "d long, p int").select("d", "p", dates.snap_date(F.col("d"), F.col("p")).alias("s"), dates.period_end(F.col("d"), F.col("p")).alias("e"), dates.civil(F.col("d")).alias("c")).collect()
    for r in got:
        t = datetime.date.fromordinal(r["d"])
        assert tuple(r["c"]) == (t.year, t.month, t.day)
        first = {0: t.year, 1: t.year, 2: t.year, 3: t.year // 10 * 10, 4: (t.year - 1) // 100 * 100 + 1, 5: (t.year - 1) // 1000 * 1000 + 1}[r["p"]]
        if first >= 1:
            assert r["s"] == datetime.date(first, t.month if r["p"] < 2 else 1, t.day if r["p"] < 1 else 1).toordinal()
        assert r["s"] <= r["d"] <= r["e"]
    parse = lambda s, p: spark.range(1).select(dates.parse_item_time(F.lit(s), F.lit(p)).alias("x")).first()["x"]
    assert parse("+1889-03-31T00:00:00Z", 11)["day"] == datetime.date(1889, 3, 31).toordinal()
    assert parse("+0000-01-01T00:00:00Z", 9) is None and parse("+1889-02-30T00:00:00Z", 11) is None and parse("-0044-03-15T00:00:00Z", 11)["day"] < 0


def test_interval_algebra(spark):
    pick = random.Random(6)

    def some():
        return [(a, a + pick.randrange(6)) for a in (pick.randrange(40) for _ in range(pick.randrange(4)))]

    data = [(k, some(), some()) for k in range(60)]
    kind = "array<struct<lo:bigint,hi:bigint>>"
    cover = lambda spans: {d for s in spans for d in range(s[0], s[1] + 1)}
    for r in spark.createDataFrame(data, f"k long, a {kind}, b {kind}").select("a", "b", dates.date_meet(F.col("a"), F.col("b")).alias("m"), dates.date_join(F.col("a"), F.col("b")).alias("j")).collect():
        assert cover(r["m"]) == cover(r["a"]) & cover(r["b"]) and cover(r["j"]) == cover(r["a"]) | cover(r["b"])
        assert all(p["hi"] + 1 < q["lo"] for p, q in zip(r["j"], r["j"][1:], strict=False))


def test_geodesics_and_tiles(spark):
    assert abs(float(geo.ellipsoid_metres(0.0, 0.0, 0.0, 1.0)) - 111319.4908) < 0.01
    assert abs(float(geo.ellipsoid_metres(0.0, 10.0, 90.0, 10.0)) - 10001965.729) < 0.01
    assert float(geo.ellipsoid_metres(5.0, 5.0, 5.0, 5.0)) == 0 and float(geo.ellipsoid_metres(0.0, 0.0, 0.5, 179.7)) > 1.99e7
    boxes = spark.createDataFrame([(1, -10.0, 10.0, 170.0, -170.0)], "box long, south double, north double, west double, east double")
    spots = spark.createDataFrame([(1, 0.0, 175.0), (2, 0.0, -175.0), (3, 0.0, 0.0), (4, 10.0, 180.0)], "fact_id long, lat double, lon double").withColumn("quadkey", geo.quadkey(F.col("lat"), F.col("lon")))
    assert rows(maps.viewport_join(boxes, spots), "fact_id") == [(1,), (2,), (4,)]
    rings = spots.withColumn("radius_m", F.when(F.col("fact_id") == 3, 20_000_000.0 * 0.99).otherwise(1.0))
    assert rows(maps.circles_in_viewport(boxes, rings), "fact_id") == [(1,), (2,), (3,), (4,)]
    with pytest.raises(Exception, match="more than 2 tiles"):
        geo.viewport_tiles(boxes, 6, 2).collect()


def test_dense_corner_does_not_starve_other_tiles(spark):
    spots = spark.createDataFrame([(i, 0) for i in range(50)] + [(100, 1 << 40)], "fact_id long, quadkey long")
    top = maps.tile_top_n(spots, 5)
    assert top.count() == 33 and top.where("fact_id = 100").count() == 1
    cells = maps.cluster_cells(top.withColumn("rep", F.col("fact_id") % 2))
    assert rows(cells, "rep", "kind", "members") == [(0, "co_located", [0, 1]), (0, "singleton", None)]




def test_label_semiring(spark):
    pick = random.Random(8)
    some = lambda: [pick.sample("abcd", pick.randrange(1, 4)) for _ in range(pick.randrange(1, 4))]
    df = spark.createDataFrame([(some(), some(), some()) for _ in range(40)], "a array<array<string>>, b array<array<string>>, c array<array<string>>")
    a, b, c = (F.col(x) for x in "abc")
    same = [labels.label_plus(a, b) == labels.label_plus(b, a), labels.label_plus(a, a) == labels.minimal(a), labels.label_times(a, labels.label_plus(b, c)) == labels.label_plus(labels.label_times(a, b), labels.label_times(a, c))]
    assert all(all(r) for r in df.select(*same).collect())


def test_location_brackets(spark):
    circles = [(1, 0.0, 0.0, 100_000.0), (1, 0.0, 1.0, 100_000.0), (2, 0.0, 0.0, 10_000.0), (2, 0.0, 1.0, 10_000.0), (3, 0.0, 0.0, 70_000.0), (3, 0.0, 1.0, 70_000.0), (3, 0.9, 0.5, 70_000.0)]
    assert rows(labels.location_bracket(spark.createDataFrame(circles, "rep long, lat double, lon double, radius_m double"), "rep"), "rep", "verdict") == [(1, "consistent"), (2, "conflict"), (3, "consistent")]


def test_rebuild_and_intervals(spark):
    c = spark.createDataFrame([(1, 1, "construction"), (1, 5, "demolition"), (1, 5, "construction"), (1, 9, "construction"), (1, 10, "other")], "entity long, at int, kind string")
    assert [r["part"] for r in listing.split_on_rebuild(c).orderBy("at", "kind").collect()] == [0, 0, 0, 1, 1]
    s = spark.createDataFrame([(1, 1, 3), (1, 4, 6), (1, 9, 9), (1, 2, 2)], "k long, lo int, hi int")
    assert rows(folds.coalesce_intervals(s, "k"), "lo", "hi") == [(1, 6), (9, 9)]


def test_timeline_order(spark):
    moments = [(1, 1, "started", "construction", None), (1, 2, "started", "other", 5.0), (1, 3, "started", "demolition", 9.0), (1, 1, "completed", "construction", 7.0)]
    got = listing.timeline_order(spark.createDataFrame(moments, "rep long, event long, role string, stage string, day double"))
    assert [(r["event"], r["role"]) for r in got.orderBy("place").collect()] == [(1, "started"), (2, "started"), (1, "completed"), (3, "started")]


def test_texts(spark):
    urls = ["HTTPS://WWW.YouTube.com:443/watch/?v=1&si=x&utm_id=2#t", "http://a.org", "ftp://a.org/", "https://x.com/u/?b=2&a=1"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(text.normalize_url(F.col("u"))).collect()]
    assert got == ["https://youtube.com/watch?v=1", "http://a.org/", None, "https://twitter.com/u?b=2&a=1"]
    refs = ["https://www.wikidata.org/wiki/Q42", "https://wikidata.org/wiki/P31", "https://fr.wikipedia.org/wiki/Mont_Blanc%C3%A9", "https://www.wikipedia.org/wiki/X", "https://openstreetmap.org/area/5"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(u,) for u in refs], "u string").select(text.reference_from_url(F.col("u"))).collect()]
    assert got == [("wikidata", "Q42"), ("url", refs[1]), ("wikipedia", "fr:Mont Blancé"), ("url", refs[3]), ("url", refs[4])]
    good = spark.createDataFrame([("0-306-40615-2",), ("978-0-306-40615-7",), ("0306406153",), ("080442957X",)], "s string").select(text.isbn_ok(F.col("s"))).collect()
    assert [r[0] for r in good] == [True, True, False, True]
    when = spark.createDataFrame([("Tue, 05 Mar 2024 10:00:00 +0200",), ("2024-03-05T08:00:00Z",), ("5 March",)], "s string").select(text.parse_published(F.col("s")).cast("string")).collect()
    assert [r[0] for r in when] == ["2024-03-05 08:00:00", "2024-03-05 08:00:00", None]


def test_validation_rejects_whole_bundles(spark):
    b = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "bundle long, fact long")
    ok, report = validate.validate(b, {"first": b.where("fact = 2"), "second": b.where("fact > 9")})
    assert rows(ok, "fact") == [(3,)] and rows(report, "bundle", "rule_no", "rule") == [(1, 0, "first")]


def test_plans_push_filters_and_prune_columns(spark):
    d = "/root/testdata/sf0.001"
    df = snapshot.facts_at(spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_id", "fact_id"), 50).select("fact_id", "event_type")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(event_id,50)" in plan and "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


FULL_BAG = "rep long, fact_id long, kind string, lo int, hi int, event long, precision int"


def test_finished_constructions_and_begun_demolitions_bear_no_witness(spark):
    from palimpsest.operators import conflicts

    rows = [(1, 1, "construction_started", 100, 110, None, 11), (1, 2, "construction_completed", 80, 90, None, 11), (1, 3, "demolition_started", 40, 50, None, 11)]
    assert conflicts.temporal_conflicts(spark.createDataFrame(rows, FULL_BAG)).collect() == []
    assert conflicts.built_by(spark.createDataFrame([(1, 3, "demolition_started", 40, 60, None, 11)], FULL_BAG)).collect() == []
    rows = [(1, 1, "construction_completed", 10, 90, None, 11), (1, 2, "demolition_completed", 20, 60, None, 11), (1, 3, "demolition_started", 55, 70, None, 11), (1, 4, "existence", 30, 40, None, 11)]
    got = {r["fact_id"]: (r["new_lo"], r["new_hi"], r["rules"]) for r in conflicts.narrow(spark.createDataFrame(rows, FULL_BAG)).collect()}
    assert got == {1: (10, 60, ["construction_before_demolition"]), 2: (30, 60, ["witness_before_demolition"]), 3: (55, 70, []), 4: (30, 40, [])}


def test_endpoints_of_an_event_are_one_conflict(spark):
    from palimpsest.operators import conflicts

    rows = [(1, 1, "construction_started", 100, 110, None, 9)] + [(1, k, "event", k, k, e, 9 + k % 3) for k, e in ((10, 5), (20, 5), (30, None), (40, None), (50, 6))]
    got = {(tuple(r["witnesses"]), r["witness"]) for r in conflicts.temporal_conflicts(spark.createDataFrame(rows, FULL_BAG)).collect()}
    assert got == {((10, 20), 20), ((30,), 30), ((40,), 40), ((50,), 50)}
    ties = [(2, k, "existence", 1, 7, None, p) for k, p in ((4, 9), (5, 11), (6, 10))] + [(2, 7, "event", 1, 8, 3, 11)]
    assert [tuple(r) for r in conflicts.built_by(spark.createDataFrame(ties, FULL_BAG)).collect()] == [(2, 7, 11, [4, 5, 6])]
