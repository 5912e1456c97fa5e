"""Location trees against plain recursion: emptiness, verdicts, viewports, and geodesics on the ellipsoid."""

import random

import numpy as np
import pytest

from palimpsest.functions import geo
from palimpsest.operators import maps, places

BOXES = "box long, south double, north double, west double, east double"


def random_tree(pick, depth=0):
    """(kind, circle or members) of a tree about one region, so that some meets are empty and some are not."""
    kind = pick.choice(["circle"] * 4 + ["one_of", "all_of"] * (2 if depth < 2 else 0) + ["empty", "unbounded", "reference"])
    if kind in ("one_of", "all_of") or depth == 0 and kind != "circle" and pick.random() < 0.7:
        return pick.choice(["one_of", "all_of"]), [random_tree(pick, depth + 1) for _ in range(pick.randrange(2, 5))]
    if kind == "circle":
        return kind, (pick.uniform(40, 52), pick.uniform(-6, 8), pick.choice([0.0, 50e3, 200e3, 400e3, 700e3]))
    return kind, None


def rows_of(location, tree, path=()):
    kind, inner = tree
    here = (location, list(path), kind, *(inner if kind == "circle" else (None, None, None)))
    return [here] + [r for k, m in enumerate(inner if kind in ("one_of", "all_of") else ()) for r in rows_of(location, m, (*path, k))]


def plain_covered(tree, lat, lon, spare=0.0):
    kind, inner = tree
    if kind == "circle":
        return geo.ellipsoid_metres(lat, lon, inner[0], inner[1]) <= inner[2] + 0.01 - spare
    if kind in ("one_of", "all_of"):
        found = np.array([plain_covered(m, lat, lon, spare) for m in inner])
        return found.any(axis=0) if kind == "one_of" else found.all(axis=0)
    return np.full(len(lat), kind != "empty")


def circles_of(tree):
    kind, inner = tree
    return [inner] if kind == "circle" else [c for m in inner for c in circles_of(m)] if kind in ("one_of", "all_of") else []


def has(tree, kind):
    return tree[0] == kind or tree[0] in ("one_of", "all_of") and any(has(m, kind) for m in tree[1])


def tree_of(rows):
    return places.Tree([tuple(r[1]) for r in rows], [r[2] for r in rows], *([np.nan if r[k] is None else r[k] for r in rows] for k in (3, 4, 5)))


@pytest.fixture(scope="module")
def trees():
    pick = random.Random(4)
    return [random_tree(pick) for _ in range(400)]


def test_emptiness_is_that_of_a_dense_search(trees):
    """Grid points and centres that lie inside by some metres prove a region; a tree called empty has none, and one called not has a witness."""
    y, x = (v.ravel() for v in np.meshgrid(np.linspace(33, 59, 90), np.linspace(-16, 18, 90)))
    seen = set()
    for tree in trees:
        own = tree_of(rows_of(0, tree))
        empty = own.empty()
        lat, lon = np.append(y, [c[0] for c in circles_of(tree)]), np.append(x, [c[1] for c in circles_of(tree)])
        assert not (empty and plain_covered(tree, lat, lon, 0.02).any())
        if tree[0] == "all_of" and not empty:
            at = own.witness(())
            assert plain_covered(tree, np.array([at[0]]), np.array([at[1]]))[0]
        seen.add((tree[0], empty))
    assert {("all_of", True), ("all_of", False), ("one_of", False)} <= seen


def test_rims_that_touch_and_three_circles():
    gap = float(geo.ellipsoid_metres(48.0, 2.0, 50.0, 3.0))
    touch = lambda r: ("all_of", [("circle", (48.0, 2.0, r)), ("circle", (50.0, 3.0, gap - r))])
    for r in (0.0, 10_000.0, gap / 2, gap):
        assert not tree_of(rows_of(0, touch(r))).empty()
    apart = ("all_of", [("circle", (48.0, 2.0, gap / 2)), ("circle", (50.0, 3.0, gap / 2 - 1.0))])
    assert tree_of(rows_of(0, apart)).empty()
    # Each two of three circles meet, the three only if they are wide enough: a crossing tells it.
    corners = [(48.0, 2.0), (50.0, 2.0), (49.0, 4.0)]
    for r, want in ((112.5e3, True), (120e3, False)):
        assert all(not tree_of(rows_of(0, ("all_of", [("circle", (*a, r)), ("circle", (*b, r))]))).empty() for a in corners for b in corners if a != b)
        assert tree_of(rows_of(0, ("all_of", [("circle", (*c, r)) for c in corners]))).empty() == want


def test_geodesics():
    pick = np.random.default_rng(2)
    lat, lon, way, far = pick.uniform(-85, 85, 500), pick.uniform(-180, 180, 500), pick.uniform(-np.pi, np.pi, 500), pick.uniform(1, 5e6, 500)
    y, x = geo.ellipsoid_direct(lat, lon, way, far)
    metres, azimuth = geo.ellipsoid_inverse(lat, lon, y, x)
    assert np.abs(metres - far).max() < 1e-3 and np.abs(np.angle(np.exp(1j * (azimuth - way)))).max() < 1e-4
    # Berlin to Paris, by a published solution.
    assert abs(float(geo.ellipsoid_metres(52.5200, 13.4050, 48.8566, 2.3522)) - 879_700) < 500


def test_verdicts(spark, trees):
    nodes = spark.createDataFrame([r for k, t in enumerate(trees) for r in rows_of(k, t)], places.NODES).repartition(5)
    got = {r["location"]: (r["n_circles"], r["verdict"]) for r in places.verdicts(nodes).collect()}
    for k, tree in enumerate(trees):
        empty = tree_of(rows_of(k, tree)).empty()
        assert got[k] == (len(circles_of(tree)), "conflict" if empty else "pending" if has(tree, "reference") else "consistent"), tree
    assert {v for _, v in got.values()} == set(places.VERDICTS)
    assert places.verdicts(nodes.limit(0)).collect() == []


def test_many_circles_are_pending_or_too_complex(spark):
    many = [(1, [], "all_of", None, None, None)] + [(1, [k], "circle", 10.0, float(k % 50), 1000.0) for k in range(1001)]
    some = [(2, [], "one_of", None, None, None)] + [(2, [k], "circle", 10.0, float(k % 50), 1000.0) for k in range(101)]
    nodes = spark.createDataFrame(many + some + [(3, [], "empty", None, None, None), (4, [], "reference", None, None, None)], places.NODES)
    assert {r["location"]: r["verdict"] for r in places.verdicts(nodes).collect()} == {1: "pending", 2: "consistent", 3: "conflict", 4: "pending"}
    assert {r["location"]: r["fault"] for r in places.faults(nodes).collect()} == {1: "too_complex", 2: "too_complex", 3: "empty"}


def test_bracket_is_all_sources_at_once(spark, trees):
    nodes = spark.createDataFrame([r for k, t in enumerate(trees[:120]) for r in rows_of(k, t)], places.NODES).selectExpr("*", "location div 3 as site")
    got = {r["site"]: r["verdict"] for r in places.bracket(nodes, "site").collect()}
    for site in range(40):
        tree = ("all_of", trees[3 * site : 3 * site + 3])
        empty = tree_of(rows_of(0, tree)).empty()
        assert got[site] == ("conflict" if empty else "pending" if has(tree, "reference") else "consistent")


def plain_evidence(tree, met):
    kind, inner = tree
    if kind == "circle":
        return inner in met
    if kind not in ("one_of", "all_of"):
        return False if kind == "empty" else None
    found = [plain_evidence(m, met) for m in inner]
    if kind == "one_of":
        return True if True in found else None if None in found else False
    return False if False in found else True if True in found else None


def test_viewports(spark, trees):
    boxes = [(1, 45.0, 47.0, -2.0, 2.0), (2, 50.0, 51.0, 4.0, 9.0), (3, -10.0, 0.0, 170.0, -170.0), (4, 40.0, 60.0, -10.0, 20.0)]
    frame = spark.createDataFrame(boxes, BOXES)
    nodes = spark.createDataFrame([r for k, t in enumerate(trees) for r in rows_of(k, t)], places.NODES)
    circles = sorted({c for t in trees for c in circles_of(t)})
    flat = spark.createDataFrame([(k, *c) for k, c in enumerate(circles)], "fact_id long, lat double, lon double, radius_m double")
    met = {}
    for r in maps.circles_in_viewport(frame, flat).collect():
        met.setdefault(r["box"], set()).add(circles[r["fact_id"]])
    want = {(b, k) for b, *_ in boxes for k, t in enumerate(trees) if plain_evidence(t, met.get(b, set()))}
    assert {(r["box"], r["location"]) for r in places.in_viewport(frame, nodes).collect()} == want and want


def test_unresolved_hides_nothing_and_matches_nothing(spark):
    here, there = ("circle", (46.0, 0.0, 1000.0)), ("circle", (10.0, 0.0, 1000.0))
    ref, top, none = ("reference", None), ("unbounded", None), ("empty", None)
    trees = [ref, top, none, ("one_of", [ref, here]), ("all_of", [ref, here]), ("all_of", [ref, top]), ("all_of", [here, there]), ("one_of", [there, none]), ("all_of", [("one_of", [there, ref]), here]), ("all_of", [here, none])]
    nodes = spark.createDataFrame([r for k, t in enumerate(trees) for r in rows_of(k, t)], places.NODES)
    got = {r["location"] for r in places.in_viewport(spark.createDataFrame([(1, 45.0, 47.0, -2.0, 2.0)], BOXES), nodes).collect()}
    assert got == {3, 4, 8}
