"""Locations as trees: circles, "one of these" and "all of these", with members that are empty, unbounded or not resolved yet.

A tree is a set of rows: location, path (the members' numbers from the root down; the root's is empty), kind, and for a
circle lat, lon and radius_m.  Trees are folded from their deepest level up, one grouping for each level over all trees.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import geo
from palimpsest.operators import maps

NODES = "location long, path array<long>, kind string, lat double, lon double, radius_m double"
#: Circles of one submitted location, and of a merged one beyond which the verdict is pending.
MAX_CIRCLES, MAX_MERGED = 100, 1000
#: Part of the radius, and further metres, by which a circle's rim is wider than told, as distances are rounded.
SLACK, LEAST_SLACK = 1e-9, 1e-3
#: Of the verdicts, from good to bad.
VERDICTS = ("consistent", "pending", "conflict")


def folded(nodes: DataFrame, keys: list[str], one_of: Column, all_of: Column) -> DataFrame:
    """keys, value: what the root of each tree comes to.

    ``nodes`` has the keys, path, kind and ``value`` (int, null: nothing known) of leaves.  ``one_of`` and ``all_of`` tell a
    compound's value from the columns least, most (of the members' known values), known and members (counts).
    """
    deepest = nodes.agg(F.max(F.size("path"))).first()[0] or 0
    below = None
    for depth in range(deepest, -1, -1):
        here = nodes.where(F.size("path") == depth).select(*keys, "path", "kind", "value")
        if below is not None:
            met = here.join(below, [*keys, "path"], "left")
            here = met.withColumn("value", F.when(F.col("kind") == "one_of", one_of).when(F.col("kind") == "all_of", all_of).otherwise(F.col("value")))
        if not depth:
            return here.select(*keys, "value")
        above = F.slice("path", 1, depth - 1) if depth > 1 else F.array().cast("array<long>")
        below = here.groupBy(*keys, above.alias("path")).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("known"), F.count(F.lit(1)).alias("members"))
    return nodes.select(*keys, "value")


def in_viewport(boxes: DataFrame, nodes: DataFrame, level: int = 4) -> DataFrame:
    """box, location: trees whose known geometry meets a box.

    A circle meets it with its rim, nothing empty does, and unbounded or unresolved members say nothing: they add
    nothing to "one of" and take nothing from "all of", which holds when a member is known to meet the box and none
    is known not to.  Circles find their boxes by tiles; only trees with a circle that meets the box are folded for it.
    """
    leaf = F.struct("location", "path")
    met = maps.circles_in_viewport(boxes, nodes.where(F.col("kind") == "circle").select(leaf.alias("fact_id"), "lat", "lon", "radius_m"), level)
    met = met.select("box", "fact_id.location", "fact_id.path").withColumn("_met", F.lit(1))
    asked = met.select("box", "location").distinct().join(nodes.select("location", "path", "kind"), "location").join(met, ["box", "location", "path"], "left")
    known = F.when(F.col("kind") == "circle", F.coalesce("_met", F.lit(0))).when(F.col("kind") == "empty", F.lit(0))
    one_of = F.when(F.col("most") == 1, F.lit(1)).when(F.col("known") == F.col("members"), F.lit(0))
    return folded(asked.withColumn("value", known), ["box", "location"], one_of, F.col("least")).where("value = 1").select("box", "location")


def _crossings(lat, lon, r, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the rims of the circles ``i`` and ``j`` cross on the ellipsoid: two points of each pair that does.

    A point of the first rim is known by its direction; it is sought on each side of the line of the centres, by steps
    whose slope is that of a sphere, and by halving where they don't settle.
    """
    d, azimuth = geo.ellipsoid_inverse(lat[i], lon[i], lat[j], lon[j])
    ok = (d <= r[i] + r[j]) & (d >= np.abs(r[i] - r[j])) & (d > 1e-9) & (r[i] > 0)
    i, j, d, azimuth = i[ok], j[ok], d[ok], azimuth[ok]
    if not len(i):
        return np.zeros(0), np.zeros(0)
    i, j, d, azimuth, side = np.tile(i, 2), np.tile(j, 2), np.tile(d, 2), np.tile(azimuth, 2), np.repeat([1.0, -1.0], len(i))
    a, b, c = r[i] / 6371008.8, r[j] / 6371008.8, d / 6371008.8

    def off(turn):
        y, x = geo.ellipsoid_direct(lat[i], lon[i], azimuth + side * turn, r[i])
        return geo.ellipsoid_metres(y, x, lat[j], lon[j]) - r[j], y, x

    with np.errstate(all="ignore"):
        turn = np.arccos(np.clip((np.cos(b) - np.cos(a) * np.cos(c)) / (np.sin(a) * np.sin(c)), -1, 1))
        for _ in range(6):
            miss, y, x = off(turn)
            slope = np.sin(a) * np.sin(c) * np.sin(turn) / np.maximum(np.sin(b), 1e-12) * 6371008.8
            turn = np.clip(turn - np.where(slope > 1.0, miss / np.maximum(slope, 1.0), 0.0), 0, np.pi)
    miss, y, x = off(turn)
    if (np.abs(miss) > LEAST_SLACK / 10).any():
        low, high = np.zeros(len(i)), np.full(len(i), np.pi)
        for _ in range(60):
            half = (low + high) / 2
            far = off(half)[0] > 0
            low, high = np.where(far, low, half), np.where(far, half, high)
        again, y2, x2 = off((low + high) / 2)
        better = np.abs(again) < np.abs(miss)
        y, x = np.where(better, y2, y), np.where(better, x2, x)
    return y, x


class Tree:
    """One location's nodes in memory: as many as ``MAX_MERGED`` circles allow."""

    def __init__(self, paths: list[tuple], kinds: list[str], lat, lon, radius_m):
        self.kinds = dict(zip(paths, kinds, strict=True))
        self.members: dict[tuple, list[tuple]] = {}
        for path in sorted(self.kinds):
            if path:
                self.members.setdefault(path[:-1], []).append(path)
        circles = [k for k, kind in enumerate(kinds) if kind == "circle"]
        self.circle = {paths[k]: n for n, k in enumerate(circles)}
        self.lat, self.lon, self.r = (np.asarray(v, float)[circles] for v in (lat, lon, radius_m))

    def covered(self, path: tuple, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Which points lie in a node's region; what is unbounded or unresolved holds all points."""
        kind, out = self.kinds[path], np.zeros(len(lat), bool)
        if kind == "circle":
            k = self.circle[path]
            reach = self.r[k] * (1 + SLACK) + LEAST_SLACK
            # On a sphere distances are at most some 0.6 % off, which settles most points.
            a, b = np.radians(lat), np.radians(self.lat[k])
            h = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon - self.lon[k]) / 2) ** 2
            rough = 2 * 6371008.8 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
            out[rough * 1.01 + 1 < reach] = True
            close = np.flatnonzero((rough * 1.01 + 1 >= reach) & (rough * 0.99 - 1 <= reach))
            out[close] = geo.ellipsoid_metres(lat[close], lon[close], self.lat[k], self.lon[k]) <= reach
        elif kind == "one_of":
            for member in self.members.get(path, ()):
                left = np.flatnonzero(~out)
                out[left] = self.covered(member, lat[left], lon[left])
        elif kind == "all_of":
            left = np.arange(len(lat))
            for member in self.members.get(path, ()):
                left = left[self.covered(member, lat[left], lon[left])]
                if not len(left):
                    break
            out[left] = True
        elif kind != "empty":
            out[:] = True
        return out

    def witness(self, path: tuple) -> tuple[float, float] | None:
        """A point in all members of an "all of" node, if there is one.

        Where the region isn't empty, it holds a circle's centre, a crossing of two rims, or a point between two centres
        at which the depths under both rims are equal (which is where rims only touch).  Pairs are tried in blocks.
        """
        own = np.array([n for p, n in self.circle.items() if p[: len(path)] == path], np.int64)
        if not len(own):
            return (0.0, 0.0) if self.covered(path, np.zeros(1), np.zeros(1))[0] else None
        lat, lon, r = self.lat[own], self.lon[own], self.r[own]

        def first(y, x):
            for at in range(0, len(y), 4096):
                ok = self.covered(path, y[at : at + 4096], x[at : at + 4096])
                if ok.any():
                    return float(y[at + int(ok.argmax())]), float(x[at + int(ok.argmax())])
            return None

        found = first(lat, lon)
        i, j = np.triu_indices(len(own), 1)
        for solve in (self._balances, _crossings):
            for at in range(0, len(i), 4096):
                found = found or first(*solve(lat, lon, r, i[at : at + 4096], j[at : at + 4096]))
                if found:
                    return found
        return found

    @staticmethod
    def _balances(lat, lon, r, i, j):
        d, azimuth = geo.ellipsoid_inverse(lat[i], lon[i], lat[j], lon[j])
        some = d > 1e-9
        i, j, d, azimuth = i[some], j[some], d[some], azimuth[some]
        return geo.ellipsoid_direct(lat[i], lon[i], azimuth, np.clip((d + r[i] - r[j]) / 2, 0, d))

    def empty(self, path: tuple = ()) -> bool:
        """Whether no point is left under the loosest resolution of what is unresolved."""
        kind = self.kinds[path]
        if kind == "one_of":
            return all(self.empty(m) for m in self.members.get(path, ()))
        return kind == "empty" or (kind == "all_of" and self.witness(path) is None)


def verdicts(nodes: DataFrame, limit: int = MAX_MERGED) -> DataFrame:
    """location, n_circles, verdict of each tree: conflict if it is empty even with all that is unresolved taken for everywhere,
    else pending if something is unresolved or it has over ``limit`` circles, else consistent.

    Trees without "all of" are folded by grouping; only the others are gathered, a tree at a time, and none with over
    ``limit`` circles or four times as many nodes.
    """
    is_ = lambda kind: F.col("kind") == kind
    told = nodes.groupBy("location").agg(
        F.sum(is_("circle").cast("long")).alias("n_circles"), F.count(F.lit(1)).alias("_n"), F.bool_or(is_("all_of")).alias("_meets"), F.bool_or(is_("reference")).alias("_open"),
    )
    some = lambda rows: nodes.join(rows.select("location"), "location", "left_semi")
    small = (F.col("n_circles") <= limit) & (F.col("_n") <= 4 * limit)
    plain = some(told.where(~F.col("_meets"))).withColumn("value", is_("empty").cast("int"))
    flat = folded(plain, ["location"], F.col("least"), F.col("most")).select("location", (F.col("value") == 1).alias("_empty"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree([tuple(p) for p in pdf["path"]], list(pdf["kind"]), pdf["lat"], pdf["lon"], pdf["radius_m"])
        return pd.DataFrame({"location": pdf["location"].iloc[:1], "_empty": [tree.empty()]})

    kind = nodes.schema["location"].dataType.simpleString()
    met = some(told.where(F.col("_meets") & small)).select("location", "path", "kind", "lat", "lon", "radius_m").groupBy("location").applyInPandas(run, f"location {kind}, _empty boolean")
    verdict = F.when(F.col("_empty") & small, "conflict").when(F.col("_open") | ~small, "pending").otherwise("consistent")
    return told.join(flat.unionByName(met), "location", "left").select("location", "n_circles", verdict.alias("verdict"))


def merged(nodes: DataFrame, key: str) -> DataFrame:
    """The trees (``nodes`` with a further column ``key``) of one key as members of one "all of" tree: what all sources say at once."""
    inside = nodes.select(F.col(key).alias("location"), F.concat(F.array(F.col("location").cast("long")), "path").alias("path"), "kind", "lat", "lon", "radius_m")
    number = F.lit(None).cast("double")
    roots = nodes.select(F.col(key).alias("location")).distinct().select("location", F.array().cast("array<long>").alias("path"), F.lit("all_of").alias("kind"), number.alias("lat"), number.alias("lon"), number.alias("radius_m"))
    return inside.unionByName(roots)


def bracket(nodes: DataFrame, key: str) -> DataFrame:
    """key, n_circles, verdict of all that is claimed of a key's location at once (see ``merged`` and ``verdicts``)."""
    return verdicts(merged(nodes, key)).withColumnRenamed("location", key)


def faults(nodes: DataFrame, limit: int = MAX_CIRCLES) -> DataFrame:
    """location, fault: submitted locations with over ``limit`` circles (too_complex), or that no resolution can save (empty)."""
    found = verdicts(nodes, limit)
    fault = F.when(F.col("n_circles") > limit, "too_complex").when(F.col("verdict") == "conflict", "empty")
    return found.select("location", fault.alias("fault")).where("fault is not null")
