"""Provenance labels, location brackets and merge bridges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Circles of a merged location beyond which the verdict is pending.
MAX_CIRCLES = 1000
_EARTH = 6371008.8


def minimal(label: Column) -> Column:
    """An antichain: environments (arrays of atoms) without those that contain another, in sorted order."""
    sets = F.array_distinct(F.transform(label, lambda e: F.array_sort(F.array_distinct(e))))
    return F.array_sort(F.filter(sets, lambda e: ~F.exists(sets, lambda o: (F.size(o) < F.size(e)) & (F.size(F.array_except(o, e)) == 0))))


def label_plus(a: Column, b: Column) -> Column:
    """Either label: the minimised union of environments."""
    return minimal(F.concat(a, b))


def label_times(a: Column, b: Column) -> Column:
    """Both labels: the minimised unions of one environment from each."""
    return minimal(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array_union(x, y)))))


def environments(rows: DataFrame, key: str, label: str) -> DataFrame:
    """key, env: the environments (sorted arrays of distinct atoms) of ``rows``' labels, a row for each."""
    return rows.select(key, F.explode(label).alias("_e")).select(key, F.array_sort(F.array_distinct("_e")).alias("env")).distinct()


def minimal_environments(envs: DataFrame, key: str) -> DataFrame:
    """key, env: those of a key's environments that hold no other one of it.

    An environment meets only those that hold its first atom, in a join on key and atom, which AQE splits; no key's
    environments are gathered.  The empty one, which needs nothing, leaves itself alone.
    """
    envs = envs.select(key, "env").distinct()
    free = envs.where(F.size("env") == 0)
    small = envs.where(F.size("env") > 0).select(key, F.get("env", F.lit(0)).alias("_atom"), F.col("env").alias("_small"))
    held = envs.select(key, "env", F.explode("env").alias("_atom")).join(small, [key, "_atom"])
    more = held.where((F.size("_small") < F.size("env")) & (F.size(F.array_except("_small", "env")) == 0)).select(key, "env").distinct()
    rest = envs.where(F.size("env") > 0).join(more, [key, "env"], "left_anti").join(free.select(key), key, "left_anti")
    return rest.unionByName(free)


def times(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, env: what needs both: the minimal unions of an environment of ``a`` and one of ``b`` with the same key."""
    both = a.select(key, F.col("env").alias("_a")).join(b.select(key, F.col("env").alias("_b")), key)
    return minimal_environments(both.select(key, F.array_sort(F.array_union("_a", "_b")).alias("env")), key)


def plus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, env: what needs either."""
    return minimal_environments(a.select(key, "env").unionByName(b.select(key, "env")), key)


def stamped(envs: DataFrame, atom: str) -> DataFrame:
    """``envs`` with a further atom, such as the rule that a derivation took, in each environment."""
    return envs.withColumn("env", F.array_sort(F.array_union("env", F.array(F.lit(atom)))))


def label_sum(rows: DataFrame, key: str, label: str) -> DataFrame:
    """key, label: ``label_plus`` over a group; only the minimal environments are gathered."""
    return minimal_environments(environments(rows, key, label), key).groupBy(key).agg(F.array_sort(F.collect_list("env")).alias("label"))


def _unit(lat, lon) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def caps_meet(lat, lon, radius_m) -> bool:
    """Whether spherical circles share a point: a centre, or a crossing of two rims, lies in all of them.

    Points are tried in small steps and the first one inside all circles ends the search, so memory is that
    of one circle's crossings with the others.
    """
    at, r = _unit(np.asarray(lat, float), np.asarray(lon, float)), np.minimum(np.asarray(radius_m, float) / _EARTH, np.pi)
    order = np.argsort(r, kind="stable")  # a common point is inside the smallest circle, so its rim is tried first
    at, r = at[order], r[order]

    def inside(points) -> bool:
        for a in range(0, len(points), 256):
            left = points[a : a + 256]
            for c in range(0, len(at), 256):  # most points are outside one of the first circles
                left = left[(np.arccos(np.clip(left @ at[c : c + 256].T, -1, 1)) <= r[c : c + 256] + 1e-9).all(axis=1)]
                if not len(left):
                    break
            if len(left):
                return True
        return False

    if inside(at):
        return True
    for i in range(len(at)):
        n = np.cross(at[i], at[i + 1 :])
        s = (n * n).sum(axis=1)
        d, ci, cj = at[i + 1 :] @ at[i], np.cos(r[i]), np.cos(r[i + 1 :])
        ok = s >= 1e-18
        n, s, d, cj, other = n[ok], s[ok], d[ok], cj[ok], at[i + 1 :][ok]
        base = ((ci - d * cj) / s)[:, None] * at[i] + ((cj - d * ci) / s)[:, None] * other
        rest = (1 - (base * base).sum(axis=1)) / s
        ok = rest >= 0
        step = np.sqrt(rest[ok])[:, None] * n[ok]
        if inside(np.concatenate([base[ok] + step, base[ok] - step])):
            return True
    return False


def location_bracket(circles: DataFrame, key: str) -> DataFrame:
    """key, n_circles, verdict (consistent, conflict, or pending beyond the limit) of circles (lat, lon, radius_m).

    Only distinct circles count, and a group beyond the limit is never gathered.
    """
    rows = circles.select(key, "lat", "lon", "radius_m").distinct()
    counts = rows.groupBy(key).agg(F.count("*").alias("n_circles"))
    small = rows.join(counts.where(F.col("n_circles") <= MAX_CIRCLES), key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = caps_meet(pdf["lat"], pdf["lon"], pdf["radius_m"])
        return pd.DataFrame({key: pdf[key].iloc[:1], "n_circles": pdf["n_circles"].iloc[:1], "verdict": ["consistent" if ok else "conflict"]})

    kind = rows.schema[key].dataType.simpleString()
    judged = small.groupBy(key).applyInPandas(run, f"{key} {kind}, n_circles long, verdict string")
    return judged.unionByName(counts.where(F.col("n_circles") > MAX_CIRCLES).withColumn("verdict", F.lit("pending")))


def connecting_glue(support: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """keys, edge_id, a, b: the identity edges that make one value of what several members said.

    ``support`` has the value's keys and each ``member`` that contributed to it.  An edge counts for a value when both
    its ends are among its members: a value that one member alone asserted has none.
    """
    said = support.select(*keys, "member").distinct()
    at = edges.where("a <> b").join(said.withColumnRenamed("member", "a"), "a")
    return at.join(said.withColumnRenamed("member", "b"), [*keys, "b"]).select(*keys, "edge_id", "a", "b")
