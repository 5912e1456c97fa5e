"""Web-mercator tiles and Morton keys as column expressions, and distances on the ellipsoid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Finest tile level; latitude where the projection's square ends, atan(sinh(pi)); largest double below 1.
MAX_LEVEL, LAT_LIMIT, BELOW_ONE = 24, 85.05112877980659, 1 - 2.0**-53
#: Tiles that one cluster read, and one enumeration, may ask for.
CLUSTER_TILES, VIEWPORT_TILES = 256, 65_536


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(BELOW_ONE), c))


def mercator_x(lon: Column) -> Column:
    """Eastward position from the antimeridian, in [0, 1)."""
    return _unit((lon + 180.0) / 360.0)


def mercator_y(lat: Column) -> Column:
    """Southward position from the north limit, in [0, 1); latitudes past the limit are clamped."""
    r = F.radians(F.greatest(F.lit(-LAT_LIMIT), F.least(F.lit(LAT_LIMIT), lat)))
    return _unit((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0)


def lon_of_x(x: Column) -> Column:
    return x * 360.0 - 180.0


def lat_of_y(y: Column) -> Column:
    lat = F.degrees(F.atan(F.sinh((1.0 - y * 2.0) * math.pi)))
    return F.greatest(F.lit(-LAT_LIMIT), F.least(F.lit(LAT_LIMIT), lat))


def tile_index(unit: Column, level: int) -> Column:
    return F.least(F.floor(unit * float(1 << level)), F.lit((1 << level) - 1)).cast("long")


def _spread(v: Column) -> Column:
    """The low 24 bits of v on the even places of 48."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column) -> Column:
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def quadkey(lat: Column, lon: Column) -> Column:
    """Morton code of a point at the finest level: 48 bits, x on the even ones."""
    return morton(tile_index(mercator_x(lon), MAX_LEVEL), tile_index(mercator_y(lat), MAX_LEVEL))


def tile_prefix(key: Column, level: int) -> Column:
    """The tile of a key at a level: its high 2 * level bits."""
    return F.shiftright(key, 2 * (MAX_LEVEL - level))


def tile_range(prefix: Column, level: int) -> tuple[Column, Column]:
    """First and last finest key inside a tile."""
    shift = 2 * (MAX_LEVEL - level)
    return F.shiftleft(prefix, shift), F.shiftleft(prefix + 1, shift) - 1


def split_level(least: Column, most: Column) -> Column:
    """The coarsest level at which keys with these extremes fall into several tiles."""
    common = F.lit(48) - F.length(F.bin(least.bitwiseXOR(most)))
    return F.when(least == most, F.lit(MAX_LEVEL)).otherwise(F.least(F.lit(MAX_LEVEL), F.floor(common / 2) + 1)).cast("int")


def half_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes (box, south, north, west, east) with those that cross the antimeridian in two halves."""
    east = boxes.where("west > east").withColumn("east", F.lit(180.0))
    west = boxes.where("west > east").withColumn("west", F.lit(-180.0))
    return boxes.where("west <= east").unionByName(east).unionByName(west)


def viewport_tiles(boxes: DataFrame, level: int, limit: int = VIEWPORT_TILES) -> DataFrame:
    """box, tile: the distinct tiles that each box meets; a box with more than ``limit`` tiles is an error."""
    y = lambda lat: tile_index(mercator_y(F.col(lat)), level)
    x = lambda lon: tile_index(mercator_x(F.col(lon)), level)
    shape = half_boxes(boxes).select("box", x("west").alias("_x0"), x("east").alias("_x1"), y("north").alias("_y0"), y("south").alias("_y1"))
    count = (F.col("_x1") - F.col("_x0") + 1) * (F.col("_y1") - F.col("_y0") + 1)
    too_many = F.raise_error(F.concat(F.lit(f"more than {limit} tiles in box "), F.col("box").cast("string")))
    shape = shape.withColumn("_x1", F.when(count > limit, too_many.cast("long")).otherwise(F.col("_x1")))
    cells = shape.withColumn("_x", F.explode(F.sequence("_x0", "_x1"))).withColumn("_y", F.explode(F.sequence("_y0", "_y1")))
    return cells.select("box", morton(F.col("_x"), F.col("_y")).alias("tile")).distinct()


#: Axes of the WGS84 ellipsoid in metres.  Fixed values.
_A, _B = 6378137.0, 6356752.314245179


#: Rounds after which an inverse solution that hasn't settled counts as near-antipodal.
_ROUNDS = 60


def ellipsoid_inverse(lat1, lon1, lat2, lon2) -> tuple[np.ndarray, np.ndarray]:
    """(metres, azimuth at the first point in radians) by Vincenty's inverse solution for arrays of degrees.

    Near-antipodal pairs, where it doesn't settle, are taken as on a sphere.
    """
    f = 1 - _B / _A
    lat1, lon1, lat2, lon2 = np.broadcast_arrays(*(np.radians(np.asarray(v, float)) for v in (lat1, lon1, lat2, lon2)))
    u1, u2 = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    l = (lon2 - lon1 + np.pi) % (2 * np.pi) - np.pi  # noqa: E741
    lam, done = l.copy(), np.zeros(l.shape, bool)
    with np.errstate(all="ignore"):
        for _ in range(_ROUNDS):
            s, c = np.sin(lam), np.cos(lam)
            sin_sigma = np.hypot(c2 * s, c1 * s2 - s1 * c2 * c)
            cos_sigma = s1 * s2 + c1 * c2 * c
            sigma = np.arctan2(sin_sigma, cos_sigma)
            sin_alpha = np.where(sin_sigma == 0, 0, c1 * c2 * s / np.where(sin_sigma == 0, 1, sin_sigma))
            cos2 = 1 - sin_alpha**2
            mid = np.where(cos2 < 1e-15, 0, cos_sigma - 2 * s1 * s2 / np.where(cos2 < 1e-15, 1, cos2))
            k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = l + (1 - k) * f * sin_alpha * (sigma + k * sin_sigma * (mid + k * cos_sigma * (2 * mid**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        q = cos2 * (_A**2 - _B**2) / _B**2
        a = 1 + q / 16384 * (4096 + q * (q * (320 - 175 * q) - 768))
        b = q / 1024 * (256 + q * (q * (74 - 47 * q) - 128))
        d = b * sin_sigma * (mid + b / 4 * (cos_sigma * (2 * mid**2 - 1) - b / 6 * mid * (4 * sin_sigma**2 - 3) * (4 * mid**2 - 3)))
        exact = _B * a * (sigma - d)
    settled = done & np.isfinite(exact)
    lam = np.where(settled, lam, l)
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(l / 2) ** 2
    metres = np.where(settled, exact, 2 * 6371008.8 * np.arcsin(np.sqrt(np.clip(h, 0, 1))))
    return metres, np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))


def ellipsoid_metres(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Geodesic distance for arrays of degrees (see ``ellipsoid_inverse``)."""
    return ellipsoid_inverse(lat1, lon1, lat2, lon2)[0]


def ellipsoid_direct(lat, lon, azimuth, metres) -> tuple[np.ndarray, np.ndarray]:
    """(lat, lon) in degrees that lie ``metres`` from points in a direction (radians), by Vincenty's direct solution."""
    f = 1 - _B / _A
    lat, lon, azimuth, metres = np.broadcast_arrays(np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float)), np.asarray(azimuth, float), np.asarray(metres, float))
    u = np.arctan((1 - f) * np.tan(lat))
    su, cu, sa, ca = np.sin(u), np.cos(u), np.sin(azimuth), np.cos(azimuth)
    sigma1 = np.arctan2(su, cu * ca)
    sin_alpha = cu * sa
    cos2 = 1 - sin_alpha**2
    q = cos2 * (_A**2 - _B**2) / _B**2
    a = 1 + q / 16384 * (4096 + q * (q * (320 - 175 * q) - 768))
    b = q / 1024 * (256 + q * (q * (74 - 47 * q) - 128))
    sigma = start = metres / (_B * a)
    for _ in range(_ROUNDS):
        mid = np.cos(2 * sigma1 + sigma)
        step = b * np.sin(sigma) * (mid + b / 4 * (np.cos(sigma) * (2 * mid**2 - 1) - b / 6 * mid * (4 * np.sin(sigma) ** 2 - 3) * (4 * mid**2 - 3)))
        new = start + step
        settled = (np.abs(new - sigma) < 1e-13).all()
        sigma = new
        if settled:
            break
    mid = np.cos(2 * sigma1 + sigma)
    s, c = np.sin(sigma), np.cos(sigma)
    there = np.arctan2(su * c + cu * s * ca, (1 - f) * np.hypot(sin_alpha, su * s - cu * c * ca))
    lam = np.arctan2(s * sa, cu * c - su * s * ca)
    k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
    away = lam - (1 - k) * f * sin_alpha * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
    return np.degrees(there), np.degrees((lon + away + np.pi) % (2 * np.pi) - np.pi)


@pandas_udf(DoubleType())
def geodesic_m(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(ellipsoid_metres(lat1, lon1, lat2, lon2))


#: Third flattening of the WGS84 ellipsoid and its equatorial radius in metres.  Fixed values.
_THIRD, _EQUATOR = 1 / 298.257223563 / (2 - 1 / 298.257223563), 6378137.0


def meridian_m(lat: Column) -> Column:
    """Metres along the meridian from the equator to a latitude on WGS84, by the series in the third flattening (errors below a micrometre)."""
    n, r = _THIRD, F.radians(lat)
    terms = [1 + n**2 / 4 + n**4 / 64, -3 / 2 * (n - n**3 / 8), 15 / 16 * (n**2 - n**4 / 4), -35 / 48 * n**3, 315 / 512 * n**4]
    return (r * terms[0] + sum((F.sin(r * (2 * k)) * t for k, t in enumerate(terms[1:], 1)), F.lit(0.0))) * (_EQUATOR / (1 + n))


def bounding_rects(lat: Column, lon: Column, radius_m: Column) -> Column:
    """array of (south, north, west, east) that surely hold a circle: two at the antimeridian, the whole ring at a pole."""
    # One degree of arc is at least this many metres anywhere on the ellipsoid.
    reach = radius_m / 110_500.0
    south, north = F.greatest(F.lit(-90.0), lat - reach), F.least(F.lit(90.0), lat + reach)
    widest = F.greatest(F.abs(south), F.abs(north))
    polar = widest >= 90.0
    spread = F.when(polar, F.lit(180.0)).otherwise(F.least(F.lit(180.0), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.least(F.lit(90.0), reach))) / F.cos(F.radians(F.least(widest, F.lit(89.999)))))))))
    west, east = lon - spread, lon + spread
    rect = lambda w, e: F.struct(south.alias("south"), north.alias("north"), w.alias("west"), e.alias("east"))
    whole = F.array(rect(F.lit(-180.0), F.lit(180.0)))
    return F.when(spread >= 180.0, whole).when(west < -180.0, F.array(rect(F.lit(-180.0), east), rect(west + 360.0, F.lit(180.0)))).when(east > 180.0, F.array(rect(west, F.lit(180.0)), rect(F.lit(-180.0), east - 360.0))).otherwise(F.array(rect(west, east)))
