"""Column functions on coordinates and polygons."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def local_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north of a near origin in metres."""
    return (lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(lat0)), (lat - lat0) * METRES_PER_DEGREE


def utm(lat: Column, lon: Column, zone: int = 44) -> tuple[Column, Column]:
    """Easting and northing on WGS84, by the transverse Mercator series."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    p2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(6 * zone - 183))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, x = F.pow(F.tan(phi), 2), p2 * F.pow(F.cos(phi), 2), F.cos(phi) * lam
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = k0 * n * (x + (1 - t + c) * F.pow(x, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * p2) * F.pow(x, 5) / 120) + 500_000
    north = k0 * (m + n * F.tan(phi) * (x * x / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(x, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * p2) * F.pow(x, 6) / 720))
    return east, north


def valid_fix(lat: Column, lon: Column) -> Column:
    """Inside the box of the field region."""
    return F.coalesce(lat.between(5.9, 9.9) & lon.between(79.5, 82.0), F.lit(False))


def crosses(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray from (x, y) to the right crosses an edge."""
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)


def in_ring(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Whether a point is in a fixed ring, by counting crossings."""
    n = sum((crosses(x, y, *map(F.lit, (*a, *b))).cast("int") for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if a[1] != b[1]), F.lit(0))
    return F.coalesce(n % 2 == 1, F.lit(False))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it; a plain column would be computed at each place."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _following(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def shoelace(ring: Column) -> Column:
    """Area of a ring, an array of (x, y) structs."""
    terms = lambda r: F.zip_with(r, _following(r), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return once(ring, lambda r: F.abs(F.aggregate(terms(r), F.lit(0.0), lambda a, t: a + t)) / 2)


def ring_centroid(ring: Column) -> Column:
    """The centre of mass of a ring's area; its first corner where it has no area."""

    def moments(p: Column, q: Column) -> Column:
        return once(p["x"] * q["y"] - q["x"] * p["y"], lambda e: F.struct(e.alias("e"), ((p["x"] + q["x"]) * e).alias("x"), ((p["y"] + q["y"]) * e).alias("y")))

    def centre(r: Column) -> Column:
        zero = F.struct(*[F.lit(0.0).alias(c) for c in "exy"])
        sums = F.aggregate(F.zip_with(r, _following(r), moments), zero, lambda a, t: F.struct(*[(a[c] + t[c]).alias(c) for c in "exy"]))
        first = F.element_at(r, 1)
        none = F.struct(*[first[c].cast("double").alias(c) for c in "xy"])
        return once(sums, lambda s: F.when(s["e"] == 0, none).otherwise(F.struct(*[(s[c] / F.nullif(3 * s["e"], F.lit(0.0))).alias(c) for c in "xy"])))

    return once(ring, centre)


def clipped(ring: Column, at: tuple[Column, Column], away: tuple[Column, Column]) -> Column:
    """The part of a ring on the side of a line that ``away`` points away from; the line goes through ``at``.

    Each edge gives its first corner if that is inside and where it crosses the line (Sutherland and Hodgman 1974).
    Right for convex rings, as Voronoi cells and hulls are; others may get edges along the line.
    """
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    beyond = lambda p: (p["x"] - at[0]) * away[0] + (p["y"] - at[1]) * away[1]

    def part(p: Column, q: Column) -> Column:
        def ends(b: Column) -> Column:
            share = b["s"] / F.nullif(b["s"] - b["t"], F.lit(0.0))
            crossing = once(share, lambda k: point(p["x"] + k * (q["x"] - p["x"]), p["y"] + k * (q["y"] - p["y"])))
            return F.array_compact(F.array(F.when(b["s"] <= 0, point(p["x"], p["y"])), F.when(b["s"] * b["t"] < 0, crossing)))

        return once(F.struct(beyond(p).alias("s"), beyond(q).alias("t")), ends)

    return once(ring, lambda r: F.flatten(F.zip_with(r, _following(r), part)))


def convex_hull(points: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull of a small group of points, anticlockwise."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    half: list[list[tuple[float, float]]] = []
    for run in (pts, pts[::-1]):
        side: list[tuple[float, float]] = []
        for p in run:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        half.append(side[:-1])
    return half[0] + half[1]


def polygon_area(points: Sequence[tuple[float, float]]) -> float:
    return abs(math.fsum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, [*points[1:], *points[:1]], strict=True))) / 2
