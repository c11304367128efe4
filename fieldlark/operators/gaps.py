"""Gaps of a traced stem: curves over them, and lengths of what was seen and what was made up."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_POINTS = 1_000_000


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _way(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def length_of(points: Column) -> Column:
    """Length of the line through an array of (x, y)."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.aggregate(F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), _way), F.lit(0.0), lambda a, d: a + d)


def direction(points: Column, reach: float) -> Column:
    """The unit vector into the first point from the point ``reach`` along the line; null where they coincide."""
    first = F.element_at(points, 1)
    start = F.struct(F.lit(0.0).alias("done"), first.alias("at"))
    step = lambda s, p: F.when(s["done"] >= reach, s).otherwise(F.struct((s["done"] + _way(s["at"], p)).alias("done"), p.alias("at")))
    far = F.aggregate(points, start, step)["at"]
    d = _way(far, first)
    return F.when(d > 1e-6, _point((first["x"] - far["x"]) / d, (first["y"] - far["y"]) / d))


def stem_gaps(segments: DataFrame, key: str, order: str, points: str, reach: float = 20.0) -> DataFrame:
    """(key, order, p0, p1, t0, t1): the gap behind each segment but the last, with the directions of travel at its ends.

    ``points`` are a segment's (x, y) along the stem. A segment of one point has no direction.
    """
    following = F.lead(points).over(Window.partitionBy(key).orderBy(order))
    both = segments.select(key, order, F.col(points).alias("_a"), following.alias("_b")).where("size(_a) > 0 and size(_b) > 0")
    back = direction(F.col("_b"), reach)
    out = both.select(key, order, F.element_at("_a", -1).alias("p0"), F.element_at("_b", 1).alias("p1"), direction(F.reverse("_a"), reach).alias("t0"), back.alias("_t1"))
    return out.withColumn("t1", F.when(F.col("_t1").isNotNull(), _point(-F.col("_t1.x"), -F.col("_t1.y")))).drop("_t1")


def _curve_length(ends: pd.DataFrame, n: pd.Series) -> pd.Series:
    """Length of the cubic through n + 1 points for each row, as the expressions of :func:`filled_gaps` place them; null where n is.

    All points of some rows are worked on at once, about ``_POINTS`` and those of one row at most.
    """
    out = np.full(len(n), np.nan)
    rows = np.flatnonzero(n.notna().to_numpy())
    steps = n.to_numpy(dtype=float, na_value=np.nan)[rows].astype(np.int64)
    at = {c: ends[c].to_numpy(dtype=float, na_value=np.nan)[rows] for c in ends.columns}
    block = np.cumsum(steps + 1) // _POINTS
    for a, b in zip(*(np.searchsorted(block, np.unique(block), side) for side in ("left", "right")), strict=True):
        k = steps[a:b]
        first = np.cumsum(k + 1) - (k + 1)
        row = np.repeat(np.arange(b - a), k + 1)
        t = (np.arange(len(row)) - first[row]) / k[row]
        s = 1 - t
        weights = (1 + 2 * t) * s * s, t * s * s, t * t * (3 - 2 * t), t * t * (t - 1)
        v = {c: x[a:b] for c, x in at.items()}
        x, y = (weights[0] * v[f"p0{c}"][row] + weights[1] * (v["m"] * v[f"t0{c}"])[row] + weights[2] * v[f"p1{c}"][row] + weights[3] * (v["m"] * v[f"t1{c}"])[row] for c in "xy")
        way = np.append(np.hypot(np.diff(x), np.diff(y)), 0.0)
        way[first + k] = 0.0  # from a row's last point to the next row's first
        out[rows[a:b]] = np.add.reduceat(way, first)
    return pd.Series(out)


def filled_gaps(gaps: DataFrame, scale: float = 0.55, most_bend: float = 1.8, longest: float = 160.0, along: float = 0.15) -> DataFrame:
    """``gaps`` with chord, method, points and length.

    A gap is bridged by the cubic that leaves and enters along the stem, its tangents ``scale`` times the chord. A
    direction that is missing, or points less than ``along`` of its length towards the other end, is replaced by the
    chord's. A curve over ``most_bend`` times the chord is given up for the chord ("straight"), a chord over
    ``longest`` is left open ("too_long", without points). At least 30 points, else three for each pixel.
    """
    chord = _way(F.col("p0"), F.col("p1"))
    df = gaps.withColumn("chord", chord).withColumn("_d", _point((F.col("p1.x") - F.col("p0.x")) / F.nullif("chord", F.lit(0.0)), (F.col("p1.y") - F.col("p0.y")) / F.nullif("chord", F.lit(0.0))))
    ahead = lambda t: F.col(t)["x"] * F.col("_d.x") + F.col(t)["y"] * F.col("_d.y")
    df = df.withColumns({f"_{t}": F.when(F.coalesce(ahead(t) >= along, F.lit(False)), F.col(t)).otherwise(F.col("_d")) for t in ("t0", "t1")})
    n = F.greatest(F.lit(30), F.floor(F.col("chord") * 3).cast("int")) - 1
    m = F.col("chord") * scale

    def at(i: Column) -> Column:
        t = i / n
        a, b = (1 + 2 * t) * (1 - t) * (1 - t), t * (1 - t) * (1 - t)
        c, d = t * t * (3 - 2 * t), t * t * (t - 1)
        return _point(*[a * F.col("p0")[k] + b * m * F.col("_t0")[k] + c * F.col("p1")[k] + d * m * F.col("_t1")[k] for k in ("x", "y")])

    def straight(i: Column) -> Column:
        return _point(*[F.col("p0")[k] + (F.col("p1")[k] - F.col("p0")[k]) * (i / n) for k in ("x", "y")])

    steps = F.sequence(F.lit(0), n)
    bridged = (F.col("chord") > 0) & (F.col("chord") <= longest)
    df = df.withColumn("_curve", F.when(bridged, F.transform(steps, at)))
    # Lengths need no array of points, and that column goes unmade where nobody reads it.
    ends = F.struct(*[F.col(f"{c}.{k}").alias(f"{c.strip('_')}{k}") for c in ("p0", "p1", "_t0", "_t1") for k in ("x", "y")], m.alias("m"))
    df = df.withColumn("_long", F.pandas_udf(_curve_length, "double")(ends, F.when(bridged, n)))
    method = F.when(F.col("chord") > longest, "too_long").when(F.coalesce(F.col("_long") <= most_bend * F.col("chord"), F.lit(False)), "hermite").otherwise("straight")
    df = df.withColumn("method", method)
    df = df.withColumns({"points": F.when(F.col("method") == "hermite", F.col("_curve")).when(F.col("method") == "straight", F.transform(steps, straight)), "length": F.when(F.col("method") == "hermite", F.col("_long")).when(F.col("method") == "straight", F.col("chord"))})
    return df.drop("_d", "_t0", "_t1", "_curve", "_long")


def filled_lengths(segments: DataFrame, key: str, order: str, points: str, scale: float = 1.0, **how: float) -> DataFrame:
    """(key, observed, estimated, filled, too_long): length of the segments and of the curves over their gaps, and the number of gaps of each kind."""
    seen = segments.groupBy(key).agg((F.sum(length_of(F.col(points))) * scale).alias("observed"))
    made = filled_gaps(stem_gaps(segments, key, order, points), **how).groupBy(key)
    made = made.agg((F.coalesce(F.sum("length"), F.lit(0.0)) * scale).alias("estimated"), F.count("length").alias("filled"), F.count_if(F.col("method") == "too_long").alias("too_long"))
    return seen.join(made, key, "left").na.fill(0.0, ["estimated"]).na.fill(0, ["filled", "too_long"])
