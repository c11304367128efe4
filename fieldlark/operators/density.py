"""Density clusters by a graph of cells, without the pairs of close points.

Cells are so small that two points of one are always within the distance. So a point of a cell with enough points is a
core point without a comparison, and its cell's core points are one cluster. Points of other cells, of which a cell has
few, are compared with the points around them to count neighbours. Cells are joined where a core point of the one is
within the distance of a core point of the other: boxes around parts of cells decide most of that, and only points of
parts that are neither surely near nor surely apart are compared. Clusters are components of cells. Nothing is gathered
in a group, and what is written and shuffled follows the number of points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.functions.geo import METRES_PER_DEGREE, haversine
from fieldlark.operators.components import connected_components
from fieldlark.operators.lineage import cut

#: A cell's side as a share of the distance, a little under half the square root of two; rows and columns of cells within reach at up to 60 degrees of latitude.
_SIDE, _ROWS, _COLUMNS, _PARTS = 0.7, 2, 3, 8
_EARTH = 6_371_000.0


def _celled(points: DataFrame, metres: float) -> DataFrame:
    side = _SIDE * metres
    bad = (F.abs(F.col("lat")) > 60) | (F.abs(F.col("lon")) > 179)
    lat = F.when(bad, F.raise_error(F.lit("cells are laid out for latitudes up to 60 and longitudes up to 179 degrees")).cast("double")).otherwise(F.col("lat"))
    y, x = lat * METRES_PER_DEGREE / side, F.col("lon") * METRES_PER_DEGREE / side
    part = (F.floor((y - F.floor(y)) * _PARTS) * _PARTS + F.floor((x - F.floor(x)) * _PARTS)).cast("int")
    return points.withColumns({"cy": F.floor(y), "cx": F.floor(x), "part": part})


def _around(df: DataFrame, half: bool = False) -> DataFrame:
    """A row for each cell within reach in place of the own cell, which stays as (oy, ox); ``half`` keeps the cells behind it only."""
    steps = [(y, x) for y in range(-_ROWS, _ROWS + 1) for x in range(-_COLUMNS, _COLUMNS + 1) if not half or (y, x) > (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in steps]))
    df = df.withColumn("_s", step)
    return df.withColumns({"oy": F.col("cy"), "ox": F.col("cx"), "cy": F.col("cy") + F.col("_s.dy"), "cx": F.col("cx") + F.col("_s.dx")}).drop("_s")


def _bounds() -> tuple[Column, Column]:
    """The least and the greatest distance between points of two boxes (a, b): from gaps and spans of their sides."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"a_{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"a_{c}1"))
    span = lambda c: F.greatest(F.col(f"a_{c}1"), F.col(f"b_{c}1")) - F.least(F.col(f"a_{c}0"), F.col(f"b_{c}0"))
    far = lambda s: F.greatest(F.abs(F.col(f"{s}_lat0")), F.abs(F.col(f"{s}_lat1")))
    close = lambda s: F.when(F.col(f"{s}_lat0") * F.col(f"{s}_lat1") <= 0, 0.0).otherwise(F.least(F.abs(F.col(f"{s}_lat0")), F.abs(F.col(f"{s}_lat1"))))
    cos = lambda d: F.cos(F.radians(d))

    def distance(dy: Column, dx: Column, shrink: Column) -> Column:
        h = F.pow(F.sin(F.radians(dy) / 2), 2) + shrink * F.pow(F.sin(F.radians(dx) / 2), 2)
        return 2 * _EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), h)))

    return distance(gap("lat"), gap("lon"), cos(far("a")) * cos(far("b"))), distance(span("lat"), span("lon"), cos(close("a")) * cos(close("b")))


def _merged(df: DataFrame) -> DataFrame:
    """The side of a join that Spark must not broadcast: a grid has dozens of such joins, whose sides follow the input and would all pass the driver."""
    return df.hint("merge")


def clusters(points: DataFrame, metres: float, least: int, group: Sequence[str] = ()) -> DataFrame:
    """(id, cluster): density clusters named by their least core point, null for noise.

    ``points`` has id, lat, lon and the columns of ``group``; points of different groups do not meet. A point counts as its
    own neighbour. A border point of several clusters goes to the one of the lesser name. Groups must not be null; a point
    without a position is noise.
    """
    own, cell = list(group), [*group, "cy", "cx"]
    placed = points.where("lat is not null and lon is not null").select("id", "lat", "lon", *own)
    p = cut(_celled(placed, metres))
    sizes = p.groupBy(*cell).agg(F.count("*").alias("n"))
    dense, sparse = (p.join(_merged(sizes.where(f"n {sign} {least}").select(*cell)), cell, "left_semi") for sign in (">=", "<"))
    sparse = cut(sparse)
    d = haversine(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon"))
    asking = _around(sparse.select(F.col("id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), *cell))
    near = asking.join(_merged(p), cell).where(d <= metres)
    core_ids = near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("a").alias("id"))
    core = cut(dense.unionByName(sparse.join(_merged(core_ids), "id", "left_semi")))

    box = [f(c).alias(f"{c}{k}") for c in ("lat", "lon") for k, f in enumerate((F.min, F.max))]
    parts = cut(core.groupBy(*cell, "part").agg(*box))
    names = ["part", "lat0", "lat1", "lon0", "lon1"]
    a = _around(parts, half=True).select(*cell, "oy", "ox", *[F.col(c).alias(f"a_{c}") for c in names])
    b = parts.select(*cell, *[F.col(c).alias(f"b_{c}") for c in names])
    low, high = _bounds()
    both = a.join(_merged(b), cell).withColumns({"_low": low, "_high": high}).where(F.col("_low") <= metres * (1 + 1e-9))
    pair = [*own, "oy", "ox", "cy", "cx"]
    sure = F.max(F.col("_high") <= metres * (1 - 1e-9))
    open_parts = F.collect_set(F.struct("a_part", "b_part"))  # 64 by 64 at most
    met = cut(both.groupBy(*pair).agg(sure.alias("sure"), open_parts.alias("open")))
    open_ = met.where("not sure").select(*pair, F.explode("open").alias("o")).select(*pair, "o.*")
    one = core.select(*own, F.col("cy").alias("oy"), F.col("cx").alias("ox"), F.col("part").alias("a_part"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    other = core.select(*cell, F.col("part").alias("b_part"), "lat", "lon")
    compared = open_.join(_merged(one), [*own, "oy", "ox", "a_part"]).join(_merged(other), [*cell, "b_part"]).where(d <= metres).select(*pair).distinct()
    name = lambda y, x: F.struct(*own, F.col(y).alias("cy"), F.col(x).alias("cx"))
    edges = met.where("sure").select(*pair).unionByName(compared).select(name("oy", "ox").alias("a"), name("cy", "cx").alias("b"))
    joined = connected_components(edges, "a", "b", broadcasts=False).withColumnRenamed("id", "_cell")
    core = core.select("id", "lat", "lon", *cell, name("cy", "cx").alias("_cell"))
    rooted = core.join(_merged(joined), "_cell", "left").withColumn("root", F.coalesce("component", "_cell")).drop("component", "_cell")
    least_core = rooted.groupBy("root").agg(F.min("id").alias("cluster"))
    labels = cut(rooted.join(_merged(least_core), "root").drop("root"))

    border = asking.join(_merged(core_ids.withColumnRenamed("id", "a")), "a", "left_anti").join(_merged(labels), cell).where(d <= metres)
    border = border.groupBy("a").agg(F.min("cluster").alias("cluster")).withColumnRenamed("a", "id")
    return points.select("id").join(_merged(labels.select("id", "cluster").unionByName(border)), "id", "left")


def accompanied(points: DataFrame, metres: float, group: Sequence[str] = ()) -> DataFrame:
    """(id): points with another id of their group within the distance.

    A cell that holds two ids settles its points without a comparison, so only points of the other cells, of which a cell
    has one, are compared with those around. Points of a null group or without a position have no company.
    """
    own, cell = list(group), [*group, "cy", "cx"]
    placed = points.where(" and ".join(f"{c} is not null" for c in ["lat", "lon", *own])).select("id", "lat", "lon", *own)
    p = cut(_celled(placed, metres))
    ids = p.groupBy(*cell).agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    full = p.join(ids.where("_low != _high").select(*cell), cell, "left_semi").select("id")
    alone = p.join(ids.where("_low = _high").select(*cell), cell, "left_semi").distinct()
    asking = _around(alone.select(F.col("id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), *cell))
    d = haversine(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon"))
    near = asking.join(p, cell).where((F.col("a") != F.col("id")) & (d <= metres)).select(F.col("a").alias("id"))
    return full.unionByName(near).distinct()


def reach_of_cells() -> bool:
    """Whether the cells within reach hold every point within the distance, and a cell's points are within it."""
    return math.hypot(_SIDE, _SIDE) < 1 and _ROWS * _SIDE > 1 and _COLUMNS * _SIDE * math.cos(math.radians(60)) > 1
