"""Tracks of clusters through the cycles of a run, by joins: pairs, mutual best matches, chains, and measures of each link."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.operators.components import connected_components
from fieldlark.operators.lineage import cut


def _cells(df: DataFrame, x: str, y: str, metres: float, spread: bool) -> DataFrame:
    """Cells as wide as the distance; ``spread`` puts a row into the nine cells around it."""
    df = df.withColumns({"gx": F.floor(F.col(x) / metres), "gy": F.floor(F.col(y) / metres)})
    if spread:
        around = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct((F.floor(i / 3) - 1).alias("dx"), (F.pmod(i, F.lit(3)) - 1).alias("dy")))
        df = df.withColumn("_c", F.explode(around)).withColumns({"gx": F.col("gx") + F.col("_c.dx"), "gy": F.col("gy") + F.col("_c.dy")}).drop("_c")
    return df


def one_to_one(pairs: DataFrame, group: list[str], a: str, b: str, order: list[str]) -> DataFrame:
    """The pairs that greedy assignment in ``order`` takes, each ``a`` and ``b`` of a group once.

    A pair that is the best of both its sides is taken by any greedy order; those are taken together, what shares a
    side with them goes, and so on until nothing is left. Ties go to the lesser ``a``, then the lesser ``b``.
    """
    left, out = cut(pairs.withColumn("_k", F.struct(*order, a, b))), None
    while True:
        by_a, by_b = Window.partitionBy(*group, a), Window.partitionBy(*group, b)
        best = left.withColumn("_won", (F.min("_k").over(by_a) == F.col("_k")) & (F.min("_k").over(by_b) == F.col("_k")))
        best = cut(best.withColumn("_gone", F.max("_won").over(by_a) | F.max("_won").over(by_b)))
        won = best.where("_won").select(*pairs.columns)
        out = won if out is None else out.unionAll(won)
        left = best.where("not _gone").drop("_won", "_gone")
        if left.isEmpty():
            return out


def tracks(members: DataFrame, run: str, metres: float, least_jaccard: float = 0.3, cycles: DataFrame | None = None) -> DataFrame:
    """Clusters of one cycle matched to those of the cycle before.

    ``members`` has the run's key, cycle, cluster, id, x, y in metres and onset; ``cycles`` (run, cycle) names all cycles
    that were looked at, where some may have no cluster; without it those with members.

    Two clusters of neighbouring cycles may match if they share ``least_jaccard`` of their members or their centres
    are at most ``metres`` apart; the most shared goes first, then the nearest, then the lesser cluster. Matches of all
    cycles are found at once, as a match does not depend on names. A chain of matches is a track; a run's tracks are
    numbered in the order in which they begin. ``added`` counts members that the one before had not, ``adjacent`` is the
    share of these within ``metres`` of one of its members, ``shift_m`` the way of the centre, ``net_growth`` the change
    since the first cycle, ``adjacent_total`` the share over all cycles with at least two added, ``onset_spread`` the
    deviation of the members' onset. Of a new cluster nothing counts as added; one that is not found again is
    resolved once.
    """
    every = (cycles or members).select(run, "cycle").distinct()
    seen = Window.partitionBy(run).orderBy("cycle")
    every = every.withColumns({"before": F.lag("cycle").over(seen), "after": F.lead("cycle").over(seen)})
    own = cut(members.select(run, "cycle", "cluster", "id", "x", "y", "onset").join(every, [run, "cycle"]))
    shapes = own.groupBy(run, "cycle", "before", "after", "cluster").agg(F.count("*").cast("int").alias("size"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.stddev_pop("onset").alias("onset_spread"))
    shapes = cut(shapes)
    old_shapes = shapes.select(run, F.col("cycle").alias("before"), F.col("cluster").alias("old"), F.col("size").alias("old_size"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    old = own.select(run, F.col("cycle").alias("before"), F.col("cluster").alias("old"), "id", F.col("x").alias("ox"), F.col("y").alias("oy"))

    shared = own.join(old, [run, "before", "id"]).groupBy(run, "cycle", "cluster", "old").agg(F.count("*").alias("shared"))
    close = _cells(shapes, "cx", "cy", metres, False).join(_cells(old_shapes, "ox", "oy", metres, True), [run, "before", "gx", "gy"])
    close = close.where(F.hypot(F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy")) <= metres).select(run, "cycle", "cluster", "old", F.lit(0).cast("long").alias("shared"))
    pairs = shared.unionByName(close).groupBy(run, "cycle", "cluster", "old").agg(F.max("shared").alias("shared"))
    pairs = pairs.join(shapes, [run, "cycle", "cluster"]).join(old_shapes, [run, "before", "old"])
    pairs = pairs.withColumns({"jaccard": F.col("shared") / (F.col("size") + F.col("old_size") - F.col("shared")), "shift_m": F.hypot(F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy"))})
    pairs = pairs.where((F.col("jaccard") >= least_jaccard) | (F.col("shift_m") <= metres)).withColumn("_less", -F.col("jaccard"))
    links = cut(one_to_one(pairs.select(run, "cycle", "before", "cluster", "old", "old_size", "shift_m", "_less"), [run, "cycle"], "cluster", "old", ["_less", "shift_m"]).drop("_less"))

    node = lambda c, k: F.struct(F.col(run).alias("run"), F.col(c).alias("cycle"), F.col(k).alias("cluster"))
    chain = connected_components(links.select(node("cycle", "cluster").alias("a"), node("before", "old").alias("b")), "a", "b")
    named = shapes.withColumn("id", node("cycle", "cluster")).join(chain, "id", "left").withColumn("root", F.coalesce("component", "id")).drop("id", "component")
    roots = named.select(run, "root").distinct().withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy("root")))
    named = named.join(roots.select("root", F.concat(F.lit("H"), F.lpad(F.col("_n").cast("string"), F.greatest(F.lit(3), F.length(F.col("_n").cast("string"))), F.lit("0"))).alias("hotspot_id")), "root")

    linked = own.join(links.select(run, "cycle", "cluster", "old"), [run, "cycle", "cluster"])
    added = cut(linked.join(old.select(run, "before", "old", "id"), [run, "before", "old", "id"], "left_anti"))
    near = _cells(added, "x", "y", metres, False).join(_cells(old.drop("id"), "ox", "oy", metres, True), [run, "before", "old", "gx", "gy"])
    near = near.where(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= metres).select(run, "cycle", "cluster", "id").distinct().withColumn("_near", F.lit(1))
    grown = added.join(near, [run, "cycle", "cluster", "id"], "left").groupBy(run, "cycle", "cluster").agg(F.count("*").cast("int").alias("added"), F.count("_near").alias("_near"))

    way = Window.partitionBy(run, "hotspot_id").orderBy("cycle")
    so_far = way.rowsBetween(Window.unboundedPreceding, 0)
    full = named.join(links.select(run, "cycle", "cluster", "old_size", "shift_m"), [run, "cycle", "cluster"], "left").join(grown, [run, "cycle", "cluster"], "left").na.fill(0, ["added", "_near"])
    full = full.withColumns({"_added": F.sum("added").over(so_far), "_nears": F.sum("_near").over(so_far), "_first": F.first("size").over(way), "_from": F.first("cycle").over(way), "_again": F.lead("cycle").over(way)})
    status = F.when(F.col("old_size").isNull(), "new").when(F.col("size") > F.col("old_size"), "expanding").when(F.col("size") < F.col("old_size"), "shrinking").otherwise("persistent")
    share = lambda part, whole, least: F.when(whole >= least, part / whole)
    rows = full.select(
        run, "cycle", "hotspot_id", status.alias("status"), "size", "added", share(F.col("_near"), F.col("added"), 1).alias("adjacent"), "shift_m", (F.col("size") - F.col("_first")).alias("net_growth"),
        share(F.col("_nears"), F.col("_added"), 2).alias("adjacent_total"), "onset_spread", (F.col("cycle") - F.col("_from") + 1).alias("persistence"),
    )
    none = F.lit(None).cast("double")
    ended = full.where("_again is null and after is not null").select(
        run, F.col("after").alias("cycle"), "hotspot_id", F.lit("resolved").alias("status"), F.lit(0).alias("size"), F.lit(0).alias("added"), none.alias("adjacent"), none.alias("shift_m"), F.lit(None).cast("int").alias("net_growth"),
        none.alias("adjacent_total"), none.alias("onset_spread"), (F.col("after") - F.col("_from")).alias("persistence"),
    )
    return rows.unionByName(ended)
