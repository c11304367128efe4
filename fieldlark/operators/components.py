"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). A
node's neighbours are never gathered: a step takes the least neighbour by an
aggregate with map-side combining and joins it back to the edges, where Spark
splits the edges of a hub over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.operators.lineage import cut


def _sent(df: DataFrame, broadcasts: bool) -> DataFrame:
    return df if broadcasts else df.hint("merge")


def _large_star(edges: DataFrame, broadcasts: bool) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(_sent(least, broadcasts), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, broadcasts: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(_sent(least, broadcasts), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60, broadcasts: bool = True) -> DataFrame:
    """``(id, component)`` for each node of ``edges``; a component is named by its least node.

    Self-loops and nulls are ignored; no edges give an empty result. Without ``broadcasts`` no join sends rows through
    the driver, for callers that have many graphs at a time.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        f"{a} is not null and {b} is not null and u != v"
    )
    e, before = cut(e.distinct()), None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        e = cut(_small_star(_large_star(e, broadcasts).distinct(), broadcasts).distinct())
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        e.select("v", "v").distinct()
    )
