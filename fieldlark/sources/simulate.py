"""Simulated layouts, fixes and planted hotspots, from hashes, so that each run gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    return (F.pmod(F.xxhash64(*keys), F.lit(2**40)) + 0.5) / 2**40


def normal(*keys: Column) -> Column:
    """A standard normal number, by the Box-Muller formula."""
    return F.sqrt(-2 * F.log(uniform(*keys, F.lit("r")))) * F.cos(2 * math.pi * uniform(*keys, F.lit("t")))


def layout(ids: DataFrame, plants: int, spacing: float = 2.5) -> DataFrame:
    """(plant, block, x, y) of blocks side by side, plants in square rows, by numbers from 0 in the column ``id``."""
    side = math.ceil(math.sqrt(plants))
    df = ids.select(F.col("id").cast("long").alias("id")).withColumn("block", F.floor(F.col("id") / plants)).withColumn("k", F.pmod("id", F.lit(plants)))
    x = F.col("block") * (side + 2) * spacing + F.pmod("k", F.lit(side)) * spacing
    return df.select(F.col("id").alias("plant"), "block", x.cast("double").alias("x"), (F.floor(F.col("k") / side) * spacing).cast("double").alias("y"))


def noisy_fixes(plants: DataFrame, n: int, sigma: float, seed: int = 0) -> DataFrame:
    """(plant, fix, x, y, accuracy): repeated fixes around a position."""
    each = plants.withColumn("fix", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    key = [F.col("plant"), F.col("fix"), F.lit(seed)]
    return each.select("plant", "fix", (F.col("x") + sigma * normal(*key, F.lit("x"))).alias("x"), (F.col("y") + sigma * normal(*key, F.lit("y"))).alias("y"), (3 + 9 * uniform(*key, F.lit("a"))).alias("accuracy"))


def planted_hotspots(plants: DataFrame, cycles: int, radius: float, spread: float = 0.3, seed: int = 0, share: float = 0.8, start: DataFrame | None = None) -> DataFrame:
    """(plant, cycle): plants of a growing disease focus.

    The focus begins at ``start``, a row like those of ``plants``, or at a plant drawn by hash; ``share`` of the plants can fall ill.
    A plant falls ill in the first cycle in which its own draw beats the chance that distance to the
    seed plant leaves, so the spread needs no loop over cycles.
    """
    first = plants.orderBy(F.xxhash64("plant", F.lit(seed)), "plant").limit(1) if start is None else start
    start = first.select(F.col("x").alias("sx"), F.col("y").alias("sy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2))
    near = plants.crossJoin(F.broadcast(start)).withColumn("d", d).withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    reached = F.col("d") <= radius * (1 + F.col("cycle") * spread)
    return near.where(reached & ((F.col("d") == 0) | (uniform(F.col("plant"), F.lit(seed)) < share))).select("plant", "cycle")
