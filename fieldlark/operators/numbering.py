"""Numbers for the rows of groups that may be large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt(df: DataFrame, groups: Sequence[str], draw: Column, key: str, bucket_rows: int = 50_000, number: str = "_n", size: str = "_size") -> DataFrame:
    """``number`` from 1 of each row in its group, in the order of ``draw``, a hash, and the group's ``size``.

    A group's rows are cut into ranges of the hash of a bounded size. Rows are numbered inside a range, and counts of
    the ranges before, a few for each group, are added; so no task holds a group. Group values must not be null.
    """
    ranges = max(1, df.count() // bucket_rows)
    df = df.withColumn("_h", draw).withColumn("_r", F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * ranges))
    counts = df.groupBy(*groups, "_r").agg(F.count("*").alias("_k"))
    own = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_k").over(own.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"_before": before, size: F.sum("_k").over(own)}).drop("_k")
    inside = F.row_number().over(Window.partitionBy(*groups, "_r").orderBy("_h", key))
    out = df.withColumn("_i", inside).join(counts, [*groups, "_r"])
    return out.withColumn(number, F.col("_i") + F.col("_before")).drop("_h", "_r", "_i", "_before")
