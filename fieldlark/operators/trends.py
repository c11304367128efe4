"""Trends of entities and areas, forecasts, series and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.functions.cleaning import lookup

# Health scores, thresholds of change and of levels.
UNHEALTHY, RISING, AREA_GOOD, AREA_POOR, AREA_EMPTY = 0.6, 0.05, 0.8, 0.5, 0.8


def entity_trend(df: DataFrame, key: str, order: Sequence[str], score: str) -> DataFrame:
    """(key, n, slope, unhealthy_share, trend): least-squares slope over the visit number to three places, 0 for one visit."""
    at = (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("double")
    own = df.where(F.col(score).isNotNull()).withColumn("_x", at).groupBy(key).agg(
        F.count("*").alias("n"), F.regr_slope(F.col(score).cast("double"), F.col("_x")).alias("slope"), F.avg((F.col(score) < UNHEALTHY).cast("double")).alias("unhealthy_share")
    )
    own = own.withColumn("slope", F.coalesce(F.round("slope", 3), F.lit(0.0)))
    trend = F.when(F.col("n") < 2, "insufficient").when(F.col("slope") > RISING, "improving").when(F.col("slope") < -RISING, "declining").otherwise("stable")
    return own.withColumn("trend", trend)


def area_levels(df: DataFrame, key: str, time: str, tie: str, score: str, levels: Mapping[str, str]) -> DataFrame:
    """(level, entity_id, n, mean_score, level_score, trend) from the latest score of each entity.

    The level score is a rescaled mean and not a change in time. All levels come from one pass.
    """
    latest = df.groupBy(key).agg(F.max_by(F.struct(score, *levels.values()), F.struct(time, tie)).alias("r")).select("r.*")
    each = latest.select(score, F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(c).cast("string").alias("entity_id")) for k, c in levels.items()])).alias("g"))
    own = each.groupBy("g.level", "g.entity_id").agg(F.count(score).alias("n"), F.coalesce(F.avg(score), F.lit(AREA_EMPTY)).alias("mean_score"))
    scale = F.when(F.col("level") == "zone", 0.15).otherwise(0.2)
    trend = F.when(F.col("mean_score") > AREA_GOOD, "improving").when(F.col("mean_score") < AREA_POOR, "declining").otherwise("stable")
    return own.withColumns({"level_score": (F.col("mean_score") - 0.5) * scale, "trend": trend})


def forecast(df: DataFrame, key: str, day: str, value: str, weeks: int = 4) -> DataFrame:
    """(key, week, forecast): the line through the first and last points, never below zero."""
    own = df.groupBy(key).agg(F.min(day).alias("d0"), F.max(day).alias("d1"), F.min_by(value, day).alias("v0"), F.max_by(value, day).alias("v1"))
    rate = F.coalesce((F.col("v1") - F.col("v0")) / F.nullif(F.datediff("d1", "d0") / 7, F.lit(0.0)), F.lit(0.0))
    return own.select(key, "v1", rate.alias("rate"), F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("week")).select(
        key, "week", F.greatest(F.lit(0.0), F.col("v1") + F.col("rate") * F.col("week")).alias("forecast")
    )


def series(df: DataFrame, key: str, day: str, saved: str, value: str) -> DataFrame:
    """One value for each entity and day, the last that was saved."""
    return df.groupBy(key, day).agg(F.max_by(value, saved).alias(value))


def pivot_share(df: DataFrame, rows: str, columns: str, values: Sequence, flag: str) -> DataFrame:
    """Share of flagged rows by two keys, one of them across."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.avg(F.col(flag).cast("double")))


def funnel(sets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(step, n): entities that are in the first set, in the first two, and so on."""
    out, so_far = None, None
    for name, df in sets.items():
        own = df.select(key).distinct()
        so_far = own if so_far is None else so_far.join(own, key, "left_semi")
        one = so_far.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def mapped_labels(df: DataFrame, column: str, mapping: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Label columns by a fixed mapping; an unknown label is an error."""
    known = F.col(column).isin(*mapping)
    names = list(dict.fromkeys(k for m in mapping.values() for k in m))
    checked = F.when(known | F.col(column).isNull(), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.col(column))))
    return df.withColumns({n: lookup(checked, {k: m[n] for k, m in mapping.items() if n in m}) for n in names})


def decided(df: DataFrame, key: str, probabilities: str, collapse: Mapping[str, str], actions: Mapping[str, str], threshold: float = 0.95) -> DataFrame:
    """(key, top, top_probability, collapsed, collapsed_probability, decision, action) from a map of probabilities."""
    each = df.select(key, F.explode(probabilities).alias("cls", "p"))
    each = each.withColumn("group", F.coalesce(lookup(F.col("cls"), collapse), F.col("cls")))
    top = each.groupBy(key).agg(F.max_by("cls", F.struct("p", "cls")).alias("top"), F.max("p").alias("top_probability"))
    sums = each.groupBy(key, "group").agg(F.sum("p").alias("s"))
    out = top.join(sums, key).where(F.col("group") == F.coalesce(lookup(F.col("top"), collapse), F.col("top")))
    decision = F.when(F.col("s") >= threshold, "accept").otherwise("refer")
    return out.select(key, "top", "top_probability", F.col("group").alias("collapsed"), F.col("s").alias("collapsed_probability"), decision.alias("decision"), lookup(F.col("group"), actions).alias("action"))


def valid_route(points: Column, width: float, height: float, least: int = 2, most: int = 100_000) -> Column:
    """Whether an array of (x, y) has enough points, not too many, all finite and inside the image (P25)."""
    inside = F.forall(points, lambda p: (p["x"] >= 0) & (p["x"] <= width) & (p["y"] >= 0) & (p["y"] <= height) & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    return F.coalesce(F.size(points).between(least, most) & inside, F.lit(False))
