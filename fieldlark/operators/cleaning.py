"""Cleaning, imputation and audits of inspection records.

All functions take and return DataFrames. Columns that name the entity, the block
and the date are parameters; nothing reads the clock.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.functions.cleaning import is_number, plant_id, pseudo_null
from fieldlark.operators.evaluate import quantile


def normalize_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Texts that stand for a missing value to null, in all text columns."""
    names = columns or [n for n, t in df.dtypes if t == "string"]
    return df.withColumns({n: pseudo_null(F.col(n)) for n in names})


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def clean_ids(df: DataFrame, column: str = "plant_id") -> DataFrame:
    """Standard ids; rows whose id cannot be read are dropped."""
    return df.withColumn(column, plant_id(F.col(column))).where(F.col(column).isNotNull())


def apply_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values outside their range to null."""
    return df.withColumns({c: F.when(F.col(c).between(*r), F.col(c)) for c, r in ranges.items()})


def range_log(df: DataFrame, key: Sequence[str], ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(key, column, value) of each value outside its range, in one pass."""
    found = [F.when(~F.col(c).between(*r), F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("bad_value"))) for c, r in ranges.items()]
    return df.select(*key, F.explode(F.array_compact(F.array(*found))).alias("e")).select(*key, "e.column_name", "e.bad_value")


def default_form_values(df: DataFrame, ph: str, others: Sequence[str], default: float = 6.2) -> DataFrame:
    """A pH that is a form's default while all other readings are missing is missing too."""
    empty = F.lit(True)
    for c in others:
        empty = empty & F.col(c).isNull()
    return df.withColumn(ph, F.when((F.col(ph) == default) & empty, None).otherwise(F.col(ph)))


def with_group_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], prefix: str) -> DataFrame:
    """Medians of each group as columns: aggregates with map-side combining, joined back; rows of a group are never gathered."""
    own = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*[F.median(c).alias(f"{prefix}{c}") for c in columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(own, same).drop(*[f"_k_{k}" for k in keys])


def daily_outliers(df: DataFrame, day: str, limits: Mapping[str, float]) -> DataFrame:
    """Values too far from the median of their day to null (P10)."""
    df = with_group_medians(df, [day], list(limits), "_m_")
    return df.withColumns({c: F.when(F.abs(F.col(c) - F.col(f"_m_{c}")) <= limit, F.col(c)) for c, limit in limits.items()}).drop(*[f"_m_{c}" for c in limits])


def theil_sen(df: DataFrame, key: str, x: str, y: str, least: int = 4) -> DataFrame:
    """(key, n, slope, intercept) of each entity with enough points: medians of pairwise slopes.

    Pairs are formed inside an entity, whose visits are few; the result is a row for each entity.
    """
    points = df.where(F.col(y).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    points = points.where(F.size("p") >= least)
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.filter("p", lambda b, j: (j > i) & (b["x"] != a["x"])), lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"]))))
    slopes = points.select(key, F.size("p").alias("n"), "p", F.explode(pairs).alias("s"))
    fit = slopes.groupBy(key, "n").agg(F.median("s").alias("slope"), F.first("p").alias("p"))
    middle = fit.select(key, "n", "slope", F.explode("p").alias("q")).groupBy(key, "n", "slope").agg(F.median("q.x").alias("mx"), F.median("q.y").alias("my"))
    return middle.select(key, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def height_outliers(df: DataFrame, key: str, x: str, y: str, least: int = 4, floor: float = 25.0) -> DataFrame:
    """``y`` to null where it is off its entity's Theil-Sen line by more than max(floor, 4 robust deviations)."""
    w = Window.partitionBy(key)
    out = df.join(theil_sen(df, key, x, y, least).drop("n"), key, "left")
    out = out.withColumn("_r", F.col(y) - (F.col("slope") * F.col(x).cast("double") + F.col("intercept")))
    out = out.withColumn("_d", F.abs(F.col("_r") - F.median("_r").over(w)))
    limit = F.greatest(F.lit(floor), 4 * 1.4826 * F.median("_d").over(w))
    return out.withColumn(y, F.when(F.col("slope").isNull() | (F.abs("_r") <= limit), F.col(y))).drop("_r", "_d", "slope", "intercept")


def interpolated(df: DataFrame, key: str, day: str, column: str) -> DataFrame:
    """Missing values by time between the neighbours of the same entity, at the ends by the nearest."""
    before = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(day).rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col(column).isNotNull(), F.struct(F.col(day).alias("t"), F.col(column).alias("v")))
    df = df.withColumn("_a", F.last(point, ignorenulls=True).over(before)).withColumn("_b", F.first(point, ignorenulls=True).over(after))
    share = F.datediff(F.col(day), F.col("_a.t")) / F.nullif(F.datediff(F.col("_b.t"), F.col("_a.t")), F.lit(0))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share
    return df.withColumn(column, F.coalesce(F.col(column), line, F.col("_a.v"), F.col("_b.v"))).drop("_a", "_b")


def median_filled(df: DataFrame, column: str, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Missing values by the median of ever wider groups, each taken after the fills before it (W12, E3); no group is all rows."""
    for keys in levels:
        if keys:
            df = with_group_medians(df, keys, [column], "_m_")
            df = df.withColumn(column, F.coalesce(column, f"_m_{column}")).drop(f"_m_{column}")
        else:
            df = globally_filled(df, [column]).drop(f"{column}_imputed")
    return df


def globally_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values by the column's median over all rows, with ``<column>_imputed`` flags."""
    out = df.withColumns({f"{c}_imputed": F.col(c).isNull() for c in columns})
    for c in columns:
        out = out.crossJoin(F.broadcast(quantile(df, c, 0.5, f"_m_{c}")))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def rounded_readings(df: DataFrame, places: Mapping[str, int], clip: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Half-even rounding and clipping after imputation."""
    df = df.withColumns({c: F.bround(F.col(c), n) for c, n in places.items()})
    return df.withColumns({c: F.greatest(F.lit(a), F.least(F.lit(b), F.col(c))) for c, (a, b) in (clip or {}).items()})


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_missing, low, middle, high) of numeric columns (A5)."""
    out = None
    for c in columns:
        one = df.agg(F.count_if(F.col(c).isNull()).alias("n_missing"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"))
        one = one.crossJoin(quantile(df, c, 0.5, "middle")).select(F.lit(c).alias("column_name"), "n_missing", "low", "middle", "high")
        out = one if out is None else out.unionAll(one)
    return out


def text_audit(df: DataFrame, id_column: str, date_column: str, number_column: str) -> DataFrame:
    """Counts of defects in text columns: ids, dates, numbers, spellings."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(plant_id(F.col(id_column)).isNull()).alias("bad_ids"),
        F.count_if(~F.coalesce(F.col(date_column).rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False))).alias("non_iso_dates"),
        F.count_if(~is_number(F.col(number_column))).alias("non_numeric"),
        F.count_distinct(F.col(id_column)).alias("spellings"),
    )


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that come more than once, and how often (A5)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fails on missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
