"""Position fixes: dispersion, estimators, robust centres, acceptance of sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of fixes that come without one.
UNKNOWN_ACCURACY = 999.0


def usable_fixes(df: DataFrame, x: str, y: str, accuracy: str) -> DataFrame:
    """Numeric positions; a missing or zero accuracy counts as very poor."""
    df = df.withColumns({c: F.col(c).try_cast("double") for c in (x, y, accuracy)})
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return df.withColumn(accuracy, F.coalesce(F.nullif(F.col(accuracy), F.lit(0.0)), F.lit(UNKNOWN_ACCURACY)))


def _weight(accuracy: str) -> Column:
    return 1 / F.pow(F.greatest(F.col(accuracy), F.lit(1.0)), 2)


def centres(df: DataFrame, keys: Sequence[str], x: str, y: str, accuracy: str, order: Sequence[str]) -> DataFrame:
    """First, mean, weighted and median position of each group."""
    w = _weight(accuracy)
    first = F.struct(*order)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.min_by(F.col(c), first).alias(f"raw_{c}") for c in (x, y)],
        *[F.avg(c).alias(f"mean_{c}") for c in (x, y)],
        *[(F.sum(F.col(c) * w) / F.sum(w)).alias(f"weighted_{c}") for c in (x, y)],
        *[F.median(c).alias(f"median_{c}") for c in (x, y)],
    )


def kalman(df: DataFrame, keys: Sequence[str], x: str, y: str, accuracy: str, order: Sequence[str], q: float = 0.01) -> DataFrame:
    """Position of a constant-position filter after a session's fixes in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.greatest(F.col(accuracy).cast("double"), F.lit(1.0)).alias("_r"))))
    first = F.col("_f")[0]
    start = F.struct(first["_x"].alias("x"), first["_y"].alias("y"), F.pow(first["_r"], 2).alias("p"))

    def step(s: Column, f: Column) -> Column:
        p = s["p"] + q
        gain = p / (p + F.pow(f["_r"], 2))
        return F.struct((s["x"] + gain * (f["_x"] - s["x"])).alias("x"), (s["y"] + gain * (f["_y"] - s["y"])).alias("y"), ((1 - gain) * p).alias("p"))

    out = df.groupBy(*keys).agg(rows.alias("_f")).withColumn("_s", F.aggregate(F.slice("_f", 2, F.size("_f")), start, step))
    return out.select(*keys, F.size("_f").alias("n"), F.col("_s.x").alias(f"kalman_{x}"), F.col("_s.y").alias(f"kalman_{y}"))


def dispersion(df: DataFrame, keys: Sequence[str], x: str, y: str, accuracy: str, centre: tuple[str, str] | None = None) -> DataFrame:
    """n, cep50, cep95, rms around the mean (or given centre columns), and the median accuracy."""
    w = Window.partitionBy(*keys)
    cx, cy = (F.col(centre[0]), F.col(centre[1])) if centre else (F.avg(x).over(w), F.avg(y).over(w))
    df = df.withColumn("_d", F.sqrt(F.pow(F.col(x) - cx, 2) + F.pow(F.col(y) - cy, 2)))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.percentile("_d", F.lit(0.5)).alias("cep50"),
        F.percentile("_d", F.lit(0.95)).alias("cep95"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rms"),
        F.median(accuracy).alias("median_accuracy"),
    )


def stable_position(df: DataFrame, keys: Sequence[str], x: str, y: str, accuracy: str, most: float = 10.0, least: int = 3) -> DataFrame:
    """Median position of accurate fixes without outliers, and its spread."""
    w = Window.partitionBy(*keys)
    df = df.where(F.col(accuracy) <= most)
    df = df.withColumn("_n", F.count("*").over(w))
    df = df.withColumn("_d", F.sqrt(F.pow(F.col(x) - F.median(x).over(w), 2) + F.pow(F.col(y) - F.median(y).over(w), 2)))
    df = df.withColumn("_m", F.median("_d").over(w))
    limit = F.col("_m") + 3 * F.greatest(1.4826 * F.median(F.abs(F.col("_d") - F.col("_m"))).over(w), F.lit(1.0))
    df = df.withColumn("_limit", limit).where((F.col("_n") < least) | (F.col("_d") <= F.col("_limit")))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.median(x).alias(x), F.median(y).alias(y), F.median("_d").alias("spread"))


def cross_session_errors(centres_: DataFrame, slot: str, session: str, x: str, y: str) -> DataFrame:
    """Distance between the centres of each two sessions of a slot, in both orders.

    Pairs are formed inside a slot, which has few sessions.
    """
    a, b = (centres_.select(slot, F.col(session).alias(f"{session}_{s}"), F.col(x).alias(f"x_{s}"), F.col(y).alias(f"y_{s}")) for s in "ab")
    both = a.join(b, slot).where(F.col(f"{session}_a") != F.col(f"{session}_b"))
    return both.select(slot, f"{session}_a", f"{session}_b", F.sqrt(F.pow(F.col("x_a") - F.col("x_b"), 2) + F.pow(F.col("y_a") - F.col("y_b"), 2)).alias("error"))


def error_summary(errors: DataFrame, keys: Sequence[str], column: str = "error") -> DataFrame:
    """n, median, cep95 and rms of errors."""
    return errors.groupBy(*keys).agg(
        F.count("*").alias("n"), F.median(column).alias("middle"), F.percentile(column, F.lit(0.95)).alias("cep95"), F.sqrt(F.avg(F.col(column) * F.col(column))).alias("rms")
    )


def first_k_curve(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, most: int) -> DataFrame:
    """Mean of the first k fixes of each session for k up to ``most`` (A17): a running mean, no copies of rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*keys, "k", F.avg(x).over(run).alias(x), F.avg(y).over(run).alias(y))


def combined_fix(df: DataFrame, keys: Sequence[str], x: str, y: str, accuracy: str) -> DataFrame:
    """Weighted mean of the fixes near the best accuracy, and its accuracy."""
    best = F.min(accuracy).over(Window.partitionBy(*keys))
    df = df.withColumn("_best", best).where(F.col(accuracy) <= F.greatest(2 * F.col("_best"), F.col("_best") + 2))
    w = _weight(accuracy)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.sum(F.col(x) * w) / F.sum(w)).alias(x), (F.sum(F.col(y) * w) / F.sum(w)).alias(y), F.sqrt(1 / F.sum(w)).alias("accuracy")
    )


def accepted(sessions: DataFrame, least: int = 10, most_cep95: float = 10.0, most_accuracy: float = 15.0) -> DataFrame:
    """Whether a session's dispersion is good enough, and the accuracy to store."""
    ok = (F.col("n") >= least) & (F.col("cep95") <= most_cep95) & (F.col("median_accuracy") <= most_accuracy)
    stored = F.round(F.greatest(F.col("cep95"), F.col("median_accuracy") / F.sqrt(F.col("n"))), 1)
    return sessions.withColumn("accepted", ok).withColumn("stored_accuracy", stored)


def recapture_reason(df: DataFrame, x: str, y: str, accuracy: str, most: float = 15.0) -> DataFrame:
    """Why a slot's position should be taken again, worst accuracy first."""
    shared = F.count("*").over(Window.partitionBy(x, y))
    reason = (
        F.when(F.col(x).isNull() | F.col(y).isNull(), "no position")
        .when(F.col(accuracy).isNull(), "unknown accuracy")
        .when(F.col(accuracy) > most, "poor accuracy")
        .when(shared > 1, "shared fix")
    )
    out = df.withColumn("reason", reason).where("reason is not null")
    return out.orderBy(F.desc(F.coalesce(F.col(accuracy), F.lit(1e9))))
