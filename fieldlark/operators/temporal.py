"""Per-entity temporal features, cycles, robust deviations and anomaly flags.

Windows are partitioned by entity, whose history is bounded by the visits it had;
statistics over all rows are aggregates joined back.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.operators.cleaning import keep_latest
from fieldlark.operators.evaluate import quantile
from fieldlark.operators.lineage import cut


def cycle(day: Column, start: Column, freq: str = "W") -> Column:
    """Weeks or months since the start, also before it (F16)."""
    if freq == "W":
        return F.floor(F.datediff(day, start) / 7).cast("int")
    return ((F.year(day) - F.year(start)) * 12 + F.month(day) - F.month(start)).cast("int")


def latest_per_cycle(df: DataFrame, key: str, time: str, tie: str, start: str, freq: str = "W") -> DataFrame:
    """The last record of each entity in each cycle (A3)."""
    df = df.withColumn("cycle", cycle(F.col(time), F.to_date(F.lit(start)), freq))
    return keep_latest(df, [key, "cycle"], [F.desc_nulls_last(time), F.desc(tie)])


def lag_features(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], roll: int = 3) -> DataFrame:
    """``_prev`` (itself in the first row), ``_delta`` and ``_roll`` of each column."""
    w = Window.partitionBy(key).orderBy(*order)
    new = {}
    for c in columns:
        new[f"{c}_prev"] = F.coalesce(F.lag(c).over(w), F.col(c))
        new[f"{c}_delta"] = F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c))
        new[f"{c}_roll"] = F.avg(c).over(w.rowsBetween(1 - roll, 0))
    return df.withColumns(new)


def weekly_growth(df: DataFrame, key: str, day: str, tie: str, height: str) -> DataFrame:
    """Change in a week since the visit before; 0 where it is not known."""
    w = Window.partitionBy(key).orderBy(day, tie)
    weeks = F.nullif(F.datediff(F.col(day), F.lag(day).over(w)), F.lit(0)) / 7
    return df.withColumn("growth_wk", F.coalesce((F.col(height) - F.lag(height).over(w)) / weeks, F.lit(0.0)))


def ewm(df: DataFrame, key: str, order: Sequence[str], column: str, alpha: float = 0.4, name: str = "ewm") -> DataFrame:
    """Exponentially weighted mean of an entity's values so far, weights adding up to one (W5); a null leaves its place empty.

    Running sums of values scaled up by their place, in blocks of places short enough for a double. What the
    block before has added up to is carried over; blocks before that one weigh under 1e-200.
    """
    q = 1 - alpha
    size = max(1, int(200 / -math.log10(q))) if q > 0 else 1
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    df = df.withColumn("_i", place).withColumns({"_b": F.floor(F.col("_i") / size), "_p": F.pmod("_i", F.lit(size))})
    block = Window.partitionBy(key, "_b")
    so_far, before = block.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key).orderBy("_b").rangeBetween(-1, -1)
    v, up = F.col(column).cast("double"), F.pow(F.lit(1 / q if q > 0 else 1.0), F.col("_p"))
    parts = {"_n": v * up, "_d": F.when(v.isNotNull(), up)}
    df = df.withColumns(parts)
    df = df.withColumns({f"{c}_run": F.sum(c).over(so_far) for c in parts} | {f"{c}_all": F.sum(c).over(block) for c in parts})
    df = df.withColumns({f"{c}_old": F.max(f"{c}_all").over(before) for c in parts})
    total = lambda c: F.coalesce(F.col(f"{c}_run"), F.lit(0.0)) + F.coalesce(F.col(f"{c}_old"), F.lit(0.0)) * F.pow(F.lit(q), F.lit(size))
    return df.withColumn(name, total("_n") / F.nullif(total("_d"), F.lit(0.0))).drop("_i", "_b", "_p", *[f"{c}{x}" for c in parts for x in ("", "_run", "_all", "_old")])


def self_deviation(df: DataFrame, key: str, order: Sequence[str], column: str, history: int = 4, least: int = 2, name: str = "self_dev") -> DataFrame:
    """Deviation from the median of the entity's rows before, if enough of them are known."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-history, -1)
    return df.withColumn(name, F.when(F.count(column).over(w) >= least, F.col(column) - F.percentile(column, F.lit(0.5)).over(w)))


def peer_group(df: DataFrame, block: str, zone: str, cycle_: str = "cycle", least: int = 8) -> DataFrame:
    """The block where it has enough others in the cycle, else the zone."""
    others = F.count("*").over(Window.partitionBy(block, cycle_)) - 1
    return df.withColumn(
        "peer_group", F.when(others >= least, F.concat(F.lit("b"), F.col(block).cast("string"))).otherwise(F.concat(F.lit("z"), F.col(zone).cast("string")))
    )


def peer_deviation(df: DataFrame, group: Sequence[str], column: str, least: int = 4, name: str = "peer_dev") -> DataFrame:
    """Deviation from the median of the other rows of the group, by rank and not by pairs.

    Without one value, the median of n - 1 values in order is one or two values next to the middle,
    so three order statistics of the group are enough for each of its rows. Groups with missing
    values count only those that are known; ``least`` counts all rows.
    """
    w = Window.partitionBy(*group)
    df = df.withColumn("_rows", F.count("*").over(w)).withColumn("_n", F.count(column).over(w))
    df = df.withColumn("_k", F.when(F.col(column).isNotNull(), F.row_number().over(w.orderBy(F.asc_nulls_last(column)))))
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col(column))).over(w)
    half = F.floor(F.col("_n") / 2)
    df = df.withColumns({"_a": at(half), "_b": at(half + 1), "_c": at(half + 2)})
    # Without a known own value: the median of all n. Else of the n - 1 others.
    full = F.when(F.col("_n") % 2 == 1, F.col("_b")).otherwise((F.col("_a") + F.col("_b")) / 2)
    odd = F.when(F.col("_k") <= half, (F.col("_b") + F.col("_c")) / 2).when(F.col("_k") == half + 1, (F.col("_a") + F.col("_c")) / 2).otherwise((F.col("_a") + F.col("_b")) / 2)
    even = F.when(F.col("_k") <= half, F.col("_b")).otherwise(F.col("_a"))
    middle = F.when(F.col("_k").isNull(), full).when(F.col("_n") % 2 == 1, odd).otherwise(even)
    out = F.when((F.col("_rows") >= least) & (F.col("_n") > 1), F.col(column) - middle)
    return df.withColumn(name, out).drop("_rows", "_n", "_k", "_a", "_b", "_c")


def robust_scale(df: DataFrame, column: str, floor: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, scale): 1.4826 times the median absolute value, at least the floor."""
    return df.groupBy(*by).agg(F.greatest(1.4826 * F.median(F.abs(F.col(column))), F.lit(floor)).alias("scale"))


def robust_z(df: DataFrame, column: str, floor: float, by: Sequence[str] = (), name: str = "z") -> DataFrame:
    scale = robust_scale(df, column, floor, by)
    out = df.join(scale, list(by)) if by else df.crossJoin(F.broadcast(scale))
    return out.withColumn(name, F.col(column) / F.col("scale")).drop("scale")


def worsened(df: DataFrame, key: str, order: Sequence[str], level: str) -> DataFrame:
    """The level before, and whether it has risen."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(level).over(w)
    return df.withColumn("level_prev", before).withColumn("worse", F.coalesce(F.col(level) > before, F.lit(False)))


def rule_flags(df: DataFrame, scores: Sequence[str], limit: float = 3.0, only_falls: Sequence[str] = (), extra: Mapping[str, Column] | None = None) -> DataFrame:
    """``reasons`` and ``rule_flag``: robust scores beyond the limit, and further named conditions (U4)."""
    hits = [F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in (extra or {}).items()]
    for c in scores:
        beyond = (F.col(c) < -limit) if c in only_falls else (F.abs(F.col(c)) > limit)
        hits.append(F.when(F.coalesce(beyond, F.lit(False)), F.lit(c)))
    return df.withColumn("reasons", F.array_compact(F.array(*hits))).withColumn("rule_flag", F.size("reasons") > 0)


def run_onsets(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """The first cycle of the run of flags that a row is in, null outside runs."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_island", F.sum((~F.col(flag)).cast("int")).over(w))
    onset = F.min(F.when(F.col(flag), F.col(order))).over(Window.partitionBy(key, "_island"))
    return df.withColumn("onset", F.when(F.col(flag), onset)).drop("_island")


def _path(n: np.ndarray) -> np.ndarray:
    """Mean length of a search in a tree of n points."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    if depth == 0 or len(x) < 2 or (spread := x.max(axis=0) - x.min(axis=0)).max() == 0:
        return (len(x),)
    f = rng.choice(np.flatnonzero(spread))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    left = x[:, f] < cut
    return f, cut, _grow(x[left], rng, depth - 1), _grow(x[~left], rng, depth - 1)


def _depths(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), float(_path(np.array([tree[0]]))[0]))
    f, cut, a, b = tree
    left, out = x[:, f] < cut, np.empty(len(x))
    out[left], out[~left] = _depths(a, x[left]), _depths(b, x[~left])
    return out + 1


def isolation_scores(df: DataFrame, features: Sequence[str], trees: int = 300, sample: int = 256, seed: int = 0, clip: float = 20.0) -> DataFrame:
    """``iso_score`` of an isolation forest (M1): trees grow as tasks on samples of a bounded size, rows are scored in batches.

    Each tree sees ``sample`` rows on average, as the method asks; missing features are 0.
    """
    x = df.select(*[F.least(F.lit(clip), F.greatest(F.lit(-clip), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))).alias(c) for c in features])
    n = max(1, df.count())
    # Small rows that cost much: dealt out by number, as a file of many rows may be one task. Their numbers are those of the file.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = x.withColumn("_row", F.monotonically_increasing_id()).repartition(tasks)
    picks = F.filter(F.sequence(F.lit(1), F.lit(trees)), lambda t: F.pmod(F.xxhash64("_row", t, F.lit(seed)), F.lit(1_000_003)) < int(min(1.0, sample / n) * 1_000_003))
    drawn = own.select(F.explode(picks).alias("tree"), *features)

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        import pickle

        t = int(g.tree.iloc[0])
        return pd.DataFrame({"tree": [t], "model": [pickle.dumps(_grow(g[list(features)].to_numpy(), np.random.default_rng((seed, t)), 8))]})

    # trees times a few hundred nodes, whatever the number of rows
    grown = [r["model"] for r in drawn.groupBy("tree").applyInPandas(grow, "tree int, model binary").collect()]

    def score(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        forest = [pickle.loads(m) for m in grown]
        for f in frames:
            own = f[list(features)].astype(float).fillna(0).clip(-clip, clip).to_numpy()
            mean = np.mean([_depths(t, own) for t in forest], axis=0) if forest and len(f) else np.zeros(len(f))
            yield f.assign(iso_score=2.0 ** (-mean / max(float(_path(np.array([min(sample, n)]))[0]), 1e-9)))

    return df.repartition(tasks).mapInPandas(score, df.select("*", F.lit(0.0).alias("iso_score")).schema)


def isolation_flags(df: DataFrame, features: Sequence[str], contamination: float = 0.15, **kwargs) -> DataFrame:
    """``iso_flag`` for the given share of rows with the highest scores."""
    scored = cut(isolation_scores(df, features, **kwargs))
    limit = quantile(scored, "iso_score", 1 - contamination, "_limit")
    return scored.crossJoin(F.broadcast(limit)).withColumn("iso_flag", F.col("iso_score") > F.col("_limit")).drop("_limit")
