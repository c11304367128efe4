"""Tails of the normal and the t distribution as column expressions, by series and continued fractions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= z) for z >= 0, to about 1e-13: a power series below 3, a continued fraction beyond."""
    x = z.cast("double") / math.sqrt(2)
    small = F.least(x, F.lit(2.2))
    term = lambda s, n: F.struct((-s["t"] * small * small / n).alias("t"), (s["sum"] + -s["t"] * small * small / n / (2 * n + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(small.alias("t"), small.alias("sum")), term)["sum"]
    large = F.greatest(x, F.lit(2.1))
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), large, lambda s, k: large + (k / 2) / s)
    return F.when(x < 2.12, 1 - 2 / math.sqrt(math.pi) * series).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / fraction)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= t) for t >= 0 and whole degrees of freedom, by the finite sums over powers of a cosine (Abramowitz and Stegun 26.7.3, 26.7.4)."""
    t, df = t.cast("double"), df.cast("int")
    angle = F.atan(t / F.sqrt(df.cast("double")))
    c, s = F.cos(angle), F.sin(angle)
    odd = df % 2 == 1
    n = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    first = F.when(odd, c).otherwise(F.lit(1.0))
    step = lambda a, k: F.struct((a["t"] * c * c * F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))).alias("t"), (a["sum"] + a["t"]).alias("sum"))
    steps = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.struct(first.alias("t"), F.lit(0.0).alias("sum")), step)["sum"]
    inside = F.when(odd, 2 / math.pi * (angle + s * total)).otherwise(s * total)
    return F.greatest(F.lit(0.0), 1 - inside)


def t_quantile(df: Column, tail: float, steps: int = 60) -> Column:
    """The t that ``tail`` lies beyond on both sides together, by halving an interval of its logarithm."""
    halve = lambda b, _: F.when(t_two_sided(F.exp((b["lo"] + b["hi"]) / 2), df) > tail, F.struct(((b["lo"] + b["hi"]) / 2).alias("lo"), b["hi"].alias("hi"))).otherwise(F.struct(b["lo"].alias("lo"), ((b["lo"] + b["hi"]) / 2).alias("hi")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(-12.0).alias("lo"), F.lit(12.0).alias("hi")), halve)
    return F.exp((found["lo"] + found["hi"]) / 2)
