"""Evaluation of classifiers, rankings and experiments.

Curves need an order over all rows. They are computed on distinct scores with
counts, so tied rows are one row; running sums are taken inside ranges of scores,
and only the ranges' totals, one row for a partition, are summed in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.functions.probability import normal_two_sided, t_quantile, t_two_sided
from fieldlark.operators.lineage import cut


def running_sums(df: DataFrame, order: str, columns: Sequence[str], descending: bool = False) -> DataFrame:
    """``run_<column>``: sums of all rows up to a row in an order of distinct values, and ``next``, the value after it.

    Rows are dealt by ranges of the order and materialised; sums inside a range are added to those of the ranges before.
    """
    key = F.desc(order) if descending else F.asc(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, key).withColumn("_range", F.spark_partition_id()))
    first = F.max(order) if descending else F.min(order)
    totals = ranged.groupBy("_range").agg(first.alias("_first"), *[F.sum(c).alias(f"_t_{c}") for c in columns])
    w = Window.orderBy("_range")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.lead("_first").over(w).alias("_after"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns])
    inside = Window.partitionBy("_range").orderBy(key)
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({f"_i_{c}": F.sum(c).over(run) for c in columns} | {"_lead": F.lead(order).over(inside)}).join(totals, "_range")
    return out.select(*df.columns, F.coalesce("_lead", "_after").alias("next"), *[(F.col(f"_i_{c}") + F.col(f"_b_{c}")).alias(f"run_{c}") for c in columns])


def quantile(df: DataFrame, column: str, share: float, name: str = "q") -> DataFrame:
    """The exact quantile of a column over all rows, between neighbours by proportion: one row.

    Distinct values and their counts stand for the rows, and no task holds all of them.
    """
    own = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    run = running_sums(own, "v", ["n"])
    at = run.crossJoin(F.broadcast(run.agg(((F.sum("n") - 1) * share).alias("p"))))
    value = lambda i: F.min(F.when(F.col("run_n") > F.floor(F.col("p")) + i, F.col("v")))
    ends = at.agg(value(0).alias("a"), value(1).alias("b"), F.first("p").alias("p"))
    return ends.select((F.col("a") + (F.coalesce("b", "a") - F.col("a")) * (F.col("p") - F.floor("p"))).alias(name))


def confusion(df: DataFrame, truth: str, predicted: str, classes: Sequence) -> DataFrame:
    """Counts with a row for each class and fixed columns, zero where there is none."""
    every = df.sparkSession.createDataFrame([(c,) for c in classes], df.select(F.col(truth).alias("truth")).schema)
    table = df.groupBy(F.col(truth).alias("truth")).agg(*[F.count_if(F.col(predicted) == c).alias(f"as_{c}") for c in classes])
    return F.broadcast(every).join(table, "truth", "left").na.fill(0)


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support) (M8)."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    rows = pairs.select(F.explode(F.array_distinct(F.array("t", "p"))).alias("class"), "t", "p", "n")
    own = rows.groupBy("class").agg(
        F.sum(F.when((F.col("t") == F.col("class")) & (F.col("p") == F.col("class")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("p") == F.col("class"), F.col("n")).otherwise(0)).alias("n_p"),
        F.sum(F.when(F.col("t") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return own.select(
        "class", ratio(F.col("tp"), F.col("n_p")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("n_p") + F.col("support")).alias("f1"), "support",
    )


def overall_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy, balanced_accuracy, macro_f1, weighted_f1, kappa: one row (M8)."""
    own = class_metrics(df, truth, predicted)
    by = own.agg(
        F.sum(F.when(F.col("support") > 0, F.col("recall"))).alias("r"), F.count_if(F.col("support") > 0).alias("k"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )
    total = df.agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
    side = lambda c: df.groupBy(F.col(c).alias("class")).agg(F.count("*").alias(f"n_{c}"))
    chance = side(truth).join(side(predicted), "class").agg(F.sum(F.col(f"n_{truth}").cast("double") * F.col(f"n_{predicted}")).alias("e"))
    one = total.crossJoin(by).crossJoin(chance)
    e = F.coalesce("e", F.lit(0.0)) / (F.col("n") * F.col("n"))
    return one.select("accuracy", (F.col("r") / F.col("k")).alias("balanced_accuracy"), "macro_f1", "weighted_f1", ((F.col("accuracy") - e) / F.nullif(1 - e, F.lit(0.0))).alias("kappa"))


def binary_metrics(df: DataFrame, label: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """n, accuracy, precision, recall, brier, log_loss (clipped): one row (M9)."""
    y, p = F.col(label).cast("double"), F.col(probability)
    hit, clip = (p >= threshold).cast("double"), F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return df.agg(
        F.count("*").alias("n"), F.avg((hit == y).cast("double")).alias("accuracy"), (F.sum(hit * y) / F.greatest(F.sum(hit), F.lit(1.0))).alias("precision"),
        (F.sum(hit * y) / F.greatest(F.sum(y), F.lit(1.0))).alias("recall"), F.avg(F.pow(p - y, 2)).alias("brier"), (-F.avg(y * F.log(clip) + (1 - y) * F.log(1 - clip))).alias("log_loss"),
    )


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, n, pos): rows and positives of each distinct score."""
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks, one row."""
    ranked = running_sums(_by_score(df, label, score), "score", ["n"]).withColumn("rank", F.col("run_n") - (F.col("n") - 1) / 2)
    p, n = F.sum("pos"), F.sum("n")
    return ranked.agg(((F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2) / F.nullif(p * (n - p), F.lit(0))).alias("auc"), n.alias("n"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the precision-recall steps, one row (M9)."""
    at = running_sums(_by_score(df, label, score), "score", ["n", "pos"], True).withColumn("precision", F.col("run_pos") / F.col("run_n"))
    return at.agg((F.sum(F.col("precision") * F.col("pos")) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def risk_coverage(df: DataFrame, wrong: str, score: str) -> DataFrame:
    """(score, coverage, risk, area) from the surest score down; ``area`` is the trapezoid before a point."""
    own = _by_score(df, wrong, score)
    total = F.broadcast(own.agg(F.sum("n").alias("total")))
    out = running_sums(own, "score", ["n", "pos"], True).crossJoin(total)
    seen, bad = F.col("run_n"), F.col("run_pos")
    before = F.when(seen > F.col("n"), (bad - F.col("pos")) / (seen - F.col("n")))
    return out.select("score", (seen / F.col("total")).alias("coverage"), (bad / seen).alias("risk"), (F.col("n") / F.col("total") * (bad / seen + before) / 2).alias("area"))


def aurc(curve: DataFrame) -> DataFrame:
    """Area under the risk-coverage curve by trapezoids, and the risk at half and 70 % coverage."""
    at = lambda c: F.max_by("risk", F.when(F.col("coverage") <= c, F.col("coverage")))
    return curve.agg(F.sum("area").alias("aurc"), at(0.5).alias("risk50"), at(0.7).alias("risk70"))


def best_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """The first threshold of the greatest macro-F1; a row is positive if its score is above it (M10). One row.

    Thresholds are the middles between neighbouring scores and one beyond each end.
    """
    own = _by_score(df, label, score)
    total = own.agg(F.sum("n").alias("total"), F.sum("pos").alias("positives"))
    at = running_sums(own, "score", ["n", "pos"]).select(
        F.coalesce((F.col("score") + F.col("next")) / 2, F.col("score") + 1).alias("threshold"), F.col("run_n").alias("below"), F.col("run_pos").alias("fn")
    )
    low = own.agg((F.min("score") - 1).alias("threshold")).select("threshold", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("fn"))
    at = at.unionByName(low).crossJoin(F.broadcast(total))
    tp, tn = F.col("positives") - F.col("fn"), F.col("below") - F.col("fn")
    fp = F.col("total") - F.col("below") - tp
    f1 = lambda t, a, b: F.coalesce(2 * t / F.nullif(2 * t + a + b, F.lit(0)), F.lit(0.0))
    at = at.withColumn("macro_f1", (f1(tp, fp, F.col("fn")) + f1(tn, F.col("fn"), fp)) / 2)
    return at.agg(F.max_by("threshold", F.struct(F.round("macro_f1", 12), -F.col("threshold"))).alias("threshold"), F.max("macro_f1").alias("macro_f1"))


def selective(df: DataFrame, label: str, score: str, share: float = 0.8) -> DataFrame:
    """Threshold at a percentile of the scores, and coverage, precision and recall above it."""
    limit = quantile(df, score, share, "threshold")
    y, hit = F.col(label).cast("double"), (F.col(score) >= F.col("threshold")).cast("double")
    return df.crossJoin(F.broadcast(limit)).agg(
        F.first("threshold").alias("threshold"), F.avg(hit).alias("coverage"), (F.sum(hit * y) / F.greatest(F.sum(hit), F.lit(1.0))).alias("precision"),
        (F.sum(hit * y) / F.greatest(F.sum(y), F.lit(1.0))).alias("recall"),
    )


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(column, rank): the average rank of each distinct value."""
    n = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_c"))
    return running_sums(n, column, ["_c"]).select(column, (F.col("run__c") - (F.col("_c") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, rho) of each two columns, over rows where all are known."""
    df = df.dropna(subset=list(columns))
    for c in columns:
        df = df.join(average_ranks(df.select(c), c).withColumnRenamed("rank", f"_r_{c}"), c)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(f"_r_{a}", f"_r_{b}").alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs])).alias("e")).select("e.*")


def uncorrelated(correlations: DataFrame, columns: Sequence[str], limit: float = 0.9) -> list[str]:
    """Columns in order without those too close to one kept before; a loop over column names."""
    rho = {(r["a"], r["b"]): abs(r["rho"]) for r in correlations.collect() if r["rho"] is not None}
    kept: list[str] = []
    for c in columns:
        if all(rho.get((k, c), rho.get((c, k), 0.0)) <= limit for k in kept):
            kept.append(c)
    return kept


def grouped_errors(df: DataFrame, wrong: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """(dimension, value, n, error_rate) for several groupings in one pass."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    each = [F.struct(F.lit("+".join(s)).alias("dimension"), F.concat_ws("+", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in s]).alias("value")) for s in sets]
    rows = df.select(F.col(wrong).cast("double").alias("w"), *names).select("w", F.explode(F.array(*each)).alias("g"))
    return rows.groupBy("g.dimension", "g.value").agg(F.count("*").alias("n"), F.avg("w").alias("error_rate"))


def detector_scores(df: DataFrame, truth: str, detectors: Sequence[str], cycle: str) -> DataFrame:
    """(detector, precision, recall, false_per_cycle)."""
    t = F.col(truth)
    one = df.agg(
        *[
            F.struct(
                F.lit(d).alias("detector"), (F.count_if(F.col(d) & t) / F.greatest(F.count_if(F.col(d)), F.lit(1))).alias("precision"),
                (F.count_if(F.col(d) & t) / F.greatest(F.count_if(t), F.lit(1))).alias("recall"), (F.count_if(F.col(d) & ~t) / F.greatest(F.count_distinct(cycle), F.lit(1))).alias("false_per_cycle"),
            ).alias(d)
            for d in detectors
        ]
    )
    return one.select(F.explode(F.array(*detectors)).alias("e")).select("e.*")


def best_jaccard(found: DataFrame, planted: DataFrame) -> DataFrame:
    """For each planted set, the found set of the same cycle with the greatest overlap."""
    both = planted.join(found, "cycle", "left")
    j = F.coalesce(F.size(F.array_intersect("planted_members", "members")) / F.size(F.array_union("planted_members", "members")), F.lit(0.0))
    both = both.withColumn("jaccard", j)
    return both.groupBy("cycle", "cause").agg(F.max("jaccard").alias("jaccard"), F.max_by("cluster", F.struct("jaccard", -F.col("cluster"))).alias("cluster"))


def bootstrap(df: DataFrame, column: str, runs: int = 1000, seed: int = 0, level: float = 0.95, buckets: int = 256) -> DataFrame:
    """Mean and percentile interval by resampling.

    A row is drawn a Poisson(1) number of times in each run, from a hash of the row and the run, so no run needs an
    index into the rows. Rows are first reduced to the moments of a bounded number of buckets.
    """
    own = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"), F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).alias("b"))
    parts = own.groupBy("b").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    drawn = parts.select("b", "s", "n", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    u = (F.pmod(F.xxhash64("b", "run", F.lit(seed)), F.lit(2**31)) + 0.5) / 2**31
    limits = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
    times = sum((F.when(u > c, 1).otherwise(0) for c in limits), F.lit(0))
    means = drawn.withColumn("t", times).groupBy("run").agg((F.sum(F.col("s") * F.col("t")) / F.nullif(F.sum(F.col("n") * F.col("t")), F.lit(0))).alias("m"))
    ends = means.agg(F.percentile("m", F.lit((1 - level) / 2)).alias("low"), F.percentile("m", F.lit((1 + level) / 2)).alias("high"))
    return df.agg(F.avg(column).alias("mean")).crossJoin(ends)


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n10, n01, p): exact below 25 discordant pairs, else chi-squared with continuity."""
    one = df.agg(F.count_if(F.col(a) & ~F.col(b)).alias("n10"), F.count_if(~F.col(a) & F.col(b)).alias("n01"))
    n, k = F.col("n10") + F.col("n01"), F.least("n10", "n01")
    choose = lambda n_, i: F.exp(_log_factorial(n_) - _log_factorial(i) - _log_factorial(n_ - i))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.lit(0.0), lambda s, i: s + choose(n, i) * F.pow(F.lit(0.5), n))
    chi = F.pow(F.greatest(F.abs(F.col("n10") - F.col("n01")) - 1, F.lit(0)), 2) / F.nullif(n, F.lit(0))
    return one.select("n10", "n01", F.when(n == 0, 1.0).when(n < 25, F.least(F.lit(1.0), 2 * tail)).otherwise(normal_two_sided(F.sqrt(chi))).alias("p"))


def _log_factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))


def _corrected(column: str, test_share: float) -> list[Column]:
    """Mean, its corrected standard error and degrees of freedom, as aggregates."""
    n = F.count(column)
    spread = F.sqrt(F.var_samp(column) * (1 / n + test_share / (1 - test_share)))
    return [F.avg(column).alias("mean"), spread.alias("_se"), (n - 1).alias("df")]


def _with_t(df: DataFrame, tail: float = 0.05) -> DataFrame:
    """t, p and the interval of a mean. Without any spread p is 1 for a mean of 0, else 0, and the interval is the mean."""
    t = F.col("mean") / F.nullif("_se", F.lit(0.0))
    p = F.when(F.col("_se") == 0, (F.col("mean") == 0).cast("double")).otherwise(t_two_sided(F.abs(F.col("mean")) / F.nullif("_se", F.lit(0.0)), F.col("df")))
    half = F.when(F.col("_se") == 0, 0.0).otherwise(t_quantile(F.col("df"), tail) * F.col("_se"))
    return df.withColumns({"t": t, "p": p, "ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half}).drop("_se")


def corrected_t(differences: DataFrame, column: str, test_share: float) -> DataFrame:
    """(mean, df, t, p, ci_low, ci_high) of paired fold differences with the variance corrected for overlapping training sets."""
    return _with_t(differences.agg(*_corrected(column, test_share)))


def comparisons(folds: DataFrame, pairs: DataFrame, at: Sequence[str], test_share: float) -> DataFrame:
    """(comparison, classifier, metric, mean, df, t, p, ci_low, ci_high) for a whole grid of paired fold differences.

    ``folds`` is (model, classifier, metric, *at, value), ``at`` naming the fold; ``pairs`` is (comparison, classifier,
    model_a, model_b, classifier_b), where the second model may be that of another classifier. Folds that one side
    lacks are left out. Both sides read the same written folds: sums of doubles made twice may differ in their last bits,
    and a model would then differ from itself.
    """
    folds = cut(folds)
    a = folds.select(F.col("model").alias("model_a"), "classifier", "metric", *at, F.col("value").alias("_a"))
    b = folds.select(F.col("model").alias("model_b"), F.col("classifier").alias("classifier_b"), "metric", *at, F.col("value").alias("_b"))
    both = pairs.join(a, ["model_a", "classifier"]).join(b, ["model_b", "classifier_b", "metric", *at]).withColumn("_d", F.col("_a") - F.col("_b"))
    return _with_t(both.groupBy("comparison", "classifier", "metric").agg(*_corrected("_d", test_share)))


def wilcoxon(df: DataFrame, difference: str) -> DataFrame:
    """(n, w, p): signed-rank statistic of non-zero differences, p by the normal approximation with tie correction."""
    own = df.where(F.col(difference) != 0).select(F.col(difference).alias("d"), F.abs(F.col(difference)).alias("a"))
    ranked = own.join(average_ranks(own, "a"), "a")
    ties = own.groupBy("a").agg(F.count("*").alias("c")).agg(F.sum(F.pow("c", 3) - F.col("c")).alias("ties"))
    one = ranked.agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0)).alias("plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0)).alias("minus")).crossJoin(ties)
    n, w = F.col("n"), F.least("plus", "minus")
    z = F.abs(w - n * (n + 1) / 4) / F.sqrt(F.nullif(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48, F.lit(0.0)))
    return one.select("n", w.alias("w"), normal_two_sided(z).alias("p"))


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """(n1, n2, u, p) of a boolean grouping, p by the normal approximation with tie correction."""
    own = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    ranked = own.join(average_ranks(own, "v"), "v")
    ties = own.groupBy("v").agg(F.count("*").alias("c")).agg(F.sum(F.pow("c", 3) - F.col("c")).alias("ties"))
    one = ranked.agg(F.count_if(F.col("g")).alias("n1"), F.count_if(~F.col("g")).alias("n2"), F.sum(F.when(F.col("g"), F.col("rank")).otherwise(0)).alias("r1")).crossJoin(ties)
    n1, n2 = F.col("n1"), F.col("n2")
    n, u = n1 + n2, F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(F.nullif(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))), F.lit(0.0)))
    return one.select("n1", "n2", u.alias("u"), F.least(F.lit(1.0), normal_two_sided(F.abs(u - n1 * n2 / 2) / spread)).alias("p"))


def repeated_means(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of metrics over folds."""
    return df.groupBy(*keys).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
