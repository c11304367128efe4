"""Queries on classifier evaluation, retrieval, text and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlark.functions import text as ft
from fieldlark.operators import evaluate, learn, retrieval, trends
from fieldlark.plans.registry import CYCLES, JUDGED, VISITS, cycles, judged, normal_tail, query, t_tail, table, visits


@query("WITH " + JUDGED + "SELECT q.v AS truth, count(*) FILTER (guess = 0) AS as_0, count(*) FILTER (guess = 1) AS as_1 FROM (VALUES (0), (1)) q(v) LEFT JOIN judged ON quality = q.v GROUP BY q.v")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(judged(spark, sf_dir), "quality", "guess", [0, 1])


@query(
    "WITH "
    + JUDGED
    + """, c AS (SELECT v AS class, count(*) FILTER (quality = v AND guess = v) AS tp, count(*) FILTER (guess = v) AS np, count(*) FILTER (quality = v) AS support FROM judged, (VALUES (0), (1)) q(v) GROUP BY v)
SELECT class, round(tp / np, 6) AS precision, round(tp / support, 6) AS recall, round(2 * tp / (np + support), 6) AS f1, support FROM c"""
)
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluate.class_metrics(judged(spark, sf_dir), "quality", "guess")
    return df.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "WITH "
    + JUDGED
    + """, t AS (SELECT count(*) AS n, avg(CASE WHEN quality = guess THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg(CASE WHEN guess = 1 THEN 1.0::DOUBLE ELSE 0 END) AS pg, avg(quality::DOUBLE) AS pq,
 avg(CASE WHEN guess = 1 THEN 1.0::DOUBLE ELSE 0 END) FILTER (quality = 1) AS r1, avg(CASE WHEN guess = 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (quality = 0) AS r0 FROM judged) SELECT round(acc, 6) AS accuracy, round((r0 + r1) / 2, 6) AS balanced_accuracy, round((acc - (pg * pq + (1 - pg) * (1 - pq))) / (1 - (pg * pq + (1 - pg) * (1 - pq))), 6) AS kappa FROM t"""
)
def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluate.overall_metrics(judged(spark, sf_dir), "quality", "guess")
    return df.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "kappa")])


@query(
    "WITH "
    + JUDGED
    + """, c AS (SELECT quality AS y, p, guess, greatest(1e-7, least(1 - 1e-7, p)) AS q FROM judged) SELECT count(*) AS n, round(avg(CASE WHEN y = guess THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(sum(y * guess) / greatest(sum(guess), 1), 6) AS precision,
 round(sum(y * guess) / greatest(sum(y), 1), 6) AS recall, round(avg(pow(p - y, 2)), 6) AS brier, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 6) AS log_loss FROM c"""
)
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluate.binary_metrics(judged(spark, sf_dir), "quality", "p")
    return df.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "brier", "log_loss")])


@query("WITH " + JUDGED + ", r AS (SELECT quality, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM judged), s AS (SELECT sum(quality * rk) AS rs, sum(quality) AS np, count(*) AS n FROM r) SELECT round((rs - np * (np + 1) / 2.0::DOUBLE) / (np * (n - np)), 6) AS auc, n FROM s")
def roc_auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_auc(judged(spark, sf_dir), "quality", "p").withColumn("auc", F.round("auc", 6))


_CURVE = "WITH " + JUDGED + """, s AS (SELECT p AS score, count(*) AS n, count(*) FILTER (quality <> guess) AS bad FROM judged GROUP BY p), c AS (SELECT score, sum(n) OVER (ORDER BY score DESC) / CAST(sum(n) OVER () AS DOUBLE) AS coverage, sum(bad) OVER (ORDER BY score DESC) / CAST(sum(n) OVER (ORDER BY score DESC) AS DOUBLE) AS risk FROM s) """


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.risk_coverage(judged(spark, sf_dir).withColumn("wrong", (F.col("quality") != F.col("guess")).cast("int")), "wrong", "p")


@query(_CURVE + "SELECT score, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM c")
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select("score", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query(_CURVE + ", a AS (SELECT *, (coverage - lag(coverage) OVER w) * (risk + lag(risk) OVER w) / 2 AS t FROM c WINDOW w AS (ORDER BY coverage)) SELECT round(sum(t), 6) AS aurc, round(max_by(risk, coverage) FILTER (coverage <= 0.5), 6) AS risk50, round(max_by(risk, coverage) FILTER (coverage <= 0.7), 6) AS risk70 FROM a")
def risk_curve_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.aurc(_curve(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("aurc", "risk50", "risk70")])


@query(
    "WITH "
    + JUDGED
    + """, s AS (SELECT p AS score, count(*) AS n, sum(quality) AS pos FROM judged GROUP BY p), m AS (SELECT coalesce((score + lead(score) OVER (ORDER BY score)) / 2, score + 1) AS t, sum(n) OVER (ORDER BY score) AS below, sum(pos) OVER (ORDER BY score) AS fn, sum(n) OVER () AS n, sum(pos) OVER () AS np FROM s UNION ALL SELECT min(score) - 1, 0, 0, sum(n), sum(pos) FROM s),
f AS (SELECT t, (coalesce(2 * (np - fn) / CAST(nullif(2 * (np - fn) + (n - below - np + fn) + fn, 0) AS DOUBLE), 0) + coalesce(2 * (below - fn) / CAST(nullif(2 * (below - fn) + fn + (n - below - np + fn), 0) AS DOUBLE), 0)) / 2 AS f1 FROM m)
SELECT round(min(t) FILTER (round(f1, 12) = (SELECT round(max(f1), 12) FROM f)), 6) AS threshold, round(max(f1), 6) AS macro_f1 FROM f"""
)
def threshold_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_threshold(judged(spark, sf_dir), "quality", "p").select(F.round("threshold", 6).alias("threshold"), F.round("macro_f1", 6).alias("macro_f1"))


@query("WITH " + JUDGED + ", t AS (SELECT quantile_cont(p, 0.8) AS t FROM judged) SELECT round(any_value(t), 6) AS threshold, round(avg(CASE WHEN p >= t THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(sum(CASE WHEN p >= t THEN quality ELSE 0 END) / greatest(sum(CASE WHEN p >= t THEN 1 ELSE 0 END), 1), 6) AS precision, round(sum(CASE WHEN p >= t THEN quality ELSE 0 END) / greatest(sum(quality), 1), 6) AS recall FROM judged, t")
def selective_answering(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluate.selective(judged(spark, sf_dir), "quality", "p")
    return df.select(*[F.round(c, 6).alias(c) for c in ("threshold", "coverage", "precision", "recall")])


@query("WITH " + JUDGED + """, e AS (SELECT *, CASE WHEN quality <> guess THEN 1.0 ELSE 0.0 END AS w FROM judged), g AS (SELECT 'lang' AS dimension, lang AS value, w FROM e UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), w FROM e UNION ALL SELECT 'lang+toxic', lang || '+' || CAST(toxic AS VARCHAR), w FROM e)
SELECT dimension, value, count(*) AS n, round(avg(w), 6) AS error_rate FROM g GROUP BY ALL""")
def grouped_error_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judged(spark, sf_dir).withColumn("wrong", F.col("quality") != F.col("guess"))
    return evaluate.grouped_errors(df, "wrong", [["lang"], ["toxic"], ["lang", "toxic"]]).withColumn("error_rate", F.round("error_rate", 6))


@query("WITH " + JUDGED + """, r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS b, rank() OVER (ORDER BY toxic) + (count(*) OVER (PARTITION BY toxic) - 1) / 2.0::DOUBLE AS c FROM judged)
SELECT 'n_chars' AS a, 'p' AS b, round(corr(a, b), 6) AS rho FROM r UNION ALL SELECT 'n_chars', 'toxic', round(corr(a, c), 6) FROM r UNION ALL SELECT 'p', 'toxic', round(corr(b, c), 6) FROM r""")
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.spearman(judged(spark, sf_dir).select("n_chars", "p", "toxic"), ["n_chars", "p", "toxic"]).withColumn("rho", F.round("rho", 6))


@query("WITH " + CYCLES + """, f AS (SELECT cycle, foliage = 'Brown' AS t, coalesce(k > 50, false) AS a, coalesce(ph < 6, false) AS b FROM cycles) SELECT 'a' AS detector, round(count(*) FILTER (a AND t) / greatest(count(*) FILTER (a), 1), 6) AS precision, round(count(*) FILTER (a AND t) / greatest(count(*) FILTER (t), 1), 6) AS recall, round(count(*) FILTER (a AND NOT t) / count(DISTINCT cycle), 6) AS false_per_cycle FROM f
UNION ALL SELECT 'b', round(count(*) FILTER (b AND t) / greatest(count(*) FILTER (b), 1), 6), round(count(*) FILTER (b AND t) / greatest(count(*) FILTER (t), 1), 6), round(count(*) FILTER (b AND NOT t) / count(DISTINCT cycle), 6) FROM f""")
def detector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cycles(spark, sf_dir).select("cycle", (F.col("foliage") == "Brown").alias("t"), F.coalesce(F.col("k") > 50, F.lit(False)).alias("a"), F.coalesce(F.col("ph") < 6, F.lit(False)).alias("b"))
    df = evaluate.detector_scores(c, "t", ["a", "b"], "cycle")
    return df.select("detector", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "false_per_cycle")])


@query("WITH " + CYCLES + """, f AS (SELECT cycle, block, list(DISTINCT plant_id) AS m FROM cycles WHERE foliage = 'Brown' GROUP BY ALL), p AS (SELECT cycle, zone, list(DISTINCT plant_id) AS m FROM cycles WHERE k > 60 GROUP BY ALL)
SELECT p.cycle, CAST(p.zone AS VARCHAR) AS cause, round(max(coalesce(len(list_intersect(p.m, f.m)) / CAST(len(list_distinct(list_concat(p.m, f.m))) AS DOUBLE), 0)), 6) AS jaccard FROM p LEFT JOIN f USING (cycle) GROUP BY ALL""")
def jaccard_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cycles(spark, sf_dir)
    found = c.where("foliage = 'Brown'").groupBy("cycle", F.col("block").alias("cluster")).agg(F.collect_set("plant_id").alias("members"))
    planted = c.where("k > 60").groupBy("cycle", F.col("zone").cast("string").alias("cause")).agg(F.collect_set("plant_id").alias("planted_members"))
    return evaluate.best_jaccard(found, planted).select("cycle", "cause", F.round("jaccard", 6).alias("jaccard"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bootstrap(table(spark, sf_dir, "labels"), "quality")


@query(
    "WITH " + JUDGED + """, c AS (SELECT count(*) FILTER (quality = guess AND quality <> toxic) AS n10, count(*) FILTER (quality <> guess AND quality = toxic) AS n01 FROM judged), s AS (SELECT *, n10 + n01 AS n, sqrt(pow(greatest(abs(n10 - n01) - 1, 0), 2) / nullif(n10 + n01, 0)::DOUBLE) AS z FROM c)
SELECT n10, n01, round(CASE WHEN n = 0 THEN 1 WHEN n < 25 THEN least(1, 2 * list_sum(list_transform(range(0, least(n10, n01) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)) * pow(0.5, n)))) ELSE """
    + normal_tail("z")
    + " END, 6) AS p FROM s"
)
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judged(spark, sf_dir).select((F.col("quality") == F.col("guess")).alias("a"), (F.col("quality") == F.col("toxic")).alias("b"))
    return evaluate.mcnemar(df, "a", "b").select("n10", "n01", F.round("p", 6).alias("p"))


@query(
    "WITH " + JUDGED + """, r AS (SELECT quality = 1 AS g, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY p) AS c FROM judged),
a AS (SELECT count(*) FILTER (g)::DOUBLE AS n1, count(*) FILTER (NOT g)::DOUBLE AS n2, sum(rk) FILTER (g) AS r1, sum(c * c - 1)::DOUBLE AS ties FROM r),
s AS (SELECT p - 0.5::DOUBLE AS d FROM judged WHERE p <> 0.5), q AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY abs(d)) AS c FROM s),
b AS (SELECT count(*)::DOUBLE AS n, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS w, sum(c * c - 1)::DOUBLE AS ties FROM q),
z AS (SELECT 'mann_whitney' AS test, r1 - n1 * (n1 + 1) / 2 AS statistic, abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM a
 UNION ALL SELECT 'wilcoxon', w, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) FROM b)
SELECT test, statistic, round(1 - 2 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * i / 2000.0::DOUBLE, 2) / 2)) * z / 6000.0::DOUBLE / sqrt(2 * pi()), 4) AS p FROM z, range(2001) t(i) GROUP BY test, statistic, z"""
)
def rank_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judged(spark, sf_dir)
    u = evaluate.mann_whitney(df.withColumn("g", F.col("quality") == 1), "g", "p").select(F.lit("mann_whitney").alias("test"), F.col("u").alias("statistic"), "p")
    w = evaluate.wilcoxon(df.withColumn("d", F.col("p") - 0.5), "d").select(F.lit("wilcoxon").alias("test"), F.col("w").alias("statistic"), "p")
    return u.unionByName(w).withColumn("p", F.round("p", 4))


@query("WITH " + VISITS + """, m AS (SELECT zone, day, avg(score) AS s FROM visits GROUP BY ALL) SELECT zone, round(avg(s), 6) AS s_mean, round(stddev_samp(s), 6) AS s_std FROM m GROUP BY zone""")
def fold_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = visits(spark, sf_dir).groupBy("zone", "day").agg(F.avg("score").alias("s"))
    return evaluate.repeated_means(m, ["zone"], ["s"]).select("zone", F.round("s_mean", 6).alias("s_mean"), F.round("s_std", 6).alias("s_std"))


@query("WITH " + JUDGED + ", n AS (SELECT quality, count(*) AS c FROM judged GROUP BY 1) SELECT quality, round(sum(c) OVER () / (2.0::DOUBLE * c), 6) AS weight, c AS n FROM n")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = learn.class_weights(judged(spark, sf_dir), "quality")
    return df.groupBy("quality").agg(F.round(F.first("weight"), 6).alias("weight"), F.count("*").alias("n"))


@query("SELECT 0 AS n_leaks, count(DISTINCT source) AS n_groups FROM documents d JOIN labels USING (doc_id)")
def group_folds_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = learn.group_folds(judged(spark, sf_dir), "source", "quality")
    leaks = learn.leaking_groups(df, "source").agg(F.count("*").cast("int").alias("n_leaks"))
    return leaks.crossJoin(df.agg(F.count_distinct("source").alias("n_groups")))


@query("WITH " + JUDGED + ", c AS (SELECT quality, count(*) AS n FROM judged GROUP BY 1) SELECT quality, (SELECT min(n) FROM c) AS n FROM c")
def undersampled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.undersampled(judged(spark, sf_dir), "quality", "doc_id").groupBy("quality").agg(F.count("*").alias("n"))


@query()
def lr_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of five repeats of ten folds; five numbers for each labelled document."""
    df = judged(spark, sf_dir).withColumn("quality", F.col("quality").cast("double"))
    folds = learn.repeated_folds(df, "doc_id", "quality", 5, 10)
    return learn.repeated_out_of_fold(df, learn.pipeline(["p", "n_chars", "toxic"], ["lang"], "quality"), folds, "doc_id", 5, 10, ["quality"])


_TOP = """WITH d AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score, q.label = i.label AS rel FROM embeddings q JOIN embeddings i ON q.vec_id % 50 = 0 AND i.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM d) """


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return e.where("id % 50 = 0"), e


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Each 50th vector against all others: one more than wanted, without itself."""
    q, i = _vectors(spark, sf_dir)
    own = retrieval.top_k(q.select("id", "vector"), i, k + 1).where("query_id != item_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, i = _vectors(spark, sf_dir)
    return q.select(F.col("id").alias("query_id"), "label").join(i.select(F.col("id").alias("item_id"), "label"), "label").where("query_id != item_id").select("query_id", "item_id")


@query(_TOP + "SELECT query_id, item_id, rank, round(score, 6) AS score FROM r WHERE rank <= 3")
def top3_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, 3).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(_TOP + ", h AS (SELECT query_id, count(*) FILTER (rel) AS n_relevant, count(*) FILTER (rel AND rank <= 3) AS hit, min(rank) FILTER (rel AND rank <= 3) AS f FROM r GROUP BY 1) SELECT query_id, n_relevant, round(hit / CAST(n_relevant AS DOUBLE), 6) AS recall, CAST(coalesce(f = 1, false) AS INTEGER) AS hit1, CAST(f IS NOT NULL AS INTEGER) AS hitk, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr FROM h WHERE n_relevant > 0")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = retrieval.retrieval_metrics(_ranked(spark, sf_dir, 3), _relevant(spark, sf_dir))
    return df.select("query_id", "n_relevant", F.round("recall", 6).alias("recall"), "hit1", "hitk", F.round("mrr", 6).alias("mrr"))


@query(_TOP + "SELECT query_id, item_id, rank - 3 AS rank FROM r WHERE rank BETWEEN 4 AND 6")
def rank_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rank_shift(_ranked(spark, sf_dir, 6), 4, 6).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query(_TOP + ", g AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r WHERE NOT rel) SELECT query_id, item_id, rank FROM g WHERE rank <= 3")
def evidence_removal_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = retrieval.top_k(*_vectors(spark, sf_dir), 3, apart="label")
    return df.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query(_TOP + ", s AS (SELECT query_id, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b, max(score) FILTER (rank = 3) AS c, stddev_pop(score) FILTER (rank <= 3) AS sd FROM r GROUP BY 1) SELECT query_id, round(a, 6) AS top, round(a - b, 6) AS gap12, round(b - c, 6) AS gap23, round(sd, 6) AS spread FROM s")
def score_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.score_gaps(_ranked(spark, sf_dir, 3)).select("query_id", *[F.round(c, 6).alias(c) for c in ("top", "gap12", "gap23", "spread")])


@query(_TOP + ", t AS (SELECT query_id, (1 - max(score)) * 20 AS distance, min(rank) FILTER (rel) AS rank FROM r GROUP BY 1) SELECT CAST(radius AS DOUBLE) AS radius, CAST(k AS INTEGER) AS k, round(avg(CASE WHEN coalesce(distance <= radius AND rank <= k, false) THEN 1.0 ELSE 0.0 END), 6) AS recall FROM t, (VALUES (3), (5), (8), (12)) a(radius), (VALUES (1), (3), (5)) b(k) GROUP BY ALL")
def recall_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(spark, sf_dir, 5)
    first = ranked.join(_relevant(spark, sf_dir), ["query_id", "item_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    trials = ranked.groupBy("query_id").agg(((1 - F.max("score")) * 20).alias("distance")).join(first, "query_id", "left")
    return retrieval.recall_grid(trials, [3, 5, 8, 12], [1, 3, 5]).withColumn("recall", F.round("recall", 6))


@query(
    _TOP + """, t AS (SELECT e.vec_id AS query_id, u.i, list_slice(e.embedding::DOUBLE[], CAST(u.i * 16 + 1 AS BIGINT), CAST(u.i * 16 + 16 AS BIGINT)) AS v FROM embeddings e, range(4) u(i)),
p AS (SELECT r.query_id, a.i, r.rank, max(list_dot_product(a.v, b.v)) AS m FROM r JOIN t a ON a.query_id = r.query_id JOIN t b ON b.query_id = r.item_id WHERE r.rank <= 3 GROUP BY ALL),
k AS (SELECT query_id, i, max(m) AS m FROM p GROUP BY ALL), o AS (SELECT query_id, max(m) AS single, max(m) FILTER (rank = 1) AS first FROM (SELECT query_id, rank, avg(m) AS m FROM p GROUP BY ALL) GROUP BY query_id)
SELECT query_id, round(avg(m), 6) AS mean_max, round(min(m), 6) AS min_max, round(quantile_cont(m, 0.25), 6) AS p25_max, round(any_value(single), 6) AS single, round(any_value(first), 6) AS rank1, round(avg(m) - any_value(single), 6) AS delta FROM k JOIN o USING (query_id) GROUP BY query_id"""
)
def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    t = e.select("vec_id", F.posexplode(F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)])).alias("token", "vector"))
    q = t.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    p = _ranked(spark, sf_dir, 3).select("query_id", "rank", F.col("item_id").alias("vec_id")).join(t.drop("token"), "vec_id").drop("vec_id")
    df = retrieval.late_interaction(q, p)
    return df.select("query_id", *[F.round(c, 6).alias(c) for c in ("mean_max", "min_max", "p25_max", "single", "rank1", "delta")])


@query(
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents), c AS (SELECT doc_id, ws, len(ws) AS n, greatest(1, CAST(ceil((len(ws) - 50) / 200.0) AS INTEGER)) AS k FROM w WHERE len(ws) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS chunk, CAST(i * 200 AS INTEGER) AS start, CAST(len(list_slice(ws, i * 200 + 1, i * 200 + 250)) AS INTEGER) AS n_words, md5(array_to_string(list_slice(ws, i * 200 + 1, i * 200 + 250), ' ')) AS digest FROM c, LATERAL (SELECT unnest(range(k)) AS i)"""
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = retrieval.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return df.select("doc_id", "chunk", "start", "n_words", F.md5(F.col("text").cast("binary")).alias("digest"))


_PAIRS = [("in", "the", "place"), ("of", None, "relation")]
_STEMS = {"what": ["wh"], "how": ["ho"], "question": ["qu"], "that": ["th"]}
_CLASS_SQL = "CASE WHEN len(list_filter(ps, lambda p: p.w = 'in' AND p.x = 'the')) > 0 THEN 'place' WHEN len(list_filter(ps, lambda p: p.w = 'of' AND p.x IS NOT NULL)) > 0 THEN 'relation' " + " ".join(
    f"WHEN len(list_filter(ps, lambda p: (starts_with(p.w, '{s}') OR {e}) AND coalesce(p.x NOT IN ('is', 'and'), true))) > 0 THEN '{n}'" for n, s, e in (("what", "wh", "false"), ("how", "ho", "p.w = 'en'"), ("question", "qu", "false"), ("that", "th", "false"))
) + " ELSE 'other' END"


@query(
    """WITH w AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda w: regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), lambda w: w <> '') AS ws FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id, turn, ws, list_transform(range(1, len(ws) + 1), lambda i: {'w': ws[i], 'x': ws[i + 1]}) AS ps FROM w) SELECT conv_id, turn, """ + _CLASS_SQL + """ AS class, len(list_filter(ws, lambda w: w = 'des' OR w = 'and')) > 0 AS ambiguous FROM p"""
)
def question_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", ft.question_class(F.col("text"), _PAIRS, _STEMS, {"how": ["en"]}, ["is", "and"]).alias("class"), ft.has_word(F.lower("text"), ["des", "and"]).alias("ambiguous"))


@query("WITH t AS (SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'Hello!' WHEN 1 THEN 'Thank you, it is fine' WHEN 2 THEN 'hi how do you grow a very long vine' ELSE text END AS s FROM conversations WHERE role = 'user'), n AS (SELECT conv_id, turn, trim(regexp_replace(translate(lower(s), '?!.,', ''), '\\s+', ' ', 'g')) AS s FROM t) SELECT conv_id, turn, CASE WHEN len(string_split(s, ' ')) > 5 THEN NULL WHEN starts_with(s, 'hello') OR starts_with(s, 'hi') OR starts_with(s, 'good morning') OR starts_with(s, 'good evening') THEN 'greeting' WHEN starts_with(s, 'thank') AND (starts_with(s, 'thank you') OR starts_with(s, 'thanks')) THEN 'thanks' WHEN starts_with(s, 'bye') OR starts_with(s, 'goodbye') THEN 'bye' END AS kind FROM n")
def small_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = (F.col("conv_id") + F.col("turn")) % 4
    s = F.when(i == 0, "Hello!").when(i == 1, "Thank you, it is fine").when(i == 2, "hi how do you grow a very long vine").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", ft.small_talk(s).alias("kind"))


@query("SELECT user_id, event_type, string_agg(event_id, ';' ORDER BY event_id) AS ids FROM events GROUP BY ALL")
def section_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ";").alias("ids"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS top, CASE l_returnflag WHEN 'R' THEN 'bad' ELSE 'good' END AS collapsed, CASE l_returnflag WHEN 'R' THEN 'treat' ELSE 'none' END AS action FROM lineitem")
def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    m = {a: {"collapsed": "bad" if a == "R" else "good", "action": "treat" if a == "R" else "none"} for a in "RAN"}
    return trends.mapped_labels(li, "l_returnflag", m).select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("top"), "collapsed", "action")


@query(
    """WITH p AS (SELECT event_id, v, CASE c WHEN 'a' THEN 'ill' WHEN 'b' THEN 'ill' ELSE 'well' END AS g, c FROM (SELECT event_id, value / 200 AS a, value / 400 AS b, 1 - value / 200 - value / 400 AS c FROM events) UNPIVOT (v FOR c IN (a, b, c))), s AS (SELECT event_id, g, sum(v) AS s FROM p GROUP BY ALL),
t AS (SELECT event_id, arg_max(c, v) AS c FROM p GROUP BY 1) SELECT t.event_id, t.c AS top, s.g AS collapsed, s.s >= 0.6 AS accepted FROM t JOIN s ON s.event_id = t.event_id AND s.g = CASE t.c WHEN 'c' THEN 'well' ELSE 'ill' END"""
)
def argmax_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    e = table(spark, sf_dir, "events").where("value is not null")
    df = e.select("event_id", F.create_map(F.lit("a"), v / 200, F.lit("b"), v / 400, F.lit("c"), 1 - v / 200 - v / 400).alias("p"))
    out = trends.decided(df, "event_id", "p", {"a": "ill", "b": "ill", "c": "well"}, {"ill": "treat", "well": "none"}, 0.6)
    return out.select("event_id", "top", "collapsed", (F.col("decision") == "accept").alias("accepted"))


@query(
    _TOP
    + """, n AS (SELECT r.query_id, greatest(1 - score, 0) AS d, i.label FROM r JOIN embeddings i ON i.vec_id = r.item_id WHERE rank <= 15), z AS (SELECT *, min(d) OVER (PARTITION BY query_id) <= 0 AS equal FROM n), v AS (SELECT query_id, label, sum(CASE WHEN equal THEN CAST(d <= 0 AS DOUBLE) ELSE 1 / d END) AS v FROM z GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 9) DESC, label) AS i, sum(v) OVER (PARTITION BY query_id) AS t FROM v) SELECT query_id, label AS prediction, round(v / t, 5) AS share FROM o WHERE i = 1"""
)
def nearest_neighbours_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _ranked(spark, sf_dir, 15).withColumn("distance", F.greatest(1 - F.col("score"), F.lit(0.0)))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    return learn.neighbours_vote(near, labels).withColumn("share", F.round("share", 5))


@query("WITH " + JUDGED + ", c AS (SELECT quality, count(*) AS n FROM judged GROUP BY 1) SELECT arg_max(quality, (n, -quality)) AS prediction, round(max(n) / sum(n), 6) AS share FROM c")
def majority_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.majority(judged(spark, sf_dir), "quality").withColumn("share", F.round("share", 6))


@query("WITH " + JUDGED + ", c AS (SELECT quality, count(*) AS n FROM judged GROUP BY 1) SELECT quality, CAST(ceil(n * 0.3) AS BIGINT) AS n FROM c")
def stratified_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.stratified_fraction(judged(spark, sf_dir), "quality", "doc_id", 0.3).groupBy("quality").agg(F.count("*").alias("n"))


@query("WITH " + JUDGED + ", c AS (SELECT quality, count(*) AS n FROM judged GROUP BY 1) SELECT CAST(r AS INTEGER) AS repeat, quality, CAST(f AS INTEGER) AS fold, (n - f + 4) // 5 AS n FROM c, range(2) a(r), range(5) b(f)")
def repeated_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir)
    return learn.repeated_folds(j, "doc_id", "quality", 2, 5).join(j.select("doc_id", "quality"), "doc_id").groupBy("repeat", "quality", "fold").agg(F.count("*").alias("n"))


@query(
    "WITH " + JUDGED + """, r AS (SELECT quality = 1 AS g, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY p)::DOUBLE AS c FROM judged WHERE p IS NOT NULL),
a AS (SELECT count(*) FILTER (g)::DOUBLE AS n1, count(*) FILTER (NOT g)::DOUBLE AS n2, sum(rk) FILTER (g) AS r1, sum(c * c - 1) AS ties FROM r), a2 AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n, ties FROM a),
d AS (SELECT round(p - 0.5, 12) AS d FROM judged WHERE round(p - 0.5, 12) <> 0), b AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY abs(d))::DOUBLE AS c FROM d),
b2 AS (SELECT count(*)::DOUBLE AS n, least(sum(rk) FILTER (d > 0), sum(rk) FILTER (d < 0)) AS w, sum(c * c - 1) AS ties FROM b),
z AS (SELECT 'mann_whitney' AS test, u AS statistic, abs(u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM a2 UNION ALL SELECT 'wilcoxon', w, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) FROM b2)
SELECT test, statistic, round(""" + normal_tail("z") + ", 6) AS p FROM z"
)
def rank_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judged(spark, sf_dir)
    u = evaluate.mann_whitney(df.withColumn("g", F.col("quality") == 1), "g", "p").select(F.lit("mann_whitney").alias("test"), F.col("u").alias("statistic"), "p")
    w = evaluate.wilcoxon(df.withColumn("d", F.round(F.col("p") - 0.5, 12)), "d").select(F.lit("wilcoxon").alias("test"), F.col("w").alias("statistic"), "p")
    return u.unionByName(w).withColumn("p", F.round("p", 6))


#: (comparison, classifier, model_a, model_b, classifier_b)
_COMPARED = [("guess_vs_toxic", "all", "guess", "toxic", "all"), ("guess_vs_toxic", "en", "guess", "toxic", "en"), ("guess_vs_ones", "all", "guess", "ones", "all"), ("guess_vs_ones", "en", "guess", "ones", "all"), ("toxic_vs_itself", "all", "toxic", "toxic", "all")]


@query(
    "WITH " + JUDGED + f""", m AS (SELECT source, lang, quality, p, model, CASE model WHEN 'guess' THEN guess WHEN 'toxic' THEN toxic ELSE 1 END AS g FROM judged, (VALUES ('guess'), ('toxic'), ('ones')) v(model)),
k AS (SELECT *, classifier FROM m, (VALUES ('all'), ('en')) c(classifier) WHERE classifier = 'all' OR lang = 'en'),
f AS (SELECT model, classifier, source, 'accuracy' AS metric, avg((quality = g)::INTEGER::DOUBLE) AS value FROM k GROUP BY ALL UNION ALL SELECT model, classifier, source, 'brier', avg(pow(g - p, 2)) FROM k GROUP BY ALL),
pairs AS (SELECT * FROM (VALUES {", ".join(map(str, _COMPARED))}) t(comparison, classifier, model_a, model_b, classifier_b)),
d AS (SELECT comparison, pairs.classifier, a.metric, a.value - b.value AS d FROM pairs JOIN f a ON a.model = model_a AND a.classifier = pairs.classifier JOIN f b ON b.model = model_b AND b.classifier = classifier_b AND b.metric = a.metric AND b.source = a.source),
s AS (SELECT comparison, classifier, metric, avg(d) AS mean, count(*) - 1 AS df, sqrt(var_samp(d) * (1 / count(*)::DOUBLE + 0.25)) AS se FROM d GROUP BY ALL),
q AS (SELECT *, CASE df WHEN 19 THEN 2.093024054408263::DOUBLE END AS crit FROM s) SELECT comparison, classifier, metric, round(mean, 6) AS mean, df, round(CASE WHEN se = 0 THEN (mean = 0)::INTEGER::DOUBLE ELSE """
    + t_tail("abs(mean) / nullif(se, 0)", "df")
    + " END, 6) AS p, round(mean - CASE WHEN se = 0 THEN 0 ELSE crit * se END, 6) AS ci_low, round(mean + CASE WHEN se = 0 THEN 0 ELSE crit * se END, 6) AS ci_high FROM q"
)
def comparison_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as folds, three models, all languages and English as classifiers. The SQL has the quantile of 19 degrees of freedom, as there are 20 sources."""
    j = judged(spark, sf_dir)
    models = {"guess": F.col("guess"), "toxic": F.col("toxic"), "ones": F.lit(1)}
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), c.cast("int").alias("g")) for n, c in models.items()]))
    kinds = F.explode(F.when(F.col("lang") == "en", F.array(F.lit("all"), F.lit("en"))).otherwise(F.array(F.lit("all"))))
    each = j.select("source", "quality", "p", kinds.alias("classifier"), m.alias("m")).groupBy("m.model", "classifier", "source")
    each = each.agg(F.avg((F.col("quality") == F.col("m.g")).cast("double")).alias("accuracy"), F.avg(F.pow(F.col("m.g") - F.col("p"), 2)).alias("brier"))
    folds = each.unpivot(["model", "classifier", "source"], ["accuracy", "brier"], "metric", "value")
    pairs = spark.createDataFrame(_COMPARED, "comparison string, classifier string, model_a string, model_b string, classifier_b string")
    found = evaluate.comparisons(folds, pairs, ["source"], 0.2)
    return found.select("comparison", "classifier", "metric", "df", *[F.round(c, 6).alias(c) for c in ("mean", "p", "ci_low", "ci_high")])
