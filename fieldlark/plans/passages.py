"""Queries on features of retrieved passages, on what happens when passages change, and on final models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.operators import learn, retrieval, twin
from fieldlark.operators.lineage import cut, shared_dir
from fieldlark.plans.evaluation import _TOP, _ranked, _relevant, _vectors
from fieldlark.plans.registry import JUDGED, PLACES, VISITS, judged, places, query, table, visits
from fieldlark.sources import cache

_COLUMNS = ["s1", "s2", "s3", "s_mean", "s_std", "gap12", "gap13", "gap23", "mean_max", "min_max", "p25_max", "single", "rank1", "delta", "weighted", "hard"]
_COUNTS = ["n_sections", "same_section_12", "words1", "words2", "words3", "n_words", "n_tokens"]


def _features_sql(top: str, name: str) -> str:
    """Features of the three passages of ``top`` (query_id, item_id, rank, score) as the relation ``name``."""
    return f"""{name}_t AS (SELECT e.vec_id AS id, u.i, list_slice(e.embedding::DOUBLE[], CAST(u.i * 16 + 1 AS BIGINT), CAST(u.i * 16 + 16 AS BIGINT)) AS v, (e.vec_id // 50 + u.i) % 3 AS weight FROM embeddings e, range(4) u(i)),
{name}_p AS (SELECT r.query_id, a.i, a.weight, r.rank, max(list_dot_product(a.v, b.v)) AS m FROM {top} r JOIN {name}_t a ON a.id = r.query_id JOIN {name}_t b ON b.id = r.item_id GROUP BY ALL),
{name}_k AS (SELECT query_id, i, weight, max(m) AS m, median(any_value(weight)) OVER (PARTITION BY query_id) AS mid FROM {name}_p GROUP BY query_id, i, weight),
{name}_o AS (SELECT query_id, max(m) AS single, max(m) FILTER (rank = 1) AS rank1 FROM (SELECT query_id, rank, avg(m) AS m FROM {name}_p GROUP BY ALL) GROUP BY query_id),
{name}_c AS (SELECT query_id, avg(m) AS mean_max, min(m) AS min_max, quantile_cont(m, 0.25) AS p25_max, CASE WHEN sum(weight) > 0 THEN sum(weight * m) / sum(weight) ELSE avg(m) END AS weighted, min(m) FILTER (weight >= mid) AS hard, count(*) AS n_tokens FROM {name}_k GROUP BY query_id),
{name}_s AS (SELECT query_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, max(score) FILTER (rank = 3) AS s3, avg(score) AS s_mean, stddev_pop(score) AS s_std, count(DISTINCT e.label) AS n_sections,
 CAST(max(e.label) FILTER (rank = 1) = max(e.label) FILTER (rank = 2) AS INTEGER) AS same_section_12, max(vec_id % 97) FILTER (rank = 1) AS words1, max(vec_id % 97) FILTER (rank = 2) AS words2, max(vec_id % 97) FILTER (rank = 3) AS words3,
 CAST(sum(vec_id % 97) AS BIGINT) AS n_words FROM {top} r JOIN embeddings e ON e.vec_id = r.item_id GROUP BY query_id),
{name} AS (SELECT *, s1 - s2 AS gap12, s1 - s3 AS gap13, s2 - s3 AS gap23, mean_max - single AS delta FROM {name}_s JOIN {name}_c USING (query_id) JOIN {name}_o USING (query_id))"""


def _features(spark: SparkSession, sf_dir: str, top: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    t = e.select("vec_id", F.posexplode(F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)])).alias("token", "vector"))
    q = t.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "token", F.expr("(vec_id div 50 + token) % 3").alias("weight"), "vector")
    passages = e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("section"), (F.col("vec_id") % 97).alias("n_words"))
    return retrieval.passage_features(top, q, t.select(F.col("vec_id").alias("item_id"), "vector"), passages, stored)


def _without_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that have a relevant item among their best three: the best three of the others."""
    q, i = _vectors(spark, sf_dir)
    hit = _ranked(spark, sf_dir, 3).join(_relevant(spark, sf_dir), ["query_id", "item_id"], "left_semi").select("query_id").distinct()
    return retrieval.top_k(q, i, 3, apart="label").join(hit, "query_id", "left_semi")


_REMOVED = "h AS (SELECT DISTINCT query_id FROM r WHERE rel AND rank <= 3), g AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r WHERE NOT rel AND query_id IN (SELECT query_id FROM h)), n AS (SELECT * FROM g WHERE rank <= 3)"
_ROUNDED = "query_id, " + ", ".join([f"round({c}, 5) AS {c}" for c in _COLUMNS] + _COUNTS)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", *[F.round(c, 5).alias(c) for c in _COLUMNS], *_COUNTS)


@query(_TOP + ", k AS (SELECT query_id, item_id, rank - 3 AS rank, CASE WHEN item_id % 3 = 0 THEN round(score, 2) ELSE score END AS score FROM r WHERE rank BETWEEN 4 AND 6), " + _features_sql("k", "f") + f" SELECT {_ROUNDED} FROM f")
def passage_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the passages at ranks 4 to 6; some have a stored score."""
    top = retrieval.rank_shift(_ranked(spark, sf_dir, 6), 4, 6)
    stored = top.where("item_id % 3 = 0").select("query_id", "item_id", F.round("score", 2).alias("score"))
    return _rounded(_features(spark, sf_dir, top, stored))


@query(_TOP + ", " + _REMOVED + ", " + _features_sql("n", "f") + f" SELECT {_ROUNDED} FROM f")
def evidence_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features after the items of the query's own section are taken away, however many they are."""
    return _rounded(_features(spark, sf_dir, _without_own(spark, sf_dir)))


_Z = ["s1", "s_mean", "mean_max", "weighted", "p25_max", "min_max"]


@query(
    _TOP + ", " + _REMOVED + ", b AS (SELECT * FROM r WHERE rank <= 3), " + _features_sql("n", "f") + ", " + _features_sql("b", "o") + ", z AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, (f.{c} - o.{c}) / (SELECT stddev_samp({c}) FROM o) AS z FROM f JOIN o USING (query_id)" for c in _Z)
    + ") SELECT feature, count(*) AS n, round(avg(z), 5) AS mean_z, round(stddev_samp(z), 5) AS std_z FROM z GROUP BY feature"
)
def evidence_removal_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = cut(_features(spark, sf_dir, _ranked(spark, sf_dir, 3)))
    out = retrieval.z_changes(before, _features(spark, sf_dir, _without_own(spark, sf_dir)), before, "query_id", _Z)
    return out.select("feature", "n", F.round("mean_z", 5).alias("mean_z"), F.round("std_z", 5).alias("std_z"))


@query()
def evidence_removal_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean out-of-fold predictions before and after the removal; a model is refitted for each fold."""
    before = cut(_features(spark, sf_dir, _ranked(spark, sf_dir, 3)))
    mean = before.agg(F.avg("s2")).first()[0]
    features, after = before.withColumn("y", (F.col("s2") > mean).cast("double")), _features(spark, sf_dir, _without_own(spark, sf_dir))
    build, folds = learn.pipeline(_Z, [], "y"), learn.repeated_folds(features, "query_id", "y", 5, 10)
    p = learn.changed_predictions(features, {"after": after.withColumn("y", F.lit(0.0))}, build, folds, "query_id", 5, 10)
    at = lambda v: F.max(F.when(F.col("variant") == v, F.col("p")))
    return p.groupBy("query_id").agg(at("original").alias("p_before"), at("after").alias("p_after")).where("p_after is not null").withColumn("delta", F.col("p_after") - F.col("p_before"))


@query("WITH " + JUDGED + ", t AS (SELECT quantile_cont(p, 0.8) AS threshold FROM judged) SELECT count(*) AS n_scored, count(*) AS n_training_rows, 'p,n_chars,toxic' AS features, round(any_value(threshold), 6) AS threshold, round(avg(CAST(p >= threshold AS INTEGER)), 6) AS coverage FROM judged, t")
def model_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of all rows and its card, written and read back; the threshold is the 80th percentile of the scores."""
    df = judged(spark, sf_dir).withColumn("quality", F.col("quality").cast("double"))
    threshold = df.agg(F.percentile("p", F.lit(0.8))).first()[0]
    columns, folder = ["p", "n_chars", "toxic"], f"{shared_dir(spark)}/models/{uuid.uuid4().hex}"
    learn.final_model(df, learn.pipeline(columns, ["lang"], "quality"), columns, folder, {"threshold": threshold})
    model, card = learn.read_model(spark, folder)
    out = learn.scored(model, df).where("probability_1 between 0 and 1")
    return out.agg(
        F.count("*").alias("n_scored"), F.lit(card["n_training_rows"]).cast("long").alias("n_training_rows"), F.lit(",".join(card["feature_list"])).alias("features"),
        F.lit(round(card["threshold"], 6)).alias("threshold"), F.round(F.avg((F.col("p") >= card["threshold"]).cast("int")), 6).alias("coverage"),
    )


@query("SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey")
def cached_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result that is built once for a model and the rows of its input; the second call must not build it."""
    orders, folder = table(spark, sf_dir, "orders"), f"{shared_dir(spark)}/cache"
    build = lambda: orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    cache.cached(spark, folder, "sums", {"orders": orders}, build)

    def again() -> DataFrame:
        raise RuntimeError("built twice")

    return cache.cached(spark, folder, "sums", {"orders": orders}, again)


@query(
    "WITH " + VISITS + ", " + PLACES
    + """, last AS (SELECT plant_id, max(ts) AS ts FROM visits WHERE day IS NOT NULL GROUP BY plant_id),
s AS (SELECT id AS slot_id, CASE WHEN id % 5 = 0 THEN 0.0 ELSE lat END AS lat, lon, label * 2.04 AS accuracy, CASE id % 4 WHEN 0 THEN 'gps' WHEN 1 THEN 'estimated' WHEN 2 THEN 'smoothed' ELSE 'drawn' END AS source FROM places)
SELECT c_custkey AS plant_id, c_mktsegment AS zone, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS block, c_custkey * 3 AS slot_id, CASE WHEN lat BETWEEN 5.9 AND 9.9 AND lon BETWEEN 79.5 AND 82 THEN lat END AS lat,
 CASE WHEN lat BETWEEN 5.9 AND 9.9 AND lon BETWEEN 79.5 AND 82 THEN lon END AS lon, round(accuracy, 1) AS accuracy, CASE WHEN source <> 'drawn' THEN source END AS source, v.ts AS day, v.foliage, v.ph,
 c_mktsegment || '-' || CASE WHEN c_custkey % 3 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS block_id
FROM customer LEFT JOIN s ON s.slot_id = c_custkey * 3 LEFT JOIN (SELECT visits.* FROM visits JOIN last USING (plant_id, ts)) v ON v.plant_id = c_custkey WHERE c_custkey % 13 <> 0 AND c_custkey % 17 <> 0"""
)
def plant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of living plants without the latest-state view; smoothed positions count."""
    key = F.col("c_custkey")
    plants = table(spark, sf_dir, "customer").select(
        key.alias("plant_id"), F.col("c_mktsegment").alias("zone"), F.when(key % 3 > 0, F.col("c_nationkey").cast("string")).alias("block"), (key * 3).alias("slot_id"),
        F.when(key % 13 == 0, "retired").alias("status"), F.when(key % 17 == 0, key + 1).alias("replaced_by"),
    )
    slots = places(spark, sf_dir).select(
        F.col("id").alias("slot_id"), F.when(F.col("id") % 5 == 0, 0.0).otherwise(F.col("lat")).alias("lat"), "lon", (F.col("label") * F.lit(2.04)).alias("accuracy"),
        F.element_at(F.array(*map(F.lit, ("gps", "estimated", "smoothed", "drawn"))), (F.col("id") % 4 + 1).cast("int")).alias("source"),
    )
    return twin.plant_rows(plants, slots, visits(spark, sf_dir).select("plant_id", F.col("ts").alias("day"), "foliage", "ph"))
