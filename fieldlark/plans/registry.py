"""A registry of queries: each is a function of (spark, sf_dir), with SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.functions.cleaning import lookup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _simpson(f: str, to: str) -> str:
    """Simpson's rule for ``f`` in x from 0, by 2,000 steps: tails in SQL are integrals, not the series of the library."""
    weight = "(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(({to}) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: {weight} * {f.replace('{x}', f'(({to}) * i / 2000)')})))"


def normal_tail(z: str) -> str:
    return f"greatest(0, 1 - 2 / sqrt(2 * pi()) * {_simpson('exp(-pow({x}, 2) / 2)', z)})"


def t_tail(t: str, df: str) -> str:
    return f"greatest(0, 1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * {_simpson(f'pow(1 + pow({{x}}, 2) / {df}, -({df} + 1) / 2.0)', t)})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FOLIAGE = {"error": "Brown", "purchase": "Yellow", "click": "Mixed", "view": "Green", "signup": "Green"}
SCORE = {"Green": 1.0, "Mixed": 0.7, "Yellow": 0.4, "Brown": 0.1}


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as inspections: a user is a plant, with a block and a zone; a value is missing in each 17th."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    df = e.select(
        "event_id", F.col("user_id").alias("plant_id"), (F.col("user_id") % 10).alias("block"), (F.col("user_id") % 4).alias("zone"), "ts", F.to_date("ts").alias("day"), "event_type",
        lookup(F.col("event_type"), FOLIAGE).alias("foliage"), F.when(F.col("event_id") % 17 == 0, None).otherwise(F.col("value")).alias("value"), k.alias("k"),
    )
    return df.withColumns({"ph": (F.col("k") % 30) / F.lit(10.0) + 5.0, "score": lookup(F.col("foliage"), SCORE)})


VISITS = """v0 AS (SELECT event_id, user_id AS plant_id, user_id % 10 AS block, user_id % 4 AS zone, ts, CAST(ts AS DATE) AS day, event_type,
 CASE event_type WHEN 'error' THEN 'Brown' WHEN 'purchase' THEN 'Yellow' WHEN 'click' THEN 'Mixed' ELSE 'Green' END AS foliage,
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
visits AS (SELECT *, (k % 30) / 10.0::DOUBLE + 5.0::DOUBLE AS ph, CASE foliage WHEN 'Green' THEN 1.0::DOUBLE WHEN 'Mixed' THEN 0.7::DOUBLE WHEN 'Yellow' THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END AS score FROM v0)"""


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last visit of each plant in each week."""
    from fieldlark.operators.temporal import latest_per_cycle

    return latest_per_cycle(visits(spark, sf_dir), "plant_id", "ts", "event_id", "2024-01-01")


CYCLES = (
    VISITS
    + """, cycles AS (SELECT * EXCLUDE (rn) FROM (SELECT *, CAST(floor(date_diff('day', DATE '2024-01-01', day) / 7.0) AS INTEGER) AS cycle,
 row_number() OVER (PARTITION BY plant_id, CAST(floor(date_diff('day', DATE '2024-01-01', day) / 7.0) AS INTEGER) ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM visits) WHERE rn = 1)"""
)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as plants with coordinates, in zones by label; some are flagged."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), (F.lit(7.3388) + F.col("embedding")[0].cast("double") * 0.002).alias("lat"), (F.lit(80.6957) + F.col("embedding")[1].cast("double") * 0.002).alias("lon"),
        (F.col("label") % 4).alias("zone"), "label", (F.col("vec_id") % 3 == 0).alias("flag"), F.col("embedding")[2].cast("double").alias("value"),
    )


PLACES = """places AS (SELECT vec_id AS id, 7.3388::DOUBLE + embedding[1]::DOUBLE * 0.002::DOUBLE AS lat, 80.6957::DOUBLE + embedding[2]::DOUBLE * 0.002::DOUBLE AS lon, label % 4 AS zone, label,
 vec_id % 3 = 0 AS flag, embedding[3]::DOUBLE AS value FROM embeddings)"""
HAVERSINE = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as position fixes: an order is a session, eight orders in a row a slot, however many there are."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("session"), F.floor(F.col("l_orderkey") / 8).alias("slot"), F.col("l_linenumber").alias("n_fix"), "l_partkey", "l_suppkey",
        (F.col("l_discount") * 100).alias("x"), (F.col("l_tax") * 100).alias("y"), F.col("l_quantity").cast("double").alias("accuracy"),
    )


FIXES = """fixes AS (SELECT l_orderkey AS session, l_orderkey // 8 AS slot, l_linenumber AS n_fix, l_partkey, l_suppkey, l_discount * 100 AS x, l_tax * 100 AS y, CAST(l_quantity AS DOUBLE) AS accuracy FROM lineitem)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label and a score from their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    df = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    p = (F.col("n_chars") % 1000) / F.lit(1000.0)
    return df.select("doc_id", "lang", "source", "quality", "toxic", p.alias("p"), (p >= 0.5).cast("int").alias("guess"), F.length("lang").alias("len"), "n_chars")


JUDGED = """judged AS (SELECT d.doc_id, lang, source, quality, toxic, (n_chars % 1000) / 1000.0::DOUBLE AS p, CASE WHEN (n_chars % 1000) / 1000.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS guess, n_chars
 FROM documents d JOIN labels USING (doc_id))"""
