"""Queries that go through files: what is written is read back, and must be what the tables hold."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.operators import records
from fieldlark.operators.lineage import shared_dir
from fieldlark.plans.registry import PLACES, places, query, table
from fieldlark.plans.spatial import RINGS
from fieldlark.sources import readers, simulate, writers
from fieldlark.streaming import sync


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"


_BLANK = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).otherwise("").alias("c_mktsegment"))


@query(_BLANK)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    _customers(spark, sf_dir).write.option("header", True).option("emptyValue", "").csv(path)
    return readers.text_csv(spark, path, ["c_custkey", "c_name", "c_mktsegment"])


@query(_BLANK)
def csv_with_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte order mark before the header, as some programs write it."""
    path = _path(spark)
    _customers(spark, sf_dir).withColumnRenamed("c_custkey", "﻿c_custkey").write.option("header", True).option("emptyValue", "").csv(path)
    return readers.checked_csv(spark, path, ["c_custkey", "c_name"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def filtered_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_name"], {"c_nationkey": 7})


@query("SELECT n_name, count(*) AS n_customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document with a list inside, over several lines."""
    path = _path(spark)
    nations = [{"name": r.n_name, "key": r.n_nationkey} for r in table(spark, sf_dir, "nation").collect()]  # 25 rows
    spark.createDataFrame([(json.dumps({"nations": nations}, indent=1),)], "value string").coalesce(1).write.text(path)
    docs = readers.json_documents(spark, path, "nations array<struct<name:string,key:int>>").select(F.explode("nations").alias("n"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("n_customers"))
    return docs.select(F.col("n.name").alias("n_name"), F.col("n.key").alias("key")).join(c, "key").drop("key")


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 < 2")
def json_lines_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, e = _path(spark), table(spark, sf_dir, "events").select("event_id", "user_id")
    for k in range(2):
        writers.append_json(e.where(F.col("event_id") % 3 == k), path)
    return readers.json_lines(spark, path, "event_id long, user_id long")


def _collection(spark: SparkSession) -> str:
    path = _path(spark)
    ring = lambda r: [[*map(list, r), list(r[0])]]
    counts = {"north": "12", "wedge": "none"}
    features = [{"type": "Feature", "properties": {"name": n, "planted": counts[n]}, "geometry": {"type": "Polygon", "coordinates": ring(r)}} for n, r in RINGS.items()]
    spark.createDataFrame([(json.dumps({"type": "FeatureCollection", "features": features}),)], "value string").coalesce(1).write.text(path)
    return path


@query(
    "WITH "
    + PLACES
    + """, e AS (SELECT * FROM (VALUES ('north', 80.6950::DOUBLE, 7.3388::DOUBLE, 80.6965::DOUBLE, 7.3388::DOUBLE), ('north', 80.6965, 7.3388, 80.6965, 7.3400), ('north', 80.6965, 7.3400, 80.6950, 7.3400), ('north', 80.6950, 7.3400, 80.6950, 7.3388),
 ('wedge', 80.6954, 7.3380, 80.6960, 7.3384), ('wedge', 80.6960, 7.3384, 80.6956, 7.3390), ('wedge', 80.6956, 7.3390, 80.6954, 7.3380)) t(name, x1, y1, x2, y2)),
h AS (SELECT p.id, e.name FROM places p JOIN e ON (y1 > p.lat) <> (y2 > p.lat) AND p.lon < (x2 - x1) * (p.lat - y1) / (y2 - y1) + x1) SELECT id, name FROM h GROUP BY ALL HAVING count(*) % 2 = 1"""
)
def zones_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return readers.zones_of_points(p, readers.geojson_rings(spark, _collection(spark), "name"), "id")


@query("SELECT c_nationkey::VARCHAR AS block, sum(CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS planted FROM customer GROUP BY ALL HAVING sum(CASE WHEN c_acctbal > 0 THEN c_acctbal END) > 0 AND c_nationkey % 5 > 0")
def planted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature collection of the nations, written by Spark; where a nation's count is no number it is left out."""
    path = _path(spark)
    total = F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).cast("string")
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(total.alias("v"))
    n = n.withColumn("v", F.when(F.col("k") % 5 > 0, F.col("v")).otherwise(F.element_at(F.array(*map(F.lit, ["none", "NaN", "Infinity", "-3", "0"])), (F.floor(F.col("k") / 5) + 1).cast("int"))))
    feature = F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("block"), F.col("k").cast("string"), F.lit("planted"), F.col("v")).alias("properties"))
    n.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value")).coalesce(1).write.text(path)  # 25 nations
    return readers.planted_counts(spark, path, "block", "planted")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, c = _path(spark), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    for k in (1, 0):
        writers.replace_table(c.where(F.col("c_custkey") % 2 == k), path)
    return spark.read.parquet(path)


@query("SELECT n_nationkey, n_name FROM nation")
def frozen_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is frozen stays as it is; a second write without force is an error."""
    from pyspark.errors import AnalysisException

    path, n = _path(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    writers.frozen(n, path)
    try:
        writers.frozen(n.limit(1), path)
    except AnalysisException:
        return spark.read.parquet(path)
    raise AssertionError("a frozen output was replaced")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def upserted_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, e = _path(spark), table(spark, sf_dir, "events")
    for k in range(3):
        batch = e.where(F.col("event_id") % 3 == k).groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
        writers.upsert_table(batch, path, ["user_id", "event_type"], "event_id")
    return writers.current_table(spark, path)


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    writers.report(table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), path)
    return readers.json_lines(spark, path, "c_nationkey int, n long")


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS nation, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments, 'the "' || CAST(c_nationkey AS VARCHAR) || '", so' AS said FROM customer GROUP BY c_nationkey""")
def exported_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    nation = F.col("c_nationkey").cast("string")
    own = table(spark, sf_dir, "customer").groupBy(nation.alias("nation")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    writers.export_csv(own.withColumn("said", F.concat(F.lit('the "'), "nation", F.lit('", so'))), path)
    return spark.read.schema("nation string, segments string, said string").option("header", True).option("escape", '"').csv(path)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE o_orderstatus END AS o_orderstatus, '-' AS remarks, 'a, ' || o_orderpriority AS tags FROM orders")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.array(F.lit("a"), "o_orderpriority").alias("tags"))
    return writers.sheet_rows(o, ["o_orderkey", "o_orderstatus", "remarks", "tags"], "-")


@query("SELECT 'k:' || CAST(c_custkey AS VARCHAR) || ';n:' || c_name AS pairs, c_custkey FROM customer")
def flat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    pairs = F.array(pair("k", F.col("c_custkey")), pair("n", F.col("c_name")))
    return table(spark, sf_dir, "customer").select(writers.flat_pairs(pairs).alias("pairs"), "c_custkey")


@query("SELECT CAST(length(s) AS BIGINT) AS bytes, sha256(s) AS sha256 FROM (SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS s FROM nation)")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    return readers.file_digests(spark, f"{path}/part-*").select("bytes", "sha256")


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 < 3 AND p_retailprice * 8000 <= 10000000 AND CAST(p_size AS BIGINT) * 200 * 5000 <= 50000000 AND greatest(p_size * 200, 5000) <= 20.0 * least(p_size * 200, 5000)")
def acceptable_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey") % 4
    name = F.concat(F.lit("img"), F.col("p_partkey").cast("string"), F.when(i == 0, ".jpg").when(i == 1, ".PNG").when(i == 2, ".webp").otherwise(".gif"))
    files = table(spark, sf_dir, "part").select("p_partkey", name.alias("path"), (F.col("p_retailprice") * 8000).alias("length"), (F.col("p_size") * 200).alias("width"), F.lit(5000).alias("height"))
    return readers.acceptable_images(files).select("p_partkey")


@query("SELECT event_id, round(value, 3) AS v, CASE WHEN event_id % 5 <> 0 THEN round(value / 7, 3) END AS w FROM events")
def evidence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = table(spark, sf_dir, "events"), F.col("value").cast("double")
    made = e.select("event_id", writers.evidence_json({"v": v, "w": F.when(F.col("event_id") % 5 != 0, v / 7).otherwise(float("nan"))}).alias("j"))
    return made.select("event_id", *[F.get_json_object("j", f"$.{c}").cast("double").alias(c) for c in "vw"])


@query("SELECT p_partkey AS plant, p_partkey // 40 AS block, (p_partkey // 40) * 22.5::DOUBLE + p_partkey % 40 % 7 * 2.5::DOUBLE AS x, (p_partkey % 40 // 7) * 2.5::DOUBLE AS y FROM part")
def simulated_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a plant; 40 plants are a block."""
    return simulate.layout(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), 40)


@query("SELECT vec_id AS plant, 30::BIGINT AS n, true AS near, true AS wide, true AS accurate FROM embeddings")
def simulated_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty fixes around each place: their mean is within 1.5 of it, their deviation is that asked for within bounds, accuracies are 3 to 12."""
    plants = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("plant"), (F.col("embedding")[0] * 100).cast("double").alias("x"), (F.col("embedding")[1] * 100).cast("double").alias("y"))
    each = simulate.noisy_fixes(plants, 30, 1.5).join(plants.toDF("plant", "px", "py"), "plant").groupBy("plant", "px", "py")
    found = each.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_samp("x").alias("sx"), F.min("accuracy").alias("lo"), F.max("accuracy").alias("hi"))
    return found.select("plant", "n", (F.hypot(F.col("mx") - F.col("px"), F.col("my") - F.col("py")) < 1.5).alias("near"), F.col("sx").between(0.6, 2.6).alias("wide"), ((F.col("lo") >= 3) & (F.col("hi") <= 12)).alias("accurate"))


@query(
    """WITH p AS (SELECT vec_id AS plant, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings), s AS (SELECT x AS sx, y AS sy FROM p ORDER BY plant LIMIT 1), d AS (SELECT plant, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS d FROM p, s)
SELECT plant, cycle FROM d, range(4) c(cycle) WHERE d <= 5 * (1 + 0.3 * cycle)"""
)
def simulated_hotspot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A focus that reaches all plants within 5 and a third more each cycle, from the plant of the least number."""
    plants = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("plant"), (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"))
    start = plants.orderBy("plant").limit(1)
    return simulate.planted_hotspots(plants, 4, 5.0, share=1.0, start=start).withColumn("cycle", F.col("cycle").cast("long"))


@query("SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 11 <> 0 GROUP BY user_id")
def synced_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue of records through a stream into a table; records without a user go to the dead letters."""
    src, target, e = _path(spark), _path(spark), table(spark, sf_dir, "events")
    e.select(F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("user_id"), "event_id").write.json(src)
    stream = sync.record_stream(spark, src, "user_id long, event_id long")
    sync.sync(stream, target, _path(spark), ["user_id"], "event_id", F.col("user_id").isNotNull(), _path(spark)).awaitTermination()
    return writers.current_table(spark, target)


@query("SELECT count(*) AS n FROM events WHERE event_id % 11 = 0")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, dead, e = _path(spark), _path(spark), table(spark, sf_dir, "events")
    e.select(F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("user_id"), "event_id").write.json(src)
    stream = sync.record_stream(spark, src, "user_id long, event_id long")
    sync.sync(stream, _path(spark), _path(spark), ["user_id"], "event_id", F.col("user_id").isNotNull(), dead).awaitTermination()
    return spark.read.parquet(dead).agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT user_id AS session, ts, (event_id % 40)::DOUBLE AS accuracy, min(ts) OVER (PARTITION BY user_id) AS began FROM events), g AS (SELECT *, sum((accuracy <= 10)::INTEGER) OVER (PARTITION BY session ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (accuracy <= 10)::INTEGER AS before FROM e),
k AS (SELECT * FROM g WHERE before < 3 AND ts <= began + INTERVAL 12 DAY), s AS (SELECT session, min(ts) AS began, max(ts) AS ended, count(*) AS n_fixes, sum((accuracy <= 10)::INTEGER)::BIGINT AS n_good FROM k GROUP BY ALL)
SELECT session, began, ended, n_fixes, n_good, CASE WHEN n_good >= 3 THEN 'enough' WHEN (SELECT max(ts) FROM events) > began + INTERVAL 12 DAY THEN 'timeout' ELSE 'open' END AS reason FROM s"""
)
def capture_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a session, which ends with its third fix of an accuracy of 10 or after 12 days."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 40).alias("accuracy"))
    out = sync.captures(e, "user_id", 3, 10.0, 12 * 86_400.0)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("began", "ended")})


@query(
    """WITH RECURSIVE r AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id UNION ALL SELECT r.user_id, min(e.ts) FROM r JOIN events e ON e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 2 DAY GROUP BY r.user_id)
SELECT user_id, ts FROM r"""
)
def spaced_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return sync.accepted_fixes(e, "user_id", 172_800.0).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT c_custkey, c_name FROM customer")
def snapshot_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty server table, then a snapshot that is there."""
    path, c = _path(spark), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    c.write.parquet(path)
    return records.first_complete([c.limit(0), spark.read.parquet(path), c.limit(1)])


@query("SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'customer', count(*) FROM customer")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.table_counts({n: table(spark, sf_dir, n) for n in ("nation", "region", "customer")})


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 3")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look at a table's first rows, which is what the operator is for."""
    return records.sample_rows(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_name")
