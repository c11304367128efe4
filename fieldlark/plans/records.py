"""Queries on record sets, logs and consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.functions import cleaning as fc
from fieldlark.operators import cleaning, records, spatial
from fieldlark.plans.registry import CYCLES, HAVERSINE, PLACES, VISITS, cycles, places, query, table, visits


@query("SELECT sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END)::BIGINT AS dead, count(*) AS n_vines FROM (SELECT DISTINCT o_orderkey FROM orders)")
def mortality_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(2).alias("dead"), F.lit(1).alias("n_vines"), "o_orderdate")
    return records.summed_reports(o.where("id % 3 != 0"), o.where("id % 3 != 1"), "id", "o_orderdate", ["dead", "n_vines"])


@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 7 = 0 THEN 'zone' END, CASE WHEN c_custkey % 5 = 0 THEN 'block' END) AS issues FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0")
def id_layout_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone, block = F.char((F.col("c_custkey") % 4 + 65).cast("int")), F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(zone, block, F.lit("-P001-G1")).alias("plant_id"), F.when(F.col("c_custkey") % 7 == 0, "Z").otherwise(zone).alias("zone"), F.when(F.col("c_custkey") % 5 == 0, "99").otherwise(block).alias("block")
    )
    c = c.withColumn("plant_id", F.concat("plant_id", F.lit("#"), F.col("c_custkey").cast("string")))
    out = records.id_issues(c, "plant_id", {"zone": r"^([A-D])", "block": r"^[A-D](\d{2})-"})
    return out.select(F.substring_index("plant_id", "#", -1).cast("long").alias("c_custkey"), "issues")


@query("WITH " + CYCLES + ", n AS (SELECT max(cycle) AS m FROM cycles) SELECT block AS cluster_id, CAST(count(DISTINCT plant_id) AS INTEGER) AS n, round(greatest(sqrt(max_by(k * 40.0::DOUBLE, event_id) / pi()), 22.0), 6) AS radius_m FROM cycles, n WHERE cycle = m AND block > 0 AND k IS NOT NULL GROUP BY block")
def hotspot_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cycles(spark, sf_dir).where("k is not null").select("cycle", F.col("block").alias("cluster_id"), "plant_id", (F.col("k") * 40.0).alias("area_m2"), F.col("event_id").alias("created_at"))
    return records.hotspot_shapes(c).select("cluster_id", "n", F.round("radius_m", 6).alias("radius_m"))


@query("WITH " + CYCLES + ", t AS (SELECT block AS hotspot_id, cycle, count(*) AS size, count(*) FILTER (foliage = 'Brown') AS added FROM cycles GROUP BY ALL) SELECT hotspot_id, cycle, count(*) OVER w AS persistence, first_value(size) OVER w AS first_size, CAST(sum(added) OVER w AS BIGINT) AS added_total FROM t WINDOW w AS (PARTITION BY hotspot_id ORDER BY cycle ROWS UNBOUNDED PRECEDING)")
def track_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cycles(spark, sf_dir).groupBy(F.col("block").alias("hotspot_id"), "cycle").agg(F.count("*").alias("size"), F.count_if(F.col("foliage") == "Brown").alias("added"))
    return records.track_measures(t).select("hotspot_id", "cycle", "persistence", "first_size", "added_total")


@query("WITH " + VISITS + ", n AS (SELECT block, value, row_number() OVER (PARTITION BY block ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY block) AS n FROM visits WHERE value IS NOT NULL) SELECT block, value AS upper_median FROM n WHERE i = n // 2")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.upper_median(visits(spark, sf_dir), ["block"], "value")


@query("WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT c_nationkey, 1 + i * greatest(1, n // 4) AS number FROM n, range(4) r(i) WHERE i < n")
def tracked_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return records.tracked(n, "c_nationkey", "n", 4)


@query("WITH " + VISITS + ", a AS (SELECT plant_id, max_by(k, ts) AS a FROM visits WHERE plant_id % 3 <> 0 AND event_id % 2 = 0 GROUP BY 1), b AS (SELECT plant_id, max_by(k, ts) AS b FROM visits WHERE event_id % 2 = 1 GROUP BY 1) SELECT plant_id, nullif(coalesce(a, b), 0) AS previous FROM a FULL JOIN b USING (plant_id)")
def previous_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visits(spark, sf_dir)
    return records.previous_height(v.where("plant_id % 3 != 0 and event_id % 2 = 0"), v.where("event_id % 2 = 1"), "plant_id", "ts", "k")


@query("SELECT 'even' AS store, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS pending FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'odd', count(*), count(*) FILTER (o_orderstatus = 'O') FROM orders WHERE o_orderkey % 2 = 1")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return records.store_counts({"even": o.where("o_orderkey % 2 = 0"), "odd": o.where("o_orderkey % 2 = 1")}, F.col("o_orderstatus") == "O")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'synced' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'u' || CAST(o_orderkey AS VARCHAR) END AS url FROM orders")
def sync_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("url"))
    done = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"))
    return records.marked_synced(o, done, "o_orderkey").select("o_orderkey", "status", "url")


@query("WITH c(cls) AS (VALUES ('Green'), ('Mixed'), ('Yellow'), ('Brown'), ('Red')), " + VISITS + " SELECT cls AS foliage, count(event_id) AS n FROM c LEFT JOIN visits ON foliage = cls GROUP BY cls")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.class_counts(visits(spark, sf_dir), "foliage", ["Green", "Mixed", "Yellow", "Brown", "Red"])


@query("SELECT o_orderkey, o_totalprice AS stored, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 END AS new FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0")
def recompute_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    new = o.where("o_orderkey % 13 != 0 or o_orderkey % 11 = 0").withColumn("v", F.when(F.col("o_orderkey") % 11 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return records.recomputed(o, new, ["o_orderkey"], "v")


@query("SELECT o_orderkey, CAST(greatest(0, least(i * 30, n - 40)) AS INTEGER) AS start, CAST(least(greatest(0, least(i * 30, n - 40)) + 40, n) AS INTEGER) AS \"end\" FROM (SELECT o_orderkey, o_orderkey % 200 + 1 AS n FROM orders), range(8) r(i) WHERE i < greatest(1, ceil((n - 10) / 30.0))")
def crop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 200 + 1).alias("n"))
    return records.crop_windows(o, "o_orderkey", "n", 40, 10)


@query()
def derangement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.deranged(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label")


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT user_id AS k FROM events) SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS common, count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b FROM a FULL JOIN b ON a.k = b.k")
def set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.set_counts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "events").select(F.col("user_id").alias("k")), "k")


@query("WITH m AS (SELECT median(value) AS m FROM events WHERE event_id % 17 <> 0) SELECT count(*) AS n, round(avg(abs(value - m)), 6) AS mae FROM events, m WHERE event_id % 17 = 0")
def imputation_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = cleaning.globally_filled(visits(spark, sf_dir).select("event_id", "value"), ["value"])
    return records.imputation_error(filled, table(spark, sf_dir, "events"), ["event_id"], "value").withColumn("mae", F.round("mae", 6))


@query("WITH " + VISITS + "SELECT event_id, CASE WHEN k % 3 = 0 THEN 'none' WHEN k % 3 = 1 THEN event_type ELSE 'gps' END AS kind FROM visits WHERE k IS NOT NULL")
def location_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("k") % 3
    kind = records.location_kind(F.when(m != 0, F.lit(7.3)), F.lit(80.7), F.when(m == 1, F.col("event_type")))
    return visits(spark, sf_dir).where("k is not null").select("event_id", kind.alias("kind"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(revenue, 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT p_partkey, lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g')) AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fc.slug(F.col("p_brand")).alias("slug"))


@query("WITH " + PLACES + ", i AS (SELECT zone, id, value, row_number() OVER (PARTITION BY zone ORDER BY value DESC, id) AS r FROM places) SELECT zone, list(id ORDER BY r)::VARCHAR AS ids FROM i WHERE r <= 3 GROUP BY zone")
def top_values_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlark.operators import twin

    top = twin.recent(places(spark, sf_dir), ["zone"], [F.desc("value"), F.asc("id")], 3)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"].cast("string"))
    return top.groupBy("zone").agg(F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("ids"))


@query(
    "WITH " + PLACES + f""", p AS (SELECT *, label * 2.0::DOUBLE AS acc FROM places), n AS (SELECT DISTINCT a.id FROM p a JOIN p b ON a.id <> b.id AND a.zone = b.zone WHERE {HAVERSINE.format(a="a", b="b")} <= 75.0)
SELECT id, acc > 15 AS poor, count(*) OVER (PARTITION BY lat, lon) > 1 AS shared, id NOT IN (SELECT id FROM n) AS isolated FROM p"""
)
def layout_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).withColumn("acc", F.col("label") * 2.0)
    return spatial.layout_flags(p, "id", "acc")
