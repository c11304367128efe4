"""Queries on the latest-state view, cleaning and record merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.functions import cleaning as fc
from fieldlark.operators import cleaning, trends, twin
from fieldlark.plans.registry import CYCLES, VISITS, cycles, query, table, visits

AS_OF = "2024-02-20"
_STATUS = """CASE WHEN o_orderkey % 7 = 0 THEN 'high-risk' WHEN o_orderkey % 7 = 1 THEN 'moderate' WHEN o_orderkey % 7 = 2 THEN 'healthy' WHEN last_day IS NULL THEN 'not-inspected' WHEN foliage = 'Red' THEN 'dead' WHEN foliage = 'Brown' OR ph < 5.5 OR ph > 7 THEN 'high-risk'
 WHEN foliage IN ('Yellow', 'Mixed') OR (ph >= 5.5 AND ph < 6) OR (ph > 6.5 AND ph <= 7) THEN 'moderate' ELSE 'healthy' END"""
_STATE = (
    "WITH "
    + VISITS
    + f""", plants AS (SELECT c_custkey AS plant_id, n_nationkey AS block, r_regionkey AS zone, CASE WHEN c_custkey % 9 <> 0 THEN 7.3 END AS latitude, CASE c_custkey % 5 WHEN 0 THEN 'estimated' WHEN 1 THEN 'single_fix' WHEN 2 THEN 'smoothed' WHEN 4 THEN 'gps' END AS source FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
seen AS (SELECT plant_id, foliage, ph, day AS last_day, event_id FROM (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM visits) WHERE rn = 1),
sold AS (SELECT o_custkey AS plant_id, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1),
s0 AS (SELECT p.plant_id, p.block, p.zone, p.latitude, p.source, v.foliage, v.ph, v.last_day, v.event_id, o.o_orderkey, o.o_totalprice FROM plants p LEFT JOIN seen v USING (plant_id) LEFT JOIN sold o USING (plant_id)),
state AS (SELECT *, {_STATUS} AS status FROM s0) """
)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    plants = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    i = F.col("c_custkey") % 5
    source = F.when(i == 0, "estimated").when(i == 1, "single_fix").when(i == 2, "smoothed").when(i == 4, "gps")
    place = [F.when(F.col("c_custkey") % 9 != 0, F.lit(v)).alias(n) for n, v in (("latitude", 7.3), ("longitude", 80.6))]
    plants = plants.select(F.col("c_custkey").alias("plant_id"), F.col("n_nationkey").alias("block"), F.col("r_regionkey").alias("zone"), *place, source.alias("location_source"))
    seen = twin.latest(visits(spark, sf_dir), "plant_id", "ts", "event_id").select("plant_id", "foliage", "ph", F.col("day").alias("last_day"), "event_id")
    sold = twin.latest(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "plant_id"), "plant_id", "o_orderdate", "o_orderkey").select("plant_id", "o_orderkey", "o_totalprice")
    df = twin.twin_state(plants, "plant_id", {"seen": seen, "sold": sold})
    df = df.withColumnsRenamed({"seen_foliage": "foliage", "seen_ph": "ph", "seen_last_day": "last_day", "seen_event_id": "event_id", "sold_o_orderkey": "o_orderkey", "sold_o_totalprice": "o_totalprice"})
    j = F.col("o_orderkey") % 7
    spoken = F.when(j == 0, "Poor").when(j == 1, "MODERATE").when(j == 2, "healthy").when(j == 3, "unheard of")
    return df.withColumn("status", twin.status(spoken, F.col("foliage"), F.col("ph"), F.col("last_day")))


@query(_STATE + "SELECT plant_id, block, zone, status, last_day, event_id, o_orderkey, o_totalprice FROM state")
def twin_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(spark, sf_dir).select("plant_id", "block", "zone", "status", "last_day", "event_id", "o_orderkey", "o_totalprice")


@query(
    _STATE
    + """, planted AS (SELECT n_nationkey AS block, 60 AS planted FROM nation),
own AS (SELECT block, count(*) AS n_plants, count(*) FILTER (status <> 'not-inspected') AS n_inspected, count(*) FILTER (status IN ('high-risk', 'dead')) AS n_risk, max(last_day) AS last_day FROM state GROUP BY block)
SELECT block, planted, coalesce(n_plants, 0) AS n_plants, coalesce(n_inspected, 0) AS n_inspected, coalesce(n_risk, 0) AS n_risk, last_day, round(n_risk / nullif(n_inspected, 0), 6) AS risk_share,
 CASE WHEN coalesce(n_inspected, 0) = 0 THEN 'no-data' WHEN n_inspected < 5 OR n_inspected / planted < 0.2 THEN 'insufficient' WHEN n_risk / n_inspected >= 0.3 THEN 'concern' WHEN n_risk / n_inspected >= 0.1 THEN 'watch' ELSE 'good' END AS level
FROM planted FULL JOIN own USING (block)"""
)
def block_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("block"), F.lit(60).alias("planted"))
    out = twin.block_rollup(state(spark, sf_dir), planted, ["block"])
    return out.select("block", "planted", "n_plants", "n_inspected", "n_risk", "last_day", F.round("risk_share", 6).alias("risk_share"), "level")


@query(_STATE + "SELECT zone, status, count(*) AS n FROM state GROUP BY ALL")
def zone_status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twin.status_totals(state(spark, sf_dir), ["zone"])


@query(
    _STATE
    + f"""SELECT count(*) AS total, count(last_day) AS inspected, round(count(last_day) / count(*), 6) AS coverage, count(*) FILTER (date_diff('day', last_day, DATE '{AS_OF}') > 45) AS stale,
 round(count(*) FILTER (date_diff('day', last_day, DATE '{AS_OF}') > 45) / nullif(count(last_day), 0), 6) AS stale_share, max(last_day) AS newest, count(*) FILTER (latitude IS NOT NULL AND coalesce(source, 'gps') = 'gps') AS n_gps,
 count(*) FILTER (latitude IS NOT NULL AND source = 'smoothed') AS n_smoothed, count(*) FILTER (latitude IS NOT NULL AND source = 'single_fix') AS n_single_fix, count(*) FILTER (latitude IS NOT NULL AND source = 'estimated') AS n_estimated, count(*) FILTER (latitude IS NULL) AS n_none FROM state"""
)
def data_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twin.data_trust(state(spark, sf_dir), F.to_date(F.lit(AS_OF))).withColumns({c: F.round(c, 6) for c in ("coverage", "stale_share")})


@query(
    _STATE
    + f""", d AS (SELECT *, date_diff('day', last_day, DATE '{AS_OF}') AS days, CASE WHEN plant_id % 2 = 0 THEN block % 6 END AS h FROM state WHERE status <> 'dead'),
p AS (SELECT plant_id, status, days, CASE WHEN h = 0 THEN 100 ELSE 0 END + CASE WHEN status = 'high-risk' AND days > 45 THEN 80 ELSE 0 END + CASE WHEN h = 1 THEN 60 ELSE 0 END + CASE WHEN status = 'moderate' AND days > 45 THEN 50 ELSE 0 END
 + CASE WHEN status = 'not-inspected' THEN 40 ELSE 0 END + CASE WHEN latitude IS NULL OR source IN ('estimated', 'single_fix') THEN 15 ELSE 0 END AS priority FROM d)
SELECT plant_id, status, days, priority FROM p WHERE priority > 0 ORDER BY priority DESC, days DESC NULLS FIRST, plant_id LIMIT 50"""
)
def field_plan_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state(spark, sf_dir)
    plan = twin.field_plan(twin.members_decoded(s, _hotspots(s)), F.to_date(F.lit(AS_OF)))
    return twin.top_of_plan(plan, "plant_id", 50).select("plant_id", "status", F.col("days").cast("long").alias("days"), "priority")


def _hotspots(s: DataFrame) -> DataFrame:
    """Hotspots of half the plants of some blocks."""
    i = F.col("block") % 6
    cause = F.when(i == 0, "likely_disease").when(i == 1, "uncertain_expert_review").otherwise("likely_nutrient_deficiency")
    own = s.where("plant_id % 2 = 0 and block % 6 < 3").groupBy("block").agg(F.collect_list("plant_id").alias("member_plant_ids"))
    return own.select(F.col("block").alias("hotspot_id"), F.lit(1).alias("cycle"), "member_plant_ids", cause.alias("likely_cause"))


@query(_STATE + "SELECT plant_id, CASE WHEN plant_id % 2 = 0 AND block % 6 < 3 THEN block END AS hotspot_id FROM state")
def hotspot_of_plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state(spark, sf_dir)
    return twin.members_decoded(s, _hotspots(s)).select("plant_id", "hotspot_id")


@query(_STATE + "SELECT plant_id, CASE WHEN last_day IS NULL THEN 'healthy' WHEN foliage = 'Red' THEN 'dead' WHEN foliage = 'Brown' OR ph < 5.5 OR ph > 7 THEN 'high-risk' WHEN foliage IN ('Yellow', 'Mixed') OR (ph >= 5.5 AND ph < 6) OR (ph > 6.5 AND ph <= 7) THEN 'moderate' ELSE 'healthy' END AS status FROM state")
def block_page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(spark, sf_dir).select("plant_id", twin.block_status(F.col("foliage"), F.col("ph"), F.col("last_day")).alias("status"))


@query("WITH " + VISITS + "SELECT plant_id, max(ts) AS ts, arg_max(foliage, ts) AS foliage FROM visits GROUP BY plant_id")
def latest_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twin.latest_by_max(visits(spark, sf_dir), "plant_id", "ts", ["ts", "foliage"])


@query(_STATE + f"SELECT plant_id, zone FROM state WHERE zone = 2 AND status IN ('high-risk', 'moderate') AND coalesce(date_diff('day', last_day, DATE '{AS_OF}') > 45, false) = false AND contains(lower(CAST(plant_id AS VARCHAR)), '1')")
def map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = twin.map_filter(state(spark, sf_dir), 2, ["high-risk", "moderate"], False, F.to_date(F.lit(AS_OF)), "1", ["plant_id"])
    return df.select("plant_id", "zone")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '12') OR contains(lower(c_mktsegment), 'auto')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twin.search(table(spark, sf_dir, "customer"), "12", ["c_name"]).unionByName(twin.search(table(spark, sf_dir, "customer"), "auto", ["c_mktsegment"])).distinct().select("c_custkey", "c_name")


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' Green ' WHEN 1 THEN 'YELOW' WHEN 2 THEN 'n/a' WHEN 3 THEN 'brwn' ELSE event_type END AS raw FROM events)
SELECT event_id, CASE lower(trim(raw)) WHEN 'green' THEN 'Green' WHEN 'yelow' THEN 'Yellow' WHEN 'brwn' THEN 'Brown' END AS foliage, lower(trim(raw)) = 'n/a' AS was_null FROM t"""
)
def clean_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 5
    raw = F.when(i == 0, " Green ").when(i == 1, "YELOW").when(i == 2, "n/a").when(i == 3, "brwn").otherwise(F.col("event_type"))
    df = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    null = cleaning.normalize_nulls(df)
    return null.select("event_id", fc.category(F.col("raw"), fc.CATEGORIES["foliage_color"]).alias("foliage"), F.col("raw").isNull().alias("was_null"))


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN CAST(l_suppkey AS VARCHAR) || '%' WHEN 1 THEN CAST(l_suppkey AS VARCHAR) || ',5 C' WHEN 2 THEN 'x' ELSE CAST(l_suppkey AS VARCHAR) END AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, TRY_CAST(regexp_replace(replace(raw, ',', '.'), '[^0-9.\\-]', '', 'g') AS DOUBLE) AS number, regexp_full_match(raw, '[0-9]+') AS is_number FROM t"""
)
def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("l_linenumber") % 4, F.col("l_suppkey").cast("string")
    raw = F.when(i == 0, F.concat(s, F.lit("%"))).when(i == 1, F.concat(s, F.lit(",5 C"))).when(i == 2, "x").otherwise(s)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fc.number(raw).alias("number"), fc.is_number(raw).alias("is_number"))


@query(
    """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00' WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
  WHEN 3 THEN strftime(o_orderdate, '%d-%b-%Y') ELSE 'soon' END AS raw FROM orders)
SELECT o_orderkey, d AS date, CASE WHEN raw = 'soon' THEN 'reconciled_from_created_at' ELSE 'ok' END AS status FROM t"""
)
def clean_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = lambda f: F.date_format(d, f)
    raw = F.when(i == 0, F.concat(text("yyyy-MM-dd"), F.lit("T00:00"))).when(i == 1, text("dd/MM/yyyy")).when(i == 2, text("MM/dd/yyyy")).when(i == 3, text("dd-MMM-yyyy")).otherwise("soon")
    r = fc.reconciled_date(raw, F.to_date(d), F.to_date(F.lit("1990-01-01")), F.to_date(F.lit("2030-01-01")))
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", "r.date", "r.status")


@query(
    """WITH t AS (SELECT c_custkey, 'a' || CAST(c_nationkey % 9 + 1 AS VARCHAR) || '_p' || CAST(c_custkey % 100 AS VARCHAR) || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '-g1' END AS raw, c_nationkey % 9 + 1 AS z, c_custkey % 100 AS p FROM customer)
SELECT c_custkey, 'A0' || CAST(z AS VARCHAR) || '-P' || lpad(CAST(p AS VARCHAR), 3, '0') || '-G1' AS plant_id, 'A0' || CAST(z AS VARCHAR) || '-P' || lpad(CAST(p AS VARCHAR), 3, '0') AS slot_id FROM t WHERE c_custkey % 7 <> 0"""
)
def clean_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("a"), (F.col("c_nationkey") % 9 + 1).cast("string"), F.lit("_p"), (F.col("c_custkey") % 100).cast("string"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise("-g1"))
    df = cleaning.clean_ids(table(spark, sf_dir, "customer").select("c_custkey", raw.alias("plant_id")))
    return df.withColumn("slot_id", fc.slot_id(F.col("plant_id")))


@query(
    """SELECT l_orderkey, l_linenumber, 'l_quantity' AS column_name, CAST(l_quantity AS DOUBLE) AS bad_value FROM lineitem WHERE NOT (l_quantity BETWEEN 5 AND 45)
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem WHERE NOT (l_tax BETWEEN 0.01 AND 0.07)"""
)
def range_rule_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.range_log(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], {"l_quantity": (5, 45), "l_tax": (0.01, 0.07)})


@query("WITH " + VISITS + "SELECT event_id, CASE WHEN abs(value - median(value) OVER (PARTITION BY day)) <= 20 THEN value END AS value FROM visits")
def daily_context_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.daily_outliers(visits(spark, sf_dir), "day", {"value": 20.0}).select("event_id", "value")


_TS = """h AS (SELECT o_custkey AS c, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x, o_totalprice AS y FROM orders), n AS (SELECT c, count(*) AS n, median(x) AS mx, median(y) AS my FROM h GROUP BY c HAVING count(*) >= 4),
s AS (SELECT a.c, median((b.y - a.y) / (b.x - a.x)) AS slope FROM h a JOIN h b ON a.c = b.c AND b.x > a.x GROUP BY a.c)"""


@query("WITH " + _TS + " SELECT c AS o_custkey, n, round(slope, 4) AS slope, round(my - slope * mx, 3) AS intercept FROM n JOIN s USING (c)")
def theil_sen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    df = cleaning.theil_sen(table(spark, sf_dir, "orders").select("o_custkey", x.alias("x"), F.col("o_totalprice").alias("y")), "o_custkey", "x", "y")
    return df.select("o_custkey", F.col("n").cast("long").alias("n"), F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query(
    "WITH " + _TS + """, f AS (SELECT o_orderkey, o_custkey AS c, o_totalprice AS y, slope, o_totalprice - (slope * date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + my - slope * mx) AS r FROM orders LEFT JOIN (SELECT c, slope, mx, my FROM n JOIN s USING (c)) l ON l.c = o_custkey),
d AS (SELECT *, abs(r - median(r) OVER (PARTITION BY c)) AS d FROM f) SELECT o_orderkey, CASE WHEN slope IS NULL OR abs(r) <= greatest(25.0, 4 * 1.4826 * median(d) OVER (PARTITION BY c)) THEN y END AS y FROM d"""
)
def height_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", x.alias("x"), F.col("o_totalprice").alias("y"))
    return cleaning.height_outliers(o, "o_custkey", "x", "y").select("o_orderkey", "y")


@query("WITH " + VISITS + "SELECT plant_id, day, event_id FROM (SELECT *, row_number() OVER (PARTITION BY plant_id, day ORDER BY ts DESC, event_id DESC) AS rn FROM visits) WHERE rn = 1")
def same_day_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.keep_latest(visits(spark, sf_dir), ["plant_id", "day"], [F.desc("ts"), F.desc("event_id")]).select("plant_id", "day", "event_id")


@query(
    "WITH "
    + VISITS
    + """SELECT 'value' AS column_name, count(*) FILTER (value IS NULL) AS n_missing, min(value) AS low, round(median(value), 6) AS middle, max(value) AS high FROM visits
UNION ALL SELECT 'k', count(*) FILTER (k IS NULL), CAST(min(k) AS DOUBLE), CAST(median(k) AS DOUBLE), CAST(max(k) AS DOUBLE) FROM visits"""
)
def quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.column_profile(visits(spark, sf_dir), ["value", "k"]).withColumn("middle", F.round("middle", 6))


@query("WITH " + VISITS + "SELECT plant_id, day, count(*) AS n FROM visits GROUP BY ALL HAVING count(*) > 1")
def duplicate_day_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.duplicate_groups(visits(spark, sf_dir), ["plant_id", "day"])


@query("SELECT count(*) AS n_rows, count(*) AS bad_ids, count(*) FILTER (c_mktsegment NOT SIMILAR TO '[0-9]{4}-.*') AS non_iso_dates, count(*) AS non_numeric, count(DISTINCT c_name) AS spellings FROM customer")
def raw_text_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.text_audit(table(spark, sf_dir, "customer"), "c_name", "c_mktsegment", "c_name")


@query("WITH " + VISITS + ", m AS (SELECT median(value) AS m FROM visits) SELECT event_id, round(coalesce(value, m), 6) AS value, value IS NULL AS value_imputed FROM visits, m")
def global_median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.globally_filled(visits(spark, sf_dir), ["value"]).select("event_id", F.round("value", 6).alias("value"), "value_imputed")


_DAILY = ", daily AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plant_id, day ORDER BY ts DESC, event_id DESC) AS rn FROM visits) WHERE rn = 1)"
_INTERP = (
    "WITH "
    + VISITS
    + _DAILY
    + """, n AS (SELECT plant_id, block, day, event_id, value,
 last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER a AS d0, last_value(value IGNORE NULLS) OVER a AS v0,
 first_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER b AS d1, first_value(value IGNORE NULLS) OVER b AS v1 FROM daily
 WINDOW a AS (PARTITION BY plant_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY plant_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT plant_id, block, day, event_id, coalesce(value, v0 + (v1 - v0) * (CAST(date_diff('day', d0, day) AS DOUBLE) / nullif(date_diff('day', d0, d1), 0)), v0, v1) AS value FROM n) """
)


@query(_INTERP + "SELECT event_id, round(value, 6) AS value FROM f")
def interp_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = cleaning.keep_latest(visits(spark, sf_dir), ["plant_id", "day"], [F.desc("ts"), F.desc("event_id")])
    return cleaning.interpolated(daily, "plant_id", "day", "value").select("event_id", F.round("value", 6).alias("value"))


@query(
    "WITH "
    + VISITS
    + """, a AS (SELECT event_id, block, day, coalesce(value, median(value) OVER (PARTITION BY block, day)) AS value FROM visits), b AS (SELECT event_id, coalesce(value, median(value) OVER (PARTITION BY block)) AS value FROM a)
SELECT event_id, round(value, 6) AS value FROM b"""
)
def hierarchical_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.median_filled(visits(spark, sf_dir), "value", [["block", "day"], ["block"]]).select("event_id", F.round("value", 6).alias("value"))


@query("WITH " + VISITS + "SELECT event_id, least(10.0, greatest(1.0, round_even(value / 10, 0))) AS value FROM visits WHERE value IS NOT NULL")
def rounded_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = visits(spark, sf_dir).where("value is not null").withColumn("value", F.col("value") / 10)
    return cleaning.rounded_readings(df, {"value": 0}, {"value": (1.0, 10.0)}).select("event_id", "value")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.o_custkey AND CAST(e.ts AS DATE) = CAST(o.o_orderdate AS DATE)) AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.o_custkey)")
def anti_join_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"))
    return twin.incremental(table(spark, sf_dir, "orders"), done, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query(
    """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 1)
SELECT c_custkey, coalesce(a.c_name, b.c_name) AS c_name, a.c_acctbal, b.c_mktsegment FROM a FULL JOIN b USING (c_custkey)"""
)
def merge_local_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    local = c.where("c_custkey % 3 != 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("c_name"), "c_acctbal")
    return twin.merged(local, c.where("c_custkey % 3 != 1").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")


@query(
    """WITH a AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT c_custkey AS id, 'remote' AS name FROM customer WHERE c_custkey % 2 = 0)
SELECT id, name FROM a UNION ALL SELECT id, name FROM b WHERE id NOT IN (SELECT id FROM a)"""
)
def union_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    local = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return twin.prefer(local, c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("remote").alias("name")), ["id"])


@query(
    """SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id % 2 DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def upsert_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    one = lambda df: twin.latest(df.withColumn("_k", F.concat_ws("|", "user_id", "event_type")), "_k", "ts", "event_id").drop("_k")
    return twin.upsert(one(e.where("event_id % 2 = 0")), one(e.where("event_id % 2 = 1")), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id", "ts")


@query(
    """WITH a AS (SELECT user_id, max_by(value, event_id) AS value, max(ts) AS ts FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT user_id, max_by(value, event_id) AS value, max(ts) AS ts FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
SELECT user_id, CASE WHEN b.ts IS NULL OR a.ts >= b.ts THEN a.value ELSE b.value END AS value FROM a FULL JOIN b USING (user_id)"""
)
def settings_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    side = lambda r: e.where(f"event_id % 2 = {r}").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("ts").alias("ts"))
    return twin.last_writer(side(0), side(1), "user_id", "value", "ts").select("user_id", "value")


@query("SELECT c_custkey AS id, 'local' AS name FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 <> 0")
def pull_protects_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    local = c.select(F.col("c_custkey").alias("id"), F.lit("local").alias("name"))
    return twin.pull(local, c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id", F.col("id") % 5 == 0)


@query(
    """WITH z AS (SELECT * FROM (VALUES ('A', 5, 5), ('B', 4, 8), ('C', 3, 8), ('D', 2, 10)) t(z, b, p)), e AS (SELECT z || lpad(CAST(i AS VARCHAR), 2, '0') || '-P' || lpad(CAST(j AS VARCHAR), 3, '0') AS s FROM z, range(1, 6) r(i), range(1, 11) q(j) WHERE i <= b AND j <= p),
f AS (SELECT chr(CAST(65 + c_custkey % 4 AS INTEGER)) || '0' || CAST(c_nationkey % 6 + 1 AS VARCHAR) || '-P' || lpad(CAST(c_custkey % 11 + 1 AS VARCHAR), 3, '0') AS s, count(*) AS n FROM customer GROUP BY ALL),
b AS (SELECT e.s AS es, f.s AS fs, n FROM e FULL JOIN f ON e.s = f.s)
SELECT state, n FROM (SELECT 'present' AS state, count(*) FILTER (es IS NOT NULL AND fs IS NOT NULL) AS n FROM b UNION ALL SELECT 'missing', count(*) FILTER (fs IS NULL) FROM b UNION ALL SELECT 'unexpected', count(*) FILTER (es IS NULL) FROM b UNION ALL SELECT 'duplicate', count(*) FILTER (n > 1) FROM b) WHERE n > 0"""
)
def expected_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    slot = F.concat(F.char((F.col("c_custkey") % 4 + 65).cast("int")), F.lit("0"), (F.col("c_nationkey") % 6 + 1).cast("string"), F.lit("-P"), F.lpad((F.col("c_custkey") % 11 + 1).cast("string"), 3, "0"))
    return twin.coverage_check(twin.expected_slots({"A": (5, 5), "B": (4, 8), "C": (3, 8), "D": (2, 10)}, c), c.select(slot.alias("slot_id")))


@query("WITH c AS (SELECT c_custkey AS k FROM customer), o AS (SELECT DISTINCT o_custkey AS k FROM orders), e AS (SELECT DISTINCT user_id AS k FROM events) SELECT 'registered' AS step, count(*) AS n FROM c UNION ALL SELECT 'ordered', count(*) FROM c WHERE k IN (SELECT k FROM o) UNION ALL SELECT 'inspected', count(*) FROM c WHERE k IN (SELECT k FROM o) AND k IN (SELECT k FROM e)")
def coverage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("k"))
    return trends.funnel({"registered": ids("customer", "c_custkey"), "ordered": ids("orders", "o_custkey"), "inspected": ids("events", "user_id")}, "k")


@query("WITH " + VISITS + "SELECT event_id, CAST((coalesce(k <= 30 OR k >= 90, false))::INT + (coalesce(NOT (ph BETWEEN 5.5 AND 7.0), false))::INT + (coalesce(value < 10, false))::INT + (coalesce(k > 85, false))::INT AS INTEGER) AS points FROM visits")
def stress_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visits(spark, sf_dir)
    points = fc.stress_points(F.when(F.col("k") <= 30, 3).when(F.col("k") >= 90, 10).otherwise(5), F.col("ph"), F.when(F.col("value") < 10, 0.0).otherwise(1.0), F.col("k"))
    return v.select("event_id", points.alias("points"))


@query("WITH " + CYCLES + "SELECT plant_id, cycle, event_id FROM cycles")
def latest_per_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles(spark, sf_dir).select("plant_id", "cycle", "event_id")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def recent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10).select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5")
def worst_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = twin.recent(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5)
    return out.select("c_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"))
