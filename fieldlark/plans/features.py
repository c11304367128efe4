"""Queries on temporal features, anomalies, position fixes, trends and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlark.operators import gps, graph, temporal, trends
from fieldlark.plans.registry import CYCLES, FIXES, VISITS, cycles, fixes, query, table, visits

_W = "(PARTITION BY plant_id ORDER BY ts, event_id)"


@query(
    "WITH "
    + VISITS
    + f"""SELECT event_id, coalesce(lag(k) OVER w, k) AS k_prev, k - coalesce(lag(k) OVER w, k) AS k_delta, round(avg(k) OVER (PARTITION BY plant_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS k_roll FROM visits WINDOW w AS {_W}"""
)
def lag_delta_roll3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = temporal.lag_features(visits(spark, sf_dir), "plant_id", ["ts", "event_id"], ["k"])
    return df.select("event_id", "k_prev", "k_delta", F.round("k_roll", 6).alias("k_roll"))


@query("WITH " + VISITS + f"SELECT event_id, round(coalesce((k - lag(k) OVER w) / (nullif(date_diff('day', lag(day) OVER w, day), 0) / 7.0::DOUBLE), 0), 6) AS growth_wk FROM visits WINDOW w AS (PARTITION BY plant_id ORDER BY day, event_id)")
def weekly_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.weekly_growth(visits(spark, sf_dir), "plant_id", "day", "event_id", "k").select("event_id", F.round("growth_wk", 6).alias("growth_wk"))


@query(
    "WITH "
    + VISITS
    + """, n AS (SELECT plant_id, event_id, k, row_number() OVER (PARTITION BY plant_id ORDER BY ts, event_id) AS i FROM visits)
SELECT a.event_id, round(sum(b.k * pow(0.6::DOUBLE, a.i - b.i)) / sum(pow(0.6::DOUBLE, a.i - b.i)), 6) AS ewm FROM n a JOIN n b ON a.plant_id = b.plant_id AND b.i <= a.i GROUP BY a.event_id"""
)
def ewm_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.ewm(visits(spark, sf_dir), "plant_id", ["ts", "event_id"], "k").select("event_id", F.round("ewm", 6).alias("ewm"))


@query(
    "WITH "
    + CYCLES
    + """SELECT event_id, CASE WHEN count(value) OVER w >= 2 THEN round(value - quantile_cont(value, 0.5) OVER w, 6) END AS self_dev FROM cycles WINDOW w AS (PARTITION BY plant_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"""
)
def self_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.self_deviation(cycles(spark, sf_dir), "plant_id", ["cycle"], "value").select("event_id", F.round("self_dev", 6).alias("self_dev"))


_PEER = (
    "WITH "
    + CYCLES
    + """, g AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY block, cycle) - 1 >= 8 THEN 'b' || CAST(block AS VARCHAR) ELSE 'z' || CAST(zone AS VARCHAR) END AS pg FROM cycles), c AS (SELECT pg, cycle, count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT a.event_id, a.cycle, a.value - median(b.value) AS dev FROM g a JOIN g b ON a.pg = b.pg AND a.cycle = b.cycle AND a.event_id <> b.event_id JOIN c ON c.pg = a.pg AND c.cycle = a.cycle WHERE c.n >= 4 GROUP BY a.event_id, a.cycle, a.value) """
)


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.peer_deviation(temporal.peer_group(cycles(spark, sf_dir), "block", "zone"), ["peer_group", "cycle"], "value")


@query(_PEER + "SELECT event_id, round(dev, 6) AS peer_dev FROM p WHERE dev IS NOT NULL")
def peer_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers(spark, sf_dir).where("peer_dev is not null").select("event_id", F.round("peer_dev", 6).alias("peer_dev"))


@query(_PEER + ", s AS (SELECT cycle, greatest(1.4826 * median(abs(dev)), 0.5) AS scale FROM p GROUP BY cycle) SELECT event_id, round(dev / scale, 5) AS z, abs(dev / scale) > 1.2 AS flag FROM p JOIN s USING (cycle) WHERE dev IS NOT NULL")
def robust_z_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = temporal.robust_z(peers(spark, sf_dir), "peer_dev", 0.5, ["cycle"]).where("peer_dev is not null")
    return temporal.rule_flags(df, ["z"], 1.2).select("event_id", F.round("z", 5).alias("z"), F.col("rule_flag").alias("flag"))


@query("WITH " + VISITS + ", o AS (SELECT *, CASE foliage WHEN 'Green' THEN 0 WHEN 'Mixed' THEN 1 WHEN 'Yellow' THEN 2 ELSE 3 END AS level FROM visits)" + f"SELECT event_id, lag(level) OVER w AS level_prev, coalesce(level > lag(level) OVER w, false) AS worse FROM o WINDOW w AS {_W}")
def foliage_worsened(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("foliage") == "Green", 0).when(F.col("foliage") == "Mixed", 1).when(F.col("foliage") == "Yellow", 2).otherwise(3)
    return temporal.worsened(visits(spark, sf_dir).withColumn("level", level), "plant_id", ["ts", "event_id"], "level").select("event_id", "level_prev", "worse")


@query(
    "WITH "
    + CYCLES
    + """, f AS (SELECT plant_id, cycle, foliage <> 'Green' AS flag FROM cycles), i AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY plant_id ORDER BY cycle ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT plant_id, cycle, CASE WHEN flag THEN min(CASE WHEN flag THEN cycle END) OVER (PARTITION BY plant_id, island) END AS onset FROM i"""
)
def run_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cycles(spark, sf_dir).withColumn("flag", F.col("foliage") != "Green")
    return temporal.run_onsets(df, "plant_id", "cycle", "flag").select("plant_id", "cycle", "onset")


@query()
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = temporal.isolation_flags(visits(spark, sf_dir).select("event_id", "value", "k", "ph"), ["value", "k", "ph"], clip=100.0)
    return df.select("event_id", "iso_score", "iso_flag")


_DISP = "d AS (SELECT f.session, sqrt(pow(x - mx, 2) + pow(y - my, 2)) AS d, accuracy FROM fixes f JOIN (SELECT session, avg(x) AS mx, avg(y) AS my FROM fixes GROUP BY session) m USING (session))"


@query("WITH " + FIXES + ", " + _DISP + "SELECT session, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS cep50, round(quantile_cont(d, 0.95), 6) AS cep95, round(sqrt(avg(d * d)), 6) AS rms, median(accuracy) AS median_accuracy FROM d GROUP BY session")
def gps_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = gps.dispersion(gps.usable_fixes(fixes(spark, sf_dir), "x", "y", "accuracy"), ["session"], "x", "y", "accuracy")
    return df.select("session", "n", *[F.round(c, 6).alias(c) for c in ("cep50", "cep95", "rms")], "median_accuracy")


@query(
    "WITH "
    + FIXES
    + """SELECT session, count(*) AS n, min_by(x, n_fix::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey) AS raw_x, round(avg(x), 6) AS mean_x, round(sum(x / pow(greatest(accuracy, 1), 2)) / sum(1 / pow(greatest(accuracy, 1), 2)), 6) AS weighted_x, round(median(x), 6) AS median_x FROM fixes GROUP BY session"""
)
def gps_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixes(spark, sf_dir).withColumn("o", F.col("n_fix") * F.lit(1000000000).cast("long") + F.col("l_partkey") * 1000 + F.col("l_suppkey"))
    df = gps.centres(df, ["session"], "x", "y", "accuracy", ["o"])
    return df.select("session", "n", "raw_x", *[F.round(c, 6).alias(c) for c in ("mean_x", "weighted_x", "median_x")])


@query(
    "WITH RECURSIVE "
    + FIXES
    + """, o AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY n_fix, l_partkey, l_suppkey) AS i, x::DOUBLE AS x, y::DOUBLE AS y, pow(greatest(accuracy, 1.0::DOUBLE), 2) AS v FROM fixes),
k AS (SELECT session, i, x, y, v AS p FROM o WHERE i = 1 UNION ALL SELECT o.session, o.i, k.x + (k.p + 0.01::DOUBLE) / (k.p + 0.01::DOUBLE + o.v) * (o.x - k.x), k.y + (k.p + 0.01::DOUBLE) / (k.p + 0.01::DOUBLE + o.v) * (o.y - k.y),
 (k.p + 0.01::DOUBLE) * o.v / (k.p + 0.01::DOUBLE + o.v) FROM k JOIN o ON o.session = k.session AND o.i = k.i + 1)
SELECT session, CAST(max(i) AS INTEGER) AS n, round(max_by(x, i), 6) AS kalman_x, round(max_by(y, i), 6) AS kalman_y FROM k GROUP BY session"""
)
def gps_kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = gps.kalman(fixes(spark, sf_dir), ["session"], "x", "y", "accuracy", ["n_fix", "l_partkey", "l_suppkey"])
    return df.select("session", "n", F.round("kalman_x", 6).alias("kalman_x"), F.round("kalman_y", 6).alias("kalman_y"))


@query(
    "WITH "
    + FIXES
    + """, a AS (SELECT *, count(*) OVER w AS n, sqrt(pow(x - median(x) OVER w, 2) + pow(y - median(y) OVER w, 2)) AS d FROM fixes WHERE accuracy <= 30 WINDOW w AS (PARTITION BY session)), b AS (SELECT *, median(d) OVER (PARTITION BY session) AS m FROM a),
c AS (SELECT *, m + 3 * greatest(1.4826 * median(abs(d - m)) OVER (PARTITION BY session), 1.0) AS lim FROM b) SELECT session, count(*) AS n, round(median(x), 6) AS x, round(median(y), 6) AS y, round(median(d), 6) AS spread FROM c WHERE n < 3 OR d <= lim GROUP BY session"""
)
def stable_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = gps.stable_position(fixes(spark, sf_dir), ["session"], "x", "y", "accuracy", 30.0)
    return df.select("session", "n", *[F.round(c, 6).alias(c) for c in ("x", "y", "spread")])


@query(
    "WITH "
    + FIXES
    + """, m AS (SELECT slot, session, avg(x) AS x, avg(y) AS y FROM fixes GROUP BY ALL), e AS (SELECT a.slot, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS error FROM m a JOIN m b ON a.slot = b.slot AND a.session <> b.session)
SELECT slot, count(*) AS n, round(median(error), 6) AS middle, round(quantile_cont(error, 0.95), 6) AS cep95, round(sqrt(avg(error * error)), 6) AS rms FROM e GROUP BY slot"""
)
def cross_session_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixes(spark, sf_dir).groupBy("slot", "session").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    df = gps.error_summary(gps.cross_session_errors(m, "slot", "session", "x", "y"), ["slot"])
    return df.select("slot", "n", *[F.round(c, 6).alias(c) for c in ("middle", "cep95", "rms")])


@query("WITH " + FIXES + """, n AS (SELECT *, row_number() OVER w AS k FROM fixes WINDOW w AS (PARTITION BY session ORDER BY n_fix, l_partkey, l_suppkey)) SELECT session, k, round(avg(x) OVER (PARTITION BY session ORDER BY k ROWS UNBOUNDED PRECEDING), 6) AS x FROM n WHERE k <= 5""")
def first_k_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = gps.first_k_curve(fixes(spark, sf_dir), ["session"], ["n_fix", "l_partkey", "l_suppkey"], "x", "y", 5)
    return df.select("session", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"))


@query(
    "WITH "
    + FIXES
    + """, b AS (SELECT *, min(accuracy) OVER (PARTITION BY session) AS best FROM fixes) SELECT session, count(*) AS n, round(sum(x / pow(greatest(accuracy, 1), 2)) / sum(1 / pow(greatest(accuracy, 1), 2)), 6) AS x, round(sqrt(1 / sum(1 / pow(greatest(accuracy, 1), 2))), 6) AS accuracy
FROM b WHERE accuracy <= greatest(2 * best, best + 2) GROUP BY session"""
)
def combined_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = gps.combined_fix(fixes(spark, sf_dir), ["session"], "x", "y", "accuracy")
    return df.select("session", "n", F.round("x", 6).alias("x"), F.round("accuracy", 6).alias("accuracy"))


@query("WITH " + FIXES + ", " + _DISP + ", s AS (SELECT session, count(*) AS n, quantile_cont(d, 0.95) AS c, median(accuracy) AS m FROM d GROUP BY session) SELECT session, n >= 4 AND c <= 6 AND m <= 30 AS accepted FROM s")
def session_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = gps.dispersion(fixes(spark, sf_dir), ["session"], "x", "y", "accuracy")
    return gps.accepted(df, 4, 6.0, 30.0).select("session", "accepted")


@query("WITH " + FIXES + """, s AS (SELECT session, min(x) AS x, min(y) AS y, min(accuracy) AS accuracy FROM fixes GROUP BY session), r AS (SELECT session, CASE WHEN accuracy > 15 THEN 'poor accuracy' WHEN count(*) OVER (PARTITION BY x, y) > 1 THEN 'shared fix' END AS reason FROM s) SELECT session, reason FROM r WHERE reason IS NOT NULL""")
def recapture_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixes(spark, sf_dir).groupBy("session").agg(*[F.min(c).alias(c) for c in ("x", "y", "accuracy")])
    return gps.recapture_reason(s, "x", "y", "accuracy").select("session", "reason")


@query("WITH " + VISITS + """, n AS (SELECT plant_id, score, CAST(row_number() OVER (PARTITION BY plant_id ORDER BY ts, event_id) - 1 AS DOUBLE) AS i FROM visits), t AS (SELECT plant_id, count(*) AS n, regr_slope(score, i) AS s, avg(CASE WHEN score < 0.6 THEN 1.0 ELSE 0.0 END) AS u FROM n GROUP BY plant_id)
SELECT plant_id, n, coalesce(round(s, 3), 0.0) AS slope, round(u, 6) AS unhealthy_share, CASE WHEN n < 2 THEN 'insufficient' WHEN round(s, 3) > 0.05 THEN 'improving' WHEN round(s, 3) < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM t""")
def plant_trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trends.entity_trend(visits(spark, sf_dir), "plant_id", ["ts", "event_id"], "score")
    return df.select("plant_id", "n", "slope", F.round("unhealthy_share", 6).alias("unhealthy_share"), "trend")


@query("WITH " + VISITS + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY ts DESC, event_id DESC) AS rn FROM visits) WHERE rn = 1), g AS (SELECT 'block' AS level, CAST(block AS VARCHAR) AS entity_id, score FROM l UNION ALL SELECT 'zone', CAST(zone AS VARCHAR), score FROM l),
a AS (SELECT level, entity_id, count(score) AS n, avg(score) AS m FROM g GROUP BY ALL) SELECT level, entity_id, n, round(m, 6) AS mean_score, round((m - 0.5) * CASE level WHEN 'zone' THEN 0.15 ELSE 0.2 END, 6) AS level_score, CASE WHEN m > 0.8 THEN 'improving' WHEN m < 0.5 THEN 'declining' ELSE 'stable' END AS trend FROM a""")
def area_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trends.area_levels(visits(spark, sf_dir), "plant_id", "ts", "event_id", "score", {"block": "block", "zone": "zone"})
    return df.select("level", "entity_id", "n", F.round("mean_score", 6).alias("mean_score"), F.round("level_score", 6).alias("level_score"), "trend")


@query("WITH " + VISITS + """, d AS (SELECT plant_id, day, max_by(k, event_id) AS k FROM visits GROUP BY ALL), f AS (SELECT plant_id, min(day) AS d0, max(day) AS d1, min_by(k, day) AS v0, max_by(k, day) AS v1 FROM d GROUP BY plant_id)
SELECT plant_id, CAST(w AS INTEGER) AS week, round(greatest(0.0::DOUBLE, v1 + coalesce((v1 - v0) / nullif(date_diff('day', d0, d1) / 7.0::DOUBLE, 0), 0) * w), 6) AS forecast FROM f, range(1, 5) r(w)""")
def growth_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = trends.series(visits(spark, sf_dir), "plant_id", "day", "event_id", "k")
    return trends.forecast(s, "plant_id", "day", "k").withColumn("forecast", F.round("forecast", 6))


@query("WITH " + CYCLES + """SELECT cycle, round(avg(CASE WHEN foliage <> 'Green' THEN 1.0 ELSE 0.0 END) FILTER (zone = 0), 6) AS "0", round(avg(CASE WHEN foliage <> 'Green' THEN 1.0 ELSE 0.0 END) FILTER (zone = 1), 6) AS "1",
 round(avg(CASE WHEN foliage <> 'Green' THEN 1.0 ELSE 0.0 END) FILTER (zone = 2), 6) AS "2", round(avg(CASE WHEN foliage <> 'Green' THEN 1.0 ELSE 0.0 END) FILTER (zone = 3), 6) AS "3" FROM cycles GROUP BY cycle""")
def unhealthy_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trends.pivot_share(cycles(spark, sf_dir).withColumn("bad", F.col("foliage") != "Green"), "cycle", "zone", [0, 1, 2, 3], "bad")
    return df.select("cycle", *[F.round(str(z), 6).alias(str(z)) for z in range(4)])


@query("WITH " + FIXES + ", s AS (SELECT session, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM fixes WINDOW w AS (PARTITION BY session ORDER BY n_fix, l_partkey, l_suppkey)) SELECT session, count(*) AS n, round(coalesce(sum(d), 0), 6) AS length FROM s GROUP BY session")
def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("session").orderBy("n_fix", "l_partkey", "l_suppkey")
    df = fixes(spark, sf_dir).withColumn("o", F.row_number().over(w))
    return graph.polyline_length(df, ["session"], "o", "x", "y").withColumn("length", F.round("length", 6))


_PIX = "pix AS (SELECT DISTINCT o_custkey % 7 AS image, CAST(o_orderkey % 211 AS INTEGER) AS x, CAST(o_totalprice AS INTEGER) % 199 AS y FROM orders)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 7).alias("image"), (F.col("o_orderkey") % 211).cast("int").alias("x"), (F.rint("o_totalprice").cast("int") % 199).alias("y")).distinct()


@query("WITH " + _PIX + " SELECT a.image, count(*) AS n_edges, round(sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS length FROM pix a JOIN pix b ON a.image = b.image AND (b.x - a.x, b.y - a.y) IN ((1, 0), (0, 1), (1, 1), (1, -1)) GROUP BY a.image")
def pixel_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pixel_edges(_pixels(spark, sf_dir)).groupBy("image").agg(F.count("*").alias("n_edges"), F.round(F.sum("length"), 6).alias("length"))


@query(
    "WITH RECURSIVE "
    + _PIX
    + """, n AS (SELECT image * 1000000 + x * 1000 + y AS id, image, x, y FROM pix), e AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.image = b.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id),
r AS (SELECT id, id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b) SELECT id, min(c) AS component FROM r GROUP BY id"""
)
def pixel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    pix = _pixels(spark, sf_dir)
    code = lambda x, y: F.col("image") * 1000000 + F.col(x) * 1000 + F.col(y)
    edges = graph.pixel_edges(pix).select(code("xa", "ya").alias("a"), code("xb", "yb").alias("b"))
    return graph.components(pix.select(code("x", "y").alias("id")), edges)


@query()
def main_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.main_stems(graph.pixel_edges(_pixels(spark, sf_dir)))
