"""Queries on positions: range joins, clusters, spatial statistics, permutation tests, tracks, gaps of stems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlark.functions.geo import in_ring
from fieldlark.operators import gaps, permutation, spatial, tracks
from fieldlark.plans.registry import HAVERSINE, PLACES, VISITS, places, query, table, visits

_D = HAVERSINE.format(a="a", b="b")
_EDGES = "WITH " + PLACES + f", edges AS (SELECT a.id AS a, b.id AS b, {_D} AS distance FROM places a JOIN places b ON a.id <> b.id WHERE {_D} <= {{m}}) "


@query(_EDGES.format(m="4.0") + "SELECT a, b, round(distance, 5) AS distance FROM edges")
def distance_band_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.edges_within(places(spark, sf_dir), 4.0).withColumn("distance", F.round("distance", 5))


@query(
    "WITH "
    + PLACES
    + f", d AS (SELECT a.id AS a, b.id AS b, {_D} AS distance FROM places a JOIN places b ON a.id % 50 = 0 AND b.id <> a.id WHERE {_D} <= 25.0), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM d) SELECT a, b, round(distance, 5) AS distance, rank FROM r WHERE rank <= 5"
)
def nearest_plants_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    out = spatial.nearest(p.where("id % 50 = 0"), p, 5, 25.0, others=True)
    return out.select("a", "b", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(
    "WITH RECURSIVE "
    + PLACES
    + f""", edges AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM places a JOIN places b ON a.id <> b.id WHERE {_D} <= 3.0), core AS MATERIALIZED (SELECT a AS id FROM edges GROUP BY a HAVING count(*) + 1 >= 4),
inner_ AS MATERIALIZED (SELECT a, b FROM edges WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), r AS (SELECT id, id AS c FROM core UNION SELECT i.b, r.c FROM r JOIN inner_ i ON i.a = r.id WHERE r.c < i.b), lab AS (SELECT id, min(c) AS label FROM r GROUP BY id),
bord AS (SELECT e.a AS id, min(l.label) AS label FROM edges e JOIN lab l ON l.id = e.b WHERE e.a NOT IN (SELECT id FROM core) GROUP BY e.a), f AS (SELECT * FROM lab UNION ALL SELECT * FROM bord)
SELECT p.id, coalesce(f.label, -1) AS cluster FROM places p LEFT JOIN f ON f.id = p.id"""
)
def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.dbscan(places(spark, sf_dir), 3.0, 4)


@query(_EDGES.format(m="1e6") + ", k AS (SELECT a AS id, distance AS kdist FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rn FROM edges) WHERE rn = 4) SELECT id, round(kdist, 5) AS kdist FROM k")
def k_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.k_distances(places(spark, sf_dir), 4).withColumn("kdist", F.round("kdist", 5))


@query(
    _EDGES.format(m="1e6")
    + """, k AS (SELECT distance AS kdist FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rn FROM edges) WHERE rn = 4), o AS (SELECT kdist, row_number() OVER (ORDER BY kdist) AS i, count(*) OVER () AS n, min(kdist) OVER () AS lo, max(kdist) OVER () AS hi FROM k)
SELECT round(max_by(kdist, abs((i - 1) / CAST(n - 1 AS DOUBLE) - (kdist - lo) / greatest(hi - lo, 1e-9))), 5) AS elbow FROM o"""
)
def kdist_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.elbow(spatial.k_distances(places(spark, sf_dir), 4)).withColumn("elbow", F.round("elbow", 5))


@query(_EDGES.format(m="4.0") + "SELECT count(*) / 2.0::DOUBLE AS join_count FROM edges WHERE a % 3 = 0 AND b % 3 = 0")
def join_count_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    return spatial.join_count(p, spatial.edges_within(p, 4.0), "flag")


@query(
    _EDGES.format(m="4.0")
    + """, st AS (SELECT avg(value) AS m, var_pop(value) AS v FROM places), z AS (SELECT id, value - m AS z FROM places, st) SELECT round(sum(za.z * zb.z) / count(*) / any_value(v), 6) AS morans_i FROM edges e JOIN z za ON za.id = e.a JOIN z zb ON zb.id = e.b, st"""
)
def morans_i_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    return spatial.morans_i(p, spatial.edges_within(p, 4.0), "value").withColumn("morans_i", F.round("morans_i", 6))


_P, _K, _RUNS = 2_147_483_647, permutation.ROUNDS, 999
_OTHER = "((u % n + n - x) % n)"
_BIT = f"((((greatest(x, {_OTHER}) * 40692 + u) % {_P}) * ((greatest(x, {_OTHER}) * 40692 + u) % {_P}) + 67891) % {_P} * 69621 % {_P} >> 13) & 1"
#: ``f (run, id)``: flagged points of each run, of run 999 as they are. Numbers go through the same rounds one by one.
_RUN_FLAGS = (
    "WITH "
    + PLACES
    + f""", q AS (SELECT run, k, (run * {_K} + k + 1) * 48271 % {_P} AS q FROM range({_RUNS}) a(run), range({_K}) b(k)), us AS (SELECT run, list((q * q + 12345) % {_P} ORDER BY k) AS us FROM q GROUP BY run),
st AS (SELECT id, flag, row_number() OVER (PARTITION BY zone ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY zone) AS n, count(*) FILTER (flag) OVER (PARTITION BY zone) AS k FROM places),
f AS MATERIALIZED (SELECT run, id FROM st, us WHERE list_reduce(list_prepend(i, us), lambda x, u: CASE WHEN {_BIT} = 1 THEN {_OTHER} ELSE x END) < k UNION ALL SELECT {_RUNS}, id FROM st WHERE flag),
edges AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM places a JOIN places b ON a.id <> b.id WHERE {_D} <= {{m}}), """
)
_VALUES = f"o AS (SELECT v FROM r WHERE run = {_RUNS}) SELECT o.v AS {{name}}, (count(*) FILTER (r.v >= o.v AND run < {_RUNS}) + 1) / {_RUNS + 1}::DOUBLE AS p FROM r, o GROUP BY o.v"


@query(
    _RUN_FLAGS.format(m="4.0")
    + f"c AS (SELECT fa.run, count(*) AS n FROM edges e JOIN f fa ON fa.id = e.a JOIN f fb ON fb.id = e.b AND fb.run = fa.run WHERE e.a < e.b GROUP BY ALL), r AS (SELECT range AS run, coalesce(n, 0)::DOUBLE AS v FROM range({_RUNS + 1}) LEFT JOIN c ON run = range), "
    + _VALUES.format(name="join_count")
)
def join_count_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    return permutation.join_count_test(p, 4.0, "flag", ["zone"], _RUNS)


@query(
    _RUN_FLAGS.format(m="5.0")
    + f"""fe AS MATERIALIZED (SELECT fa.run, e.a, e.b FROM edges e JOIN f fa ON fa.id = e.a JOIN f fb ON fb.id = e.b AND fb.run = fa.run), core AS (SELECT run, a FROM fe GROUP BY ALL HAVING count(*) + 1 >= 3),
ins AS (SELECT run, a FROM core UNION SELECT fe.run, fe.a FROM fe JOIN core ON core.run = fe.run AND core.a = fe.b), c AS (SELECT run, count(*) AS n FROM ins GROUP BY run), k AS (SELECT count(*) AS k FROM places WHERE flag),
r AS (SELECT range AS run, coalesce(n, 0) / k::DOUBLE AS v FROM k, range({_RUNS + 1}) LEFT JOIN c ON run = range), """
    + _VALUES.format(name="observed")
)
def clustered_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    return permutation.clustered_share_test(p, 5.0, "flag", ["zone"], 3, _RUNS)


@query(
    "WITH "
    + PLACES
    + f""", q AS (SELECT run, k, (run * {_K} + k + 1) * 48271 % {_P} AS q FROM range({_RUNS}) a(run), range({_K}) b(k)), us AS (SELECT run, list((q * q + 12345) % {_P} ORDER BY k) AS us FROM q GROUP BY run),
st AS (SELECT id, value - avg(value) OVER () AS z, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM places), v AS (SELECT var_pop(value) AS v FROM places),
moved AS MATERIALIZED (SELECT run, list_reduce(list_prepend(i, us), lambda x, u: CASE WHEN {_BIT} = 1 THEN {_OTHER} ELSE x END) AS place, z FROM st, us UNION ALL SELECT {_RUNS}, i, z FROM st),
edges AS MATERIALIZED (SELECT sa.i AS a, sb.i AS b FROM places a JOIN places b ON a.id < b.id JOIN st sa ON sa.id = a.id JOIN st sb ON sb.id = b.id WHERE {_D} <= 4.0),
r AS (SELECT ma.run, round(sum(ma.z * mb.z) / (count(*) * any_value(v)), 12) AS v FROM edges e JOIN moved ma ON ma.place = e.a JOIN moved mb ON mb.place = e.b AND mb.run = ma.run, v GROUP BY ma.run),
o AS (SELECT v FROM r WHERE run = {_RUNS}) SELECT round(o.v, 6) AS morans_i, (count(*) FILTER (r.v >= o.v AND run < {_RUNS}) + 1) / {_RUNS + 1}::DOUBLE AS p FROM r, o GROUP BY o.v"""
)
def morans_i_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    return permutation.morans_i_test(p, 4.0, "value", _RUNS).withColumn("morans_i", F.round("morans_i", 6))


RINGS = {"north": [(80.6950, 7.3388), (80.6965, 7.3388), (80.6965, 7.3400), (80.6950, 7.3400)], "wedge": [(80.6954, 7.3380), (80.6960, 7.3384), (80.6956, 7.3390)]}


@query(
    "WITH "
    + PLACES
    + """, e AS (SELECT * FROM (VALUES ('north', 80.6950::DOUBLE, 7.3388::DOUBLE, 80.6965::DOUBLE, 7.3388::DOUBLE), ('north', 80.6965, 7.3388, 80.6965, 7.3400), ('north', 80.6965, 7.3400, 80.6950, 7.3400), ('north', 80.6950, 7.3400, 80.6950, 7.3388),
 ('wedge', 80.6954, 7.3380, 80.6960, 7.3384), ('wedge', 80.6960, 7.3384, 80.6956, 7.3390), ('wedge', 80.6956, 7.3390, 80.6954, 7.3380)) t(ring, x1, y1, x2, y2)),
h AS (SELECT p.id, e.ring FROM places p JOIN e ON (y1 > p.lat) <> (y2 > p.lat) AND p.lon < (x2 - x1) * (p.lat - y1) / (y2 - y1) + x1) SELECT id, ring FROM h GROUP BY ALL HAVING count(*) % 2 = 1"""
)
def point_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    names = F.array_compact(F.array(*[F.when(in_ring(F.col("lon"), F.col("lat"), r), F.lit(n)) for n, r in RINGS.items()]))
    return p.select("id", F.explode(names).alias("ring"))


@query(
    "WITH "
    + PLACES
    + """, c AS (SELECT label, count(*) AS n, avg(CASE WHEN value > 0.1 THEN 1.0 ELSE 0.0 END) AS s1, avg(CASE WHEN flag THEN 1.0 ELSE 0.0 END) AS s2, median(value) AS m FROM places GROUP BY label),
t AS (SELECT *, CAST(s1 > 0.2 AS INTEGER) + CAST(m < 0 AS INTEGER) + CAST(n > 40 AS INTEGER) AS np, CAST(s2 > 0.33 AS INTEGER) + CAST(m > 0.005 AS INTEGER) AS dp FROM c) SELECT label, n, round(s1, 6) AS share, round(m, 6) AS middle, np AS nutrient_points, dp AS disease_points, CASE WHEN np - dp >= 2 THEN 'likely_nutrient_deficiency' WHEN dp - np >= 2 THEN 'likely_disease' ELSE 'uncertain_expert_review' END AS likely_cause FROM t"""
)
def cluster_evidence_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = places(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("value") > 0.1).cast("double")).alias("s1"), F.avg(F.col("flag").cast("double")).alias("s2"), F.median("value").alias("m"))
    out = spatial.triage(own, {"a": F.col("s1") > 0.2, "b": F.col("m") < 0, "c": F.col("n") > 40}, {"d": F.col("s2") > 0.33, "e": F.col("m") > 0.005})
    return out.select("label", "n", F.round("s1", 6).alias("share"), F.round("m", 6).alias("middle"), "nutrient_points", "disease_points", "likely_cause")


_ROUND = """w{n} AS (SELECT * FROM (SELECT *, min(k) OVER (PARTITION BY run, cycle, cluster) AS ka, min(k) OVER (PARTITION BY run, cycle, old) AS kb FROM l{n}) WHERE k = ka AND k = kb),
l{m} AS (SELECT * FROM l{n} WHERE (run, cycle, cluster) NOT IN (SELECT (run, cycle, cluster) FROM w{n}) AND (run, cycle, old) NOT IN (SELECT (run, cycle, old) FROM w{n})), """


@query(
    "WITH RECURSIVE "
    + VISITS
    + """, m AS MATERIALIZED (SELECT DISTINCT zone AS run, date_diff('day', DATE '2024-01-01', day) // 7 AS cycle, block % 3 AS cluster, plant_id AS id, (plant_id % 12)::DOUBLE AS x, plant_id / 12::DOUBLE AS y FROM visits WHERE foliage = 'Brown'),
cyc AS (SELECT run, cycle, lag(cycle) OVER w AS before, lead(cycle) OVER w AS after FROM (SELECT DISTINCT run, cycle FROM m) WINDOW w AS (PARTITION BY run ORDER BY cycle)),
s AS MATERIALIZED (SELECT run, cycle, cluster, count(*) AS n, avg(x) AS cx, avg(y) AS cy, stddev_pop(cycle) AS spread FROM m GROUP BY ALL),
pairs AS (SELECT a.run, a.cycle, a.cluster, o.cluster AS old, o.cycle AS before, a.n, o.n AS old_n, (SELECT count(*) FROM m p JOIN m q ON q.run = p.run AND q.id = p.id WHERE p.run = a.run AND p.cycle = a.cycle AND p.cluster = a.cluster AND q.cycle = o.cycle AND q.cluster = o.cluster) AS sh,
 sqrt(pow(a.cx - o.cx, 2) + pow(a.cy - o.cy, 2)) AS d FROM s a JOIN cyc USING (run, cycle) JOIN s o ON o.run = a.run AND o.cycle = cyc.before),
l1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run, cycle ORDER BY sh / (n + old_n - sh)::DOUBLE DESC, d, cluster, old) AS k FROM pairs WHERE sh / (n + old_n - sh)::DOUBLE >= 0.3 OR d <= 2.0), """
    + "".join(_ROUND.format(n=n, m=n + 1) for n in (1, 2, 3))
    + """links AS MATERIALIZED (SELECT run, cycle, cluster, old, before, old_n, d FROM w1 UNION ALL SELECT run, cycle, cluster, old, before, old_n, d FROM w2 UNION ALL SELECT run, cycle, cluster, old, before, old_n, d FROM w3),
walk AS (SELECT run, cycle, cluster, cycle AS c0, cluster AS k0 FROM s WHERE (run, cycle, cluster) NOT IN (SELECT (run, cycle, cluster) FROM links) UNION ALL SELECT l.run, l.cycle, l.cluster, w.c0, w.k0 FROM walk w JOIN links l ON l.run = w.run AND l.before = w.cycle AND l.old = w.cluster),
named AS (SELECT *, 'H' || lpad(dense_rank() OVER (PARTITION BY run ORDER BY c0, k0)::VARCHAR, 3, '0') AS hotspot_id FROM walk),
added AS (SELECT l.run, l.cycle, l.cluster, m.id, m.x, m.y, l.before, l.old FROM links l JOIN m USING (run, cycle, cluster) WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.run = l.run AND o.cycle = l.before AND o.cluster = l.old AND o.id = m.id)),
grown AS (SELECT a.run, a.cycle, a.cluster, count(*) AS added, count(*) FILTER (EXISTS (SELECT 1 FROM m o WHERE o.run = a.run AND o.cycle = a.before AND o.cluster = a.old AND sqrt(pow(o.x - a.x, 2) + pow(o.y - a.y, 2)) <= 2.0)) AS near FROM added a GROUP BY ALL),
j AS (SELECT n.run, n.cycle, n.hotspot_id, s.n, l.old_n, l.d, coalesce(g.added, 0) AS added, coalesce(g.near, 0) AS near, s.spread, cyc.after FROM named n JOIN s USING (run, cycle, cluster) JOIN cyc USING (run, cycle) LEFT JOIN links l USING (run, cycle, cluster) LEFT JOIN grown g USING (run, cycle, cluster)),
t AS (SELECT *, sum(added) OVER w AS added_all, sum(near) OVER w AS near_all, first(n) OVER w AS n0, first(cycle) OVER w AS c0, lead(cycle) OVER (PARTITION BY run, hotspot_id ORDER BY cycle) AS again FROM j WINDOW w AS (PARTITION BY run, hotspot_id ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT run, cycle, hotspot_id, CASE WHEN old_n IS NULL THEN 'new' WHEN n > old_n THEN 'expanding' WHEN n < old_n THEN 'shrinking' ELSE 'persistent' END AS status, n AS size, added, round(CASE WHEN added > 0 THEN near / added::DOUBLE END, 5) AS adjacent, round(d, 5) AS shift_m,
 n - n0 AS net_growth, round(CASE WHEN added_all >= 2 THEN near_all / added_all::DOUBLE END, 5) AS adjacent_total, round(spread, 5) AS onset_spread, cycle - c0 + 1 AS persistence FROM t
UNION ALL SELECT run, after, hotspot_id, 'resolved', 0, 0, NULL, NULL, NULL, NULL, NULL, after - c0 FROM t WHERE again IS NULL AND after IS NOT NULL"""
)
def hotspot_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visits(spark, sf_dir).withColumn("cycle", F.floor(F.datediff("day", F.lit("2024-01-01").cast("date")) / 7).cast("int"))
    m = v.where("foliage = 'Brown'").select(F.col("zone").alias("run"), "cycle", (F.col("block") % 3).alias("cluster"), F.col("plant_id").alias("id")).distinct()
    m = m.withColumn("x", (F.col("id") % 12).cast("double")).withColumn("y", F.col("id") / 12)
    out = tracks.tracks(m.withColumn("onset", F.col("cycle").cast("double")), "run", 2.0)
    return out.withColumns({c: F.round(c, 5) for c in ("adjacent", "shift_m", "adjacent_total", "onset_spread")})


_STEMS = """s0 AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_linenumber * 30 + l_discount * 100)::DOUBLE AS x, min(l_quantity)::DOUBLE * 3 AS y, max((l_partkey % 3 = 0)::INTEGER) AS brk FROM lineitem GROUP BY ALL),
pts AS (SELECT *, sum(brk) OVER (PARTITION BY k ORDER BY n) AS seg FROM s0)"""


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stems: their lines are points, and one of a part that 3 divides begins a new segment."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    x, y = F.min(F.col("l_linenumber") * 30 + F.col("l_discount") * 100), F.min("l_quantity") * 3
    pts = li.agg(x.cast("double").alias("x"), y.cast("double").alias("y"), F.max((F.col("l_partkey") % 3 == 0).cast("int")).alias("brk"))
    pts = pts.withColumn("seg", F.sum("brk").over(Window.partitionBy("k").orderBy("n")))
    return pts.groupBy("k", "seg").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("p")).select("k", "seg", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


_GAPS = (
    "WITH "
    + _STEMS
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY k, seg ORDER BY n) AS i, row_number() OVER (PARTITION BY k, seg ORDER BY n DESC) AS j, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM pts WINDOW w AS (PARTITION BY k, seg ORDER BY n)),
far AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY k, seg ORDER BY n), 0) AS ahead, coalesce(sum(step) OVER (PARTITION BY k, seg ORDER BY n DESC), 0) - coalesce(step, 0) AS back, count(*) OVER (PARTITION BY k, seg) AS c FROM o),
ends AS (SELECT k, seg, max(x) FILTER (j = 1) AS ex, max(y) FILTER (j = 1) AS ey, max(x) FILTER (i = 1) AS bx, max(y) FILTER (i = 1) AS by_, arg_min(x, j) FILTER (back >= 20 OR j = c) AS qx, arg_min(y, j) FILTER (back >= 20 OR j = c) AS qy,
 arg_min(x, i) FILTER (ahead >= 20 OR i = c) AS rx, arg_min(y, i) FILTER (ahead >= 20 OR i = c) AS ry FROM far GROUP BY ALL),
g AS (SELECT k, seg, ex AS x0, ey AS y0, ex - qx AS ux, ey - qy AS uy, lead(bx) OVER w AS x1, lead(by_) OVER w AS y1, lead(rx) OVER w - lead(bx) OVER w AS vx, lead(ry) OVER w - lead(by_) OVER w AS vy FROM ends WINDOW w AS (PARTITION BY k ORDER BY seg)),
h AS (SELECT k, seg, x0, y0, x1, y1, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS d, sqrt(ux * ux + uy * uy) AS un, sqrt(vx * vx + vy * vy) AS vn, ux, uy, vx, vy FROM g WHERE x1 IS NOT NULL),
c AS (SELECT *, (x1 - x0) / nullif(d, 0) AS dx, (y1 - y0) / nullif(d, 0) AS dy FROM h), c2 AS (SELECT *, un > 1e-6 AND (ux * dx + uy * dy) / un >= 0.15 AS a_ok, vn > 1e-6 AND (vx * dx + vy * dy) / vn >= 0.15 AS b_ok FROM c),
tg AS (SELECT k, seg, d, x0, y0, x1, y1, 0.55 * d * CASE WHEN a_ok THEN ux / un ELSE dx END AS ax, 0.55 * d * CASE WHEN a_ok THEN uy / un ELSE dy END AS ay, 0.55 * d * CASE WHEN b_ok THEN vx / vn ELSE dx END AS bx, 0.55 * d * CASE WHEN b_ok THEN vy / vn ELSE dy END AS by_ FROM c2),
i AS (SELECT *, greatest(30, floor(d * 3)::BIGINT) - 1 AS m FROM tg), t AS (SELECT *, unnest(range(m + 1)) AS q FROM i WHERE d <= {longest}), u AS (SELECT *, q / m::DOUBLE AS t FROM t),
xy AS (SELECT k, seg, q, (2*t*t*t - 3*t*t + 1) * x0 + (t*t*t - 2*t*t + t) * ax + (3*t*t - 2*t*t*t) * x1 + (t*t*t - t*t) * bx AS x, (2*t*t*t - 3*t*t + 1) * y0 + (t*t*t - 2*t*t + t) * ay + (3*t*t - 2*t*t*t) * y1 + (t*t*t - t*t) * by_ AS y FROM u),
st AS (SELECT k, seg, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM xy WINDOW w AS (PARTITION BY k, seg ORDER BY q)), ln AS (SELECT k, seg, sum(step) AS len FROM st GROUP BY ALL),
gaps AS (SELECT k, seg, d AS chord, CASE WHEN d > {longest} THEN 'too_long' WHEN len <= {bend} * d THEN 'hermite' ELSE 'straight' END AS method, CASE WHEN d > {longest} THEN NULL WHEN len <= {bend} * d THEN len ELSE d END AS length FROM tg LEFT JOIN ln USING (k, seg)) """
)
#: Tighter than the defaults, so that each of the three methods is taken.
_HOW = {"most_bend": 1.05, "longest": 120.0}


@query(_GAPS.format(bend=1.05, longest=120.0) + "SELECT k, seg, round(chord, 5) AS chord, method, round(length, 5) AS length FROM gaps")
def stem_gaps_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gaps.filled_gaps(gaps.stem_gaps(_stems(spark, sf_dir), "k", "seg", "points"), **_HOW)
    return found.select("k", "seg", F.round("chord", 5).alias("chord"), "method", F.round("length", 5).alias("length"))


@query(
    _GAPS.format(bend=1.05, longest=120.0)
    + """, seen AS (SELECT k, coalesce(sum(step), 0) AS observed FROM o GROUP BY k), made AS (SELECT k, sum(length) AS e, count(length) AS n, count(*) FILTER (method = 'too_long') AS f FROM gaps GROUP BY k)
SELECT k, round(observed * 0.1, 4) AS observed, round(coalesce(e, 0) * 0.1, 4) AS estimated, coalesce(n, 0) AS filled, coalesce(f, 0) AS too_long FROM seen LEFT JOIN made USING (k)"""
)
def stem_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gaps.filled_lengths(_stems(spark, sf_dir), "k", "seg", "points", 0.1, **_HOW)
    return found.select("k", F.round("observed", 4).alias("observed"), F.round("estimated", 4).alias("estimated"), "filled", "too_long")


@query(
    "WITH "
    + PLACES
    + f""", p AS (SELECT *, CAST(id % 40 AS DOUBLE) AS acc FROM places), n AS (SELECT DISTINCT a.id FROM p a JOIN p b ON a.id <> b.id AND a.zone = b.zone WHERE {_D} <= 4.0)
SELECT id, acc > 15 AS poor, count(*) OVER (PARTITION BY lat, lon) > 1 AS shared, id NOT IN (SELECT id FROM n) AS isolated FROM p"""
)
def position_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).withColumn("acc", (F.col("id") % 40).cast("double"))
    return spatial.layout_flags(p, "id", "acc", alone=4.0)
