"""Queries on passages, sections and routes, and on record rules that other queries do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlark.functions import cleaning as fc
from fieldlark.functions import geo
from fieldlark.functions import text as ft
from fieldlark.operators import cleaning, evaluate, graph, records, retrieval, spatial, trends, twin
from fieldlark.operators.lineage import cut
from fieldlark.plans.registry import HAVERSINE, JUDGED, PLACES, judged, places, query, t_tail, table


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").select("conv_id", "turn", "text")


_SAID = "said AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND text IS NOT NULL)"


@query("WITH " + _SAID + " SELECT conv_id, turn, (conv_id + turn) % 2 = 0 AS other_script, regexp_matches(text, '[à-ÿ]') AS accented, regexp_matches(text, '[0-9]') AS has_digit FROM said")
def script_of_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every second text gets a letter of the default script put into its middle.
    t = F.col("text")
    half = F.floor(F.length(t) / 2).cast("int")
    other = F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, F.concat(F.substring(t, F.lit(1), half), F.lit("\u0d9a"), F.substring(t, half + 1, F.length(t)))).otherwise(t)
    return _said(spark, sf_dir).select("conv_id", "turn", ft.in_script(other).alias("other_script"), ft.in_script(F.col("text"), "00E0", "00FF").alias("accented"), ft.has_digit(F.col("text")).alias("has_digit"))


@query("WITH " + _SAID + " SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 2 THEN 'Hi!' ELSE trim(text) END AS rest FROM said")
def greeting_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = (F.col("conv_id") + F.col("turn")) % 3, F.trim("text")
    greeted = F.when(i == 0, F.concat(F.lit("Good morning, hello... "), t)).when(i == 1, F.concat(F.lit("HELLO "), t)).otherwise("Hi!")
    once = ft.without_greeting(greeted, ["hello", "hi", "good morning", "good morning, hello"])
    return _said(spark, sf_dir).select("conv_id", "turn", once.alias("rest"))


@query("WITH " + _SAID + " SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'Nothing is known.' ELSE 'It is wet. It is dry!' END AS answer FROM said")
def marked_sentences_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("conv_id") % 4 == 0, "The manual says so.").otherwise("It is wet. As the MANUAL says, water. It is dry!")
    return _said(spark, sf_dir).select("conv_id", "turn", ft.without_sentences(text, ["the manual"], "Nothing is known.").alias("answer"))


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) || '.' || CAST(p_size AS VARCHAR) || ';' || CAST(p_size AS VARCHAR) || '.1.2' AS refs FROM part")
def section_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col(c).cast("string") for c in ("p_partkey", "p_size"))
    said = F.concat(F.lit("See "), a, F.lit("."), b, F.lit(" and "), b, F.lit(".1.2, not 7."))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(ft.section_references(said), ";").alias("refs"))


@query("SELECT p_partkey, p_name || chr(10) || p_brand AS lines, p_brand || 'wa-lls' || p_name || '- ' AS joined FROM part")
def bullets_and_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    bulleted = F.concat(F.lit(" • "), "p_name", F.lit("•  • "), "p_brand", F.lit(" •"))
    broken = F.concat("p_brand", F.lit("wa-\nlls"), "p_name", F.lit("- "))
    return table(spark, sf_dir, "part").select("p_partkey", ft.bullets(bulleted).alias("lines"), ft.dehyphenated(broken).alias("joined"))


#: A place in an outline for each order line: its numbers, and a title from the part; bodies are the orders' comments of sorts.
_LINES = """li AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL), ord AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS i FROM li),
lines AS (SELECT k, i, p % 4 AS a, CASE WHEN s % 3 > 0 THEN p % 3 + 1 END AS b, CASE WHEN s % 3 > 1 THEN s % 5 + 1 END AS c, CASE WHEN s % 7 = 0 THEN 'part ' ELSE 'Part ' END || p::VARCHAR AS title, 'body ' || s::VARCHAR AS body FROM ord)"""


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts: each line makes a line that may be a heading, and one that is none."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    s, p = F.col("s"), F.col("p")
    number = F.concat_ws(".", (p % 4).cast("string"), F.when(s % 3 > 0, p % 3 + 1).cast("string"), F.when(s % 3 > 1, s % 5 + 1).cast("string"))
    text = F.concat(number, F.lit(" "), F.when(s % 7 == 0, "part ").otherwise("Part "), p.cast("string"), F.lit("\n  body "), s.cast("string"))
    return li.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


_OUTLINE = (
    "WITH RECURSIVE "
    + _LINES
    + """, st AS (SELECT k, 0::BIGINT AS i, 0::BIGINT AS top, NULL::BIGINT AS sec, false AS ok FROM lines GROUP BY k UNION ALL
SELECT s.k, l.i, CASE WHEN t.ok AND l.b IS NULL THEN l.a ELSE s.top END, CASE WHEN t.ok AND l.b IS NULL THEN NULL WHEN t.ok AND l.c IS NULL THEN l.b ELSE s.sec END, t.ok FROM st s JOIN lines l ON l.k = s.k AND l.i = s.i + 1,
 LATERAL (SELECT coalesce(l.title LIKE 'Part%' AND CASE WHEN l.b IS NULL THEN l.a = s.top + 1 WHEN l.c IS NULL THEN l.a = s.top ELSE l.a = s.top AND l.b = s.sec END, false) AS ok) t),
each AS (SELECT l.*, st.ok, concat_ws('.', a, b, c) AS number, sum(st.ok::INTEGER) OVER (PARTITION BY l.k ORDER BY l.i) AS sec_no FROM lines l JOIN st ON st.k = l.k AND st.i = l.i),
found AS (SELECT k, sec_no, max(number) FILTER (ok) AS number, max(title) FILTER (ok) AS title, string_agg(CASE WHEN ok THEN body ELSE number || ' ' || title || ' ' || body END, ' ' ORDER BY i) AS body FROM each WHERE sec_no > 0 GROUP BY ALL) """
)


@query(_OUTLINE + "SELECT k, number, title, body FROM found")
def numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.sections(_books(spark, sf_dir), "k", "text")


def _small_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_name")
    text = F.concat(F.lit("title page\n1 First part\nintro "), n, F.lit("\n1.1 Wet soil\nwater it\n1.1.1 Deep roots\n"), n, F.lit(" roots\n1. Kill the pods\n2 Second part\nno 2.5 heading\n2.3 Later on\nlater "), n, F.lit("\n2.4 More of it\nthe end"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.alias("text"))


@query(
    """SELECT n_nationkey, number, title, replace(body, '@', n_name) AS body FROM nation, (VALUES ('1', 'First part', 'intro @'), ('1.1', 'Wet soil', 'water it'), ('1.1.1', 'Deep roots', '@ roots 1. Kill the pods'), ('2', 'Second part', 'no 2.5 heading'), ('2.3;2.4', 'Later on', 'later @ More of it the end')) u(number, title, body)"""
)
def small_sections_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.sections(_small_books(spark, sf_dir), "n_nationkey", "text")
    return retrieval.merged_sections(found, "n_nationkey", 4)


@query("WITH t AS (SELECT o_custkey AS query_id, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_orderkey % 5 END AS weight, o_totalprice / 7 AS m FROM orders), w AS (SELECT *, median(weight) OVER (PARTITION BY query_id) AS mid FROM t) SELECT query_id, round(CASE WHEN sum(weight) > 0 THEN sum(weight * m) / sum(weight) ELSE avg(m) END, 3) AS weighted, min(m) FILTER (weight >= mid) AS hard FROM w GROUP BY query_id")
def sparse_weighted_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    m = o.select(F.col("o_custkey").alias("query_id"), F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") % 5).alias("weight"), (F.col("o_totalprice") / 7).alias("m"))
    return retrieval.sparse_weighted(m).withColumn("weighted", F.round("weighted", 3))


@query("SELECT l_orderkey AS query_id, count(DISTINCT l_returnflag) AS n_sections, count(DISTINCT l_returnflag) = 1 AS same_section, sum(l_linenumber) AS n_words FROM lineitem GROUP BY 1")
def passage_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("section"), F.col("l_linenumber").alias("n_words"))
    return retrieval.section_features(li).withColumn("n_words", F.col("n_words").cast("long"))


@query("SELECT c_custkey, '▁' || c_mktsegment || ' ' || c_name AS kept, CAST(2 AS INTEGER) AS n FROM customer")
def kept_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array(F.lit("<s>"), F.concat(F.lit("▁"), "c_mktsegment"), F.lit("▁"), F.lit("▁?!"), F.col("c_name"), F.lit("."), F.lit("</s>"))
    kept = retrieval.kept_tokens(tokens)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(kept, " ").alias("kept"), F.size(kept).alias("n"))


@query("WITH t AS (SELECT c_custkey, exp(c_acctbal / 10000) AS a, exp(c_nationkey / 10.0::DOUBLE) AS b, 1.0::DOUBLE AS c FROM customer) SELECT c_custkey, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM t")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ft.softmax(F.array((F.col("c_acctbal") / 10000).cast("double"), F.col("c_nationkey") / F.lit(10.0), F.lit(0.0)))
    return table(spark, sf_dir, "customer").select("c_custkey", p.alias("p")).select("c_custkey", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)])


@query("WITH t AS (SELECT vec_id, (embedding[1]::DOUBLE + 1) / 2 AS a, abs(embedding[2]::DOUBLE) * 3 AS b, embedding[3]::DOUBLE AS c, 2.0::DOUBLE AS d FROM embeddings) SELECT vec_id, round(least(1, 0.42 * least(1, greatest(0, a)) + 0.35 * least(1, greatest(0, b)) + 0.15 * least(1, greatest(0, c)) + 0.08), 6) AS risk FROM t")
def segment_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(fc.risk_score((e(0) + 1) / 2, F.abs(e(1)) * 3, e(2), F.lit(2.0)), 6).alias("risk"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 2500 WHEN 'MACHINERY' THEN 7500 WHEN 'FURNITURE' THEN 10000 END AS lux, CASE WHEN c_custkey % 100 > 50 THEN (c_custkey % 100 - 32) * 5 / 9.0::DOUBLE ELSE (c_custkey % 100)::DOUBLE END AS celsius, CASE WHEN c_custkey % 2 = 0 AND c_custkey > 10 THEN c_custkey / 1000.0::DOUBLE WHEN c_custkey % 2 = 0 THEN c_custkey::DOUBLE ELSE c_custkey + 0.5::DOUBLE END AS ec FROM customer")
def inferred_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    light = F.when(F.col("c_mktsegment") == "BUILDING", "Low").when(F.col("c_mktsegment") == "MACHINERY", "medium").when(F.col("c_mktsegment") == "FURNITURE", "bright_indirect").otherwise("dark")
    text = F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit(".5")))
    return table(spark, sf_dir, "customer").select("c_custkey", fc.sunlight_lux(light).alias("lux"), fc.celsius((k % 100).cast("double")).alias("celsius"), fc.milli_siemens(text).alias("ec"))


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 AND event_id % 3 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 6.2 ELSE 5.9 END::DOUBLE AS ph FROM events")
def form_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    df = e.select("event_id", F.when(F.col("user_id") % 4 == 0, 6.2).otherwise(5.9).alias("ph"), F.when(F.col("event_id") % 3 != 0, 1.0).alias("ec"), F.lit(None).cast("double").alias("moisture"))
    return cleaning.default_form_values(df, "ph", ["ec", "moisture"]).select("event_id", "ph")


@query("WITH " + PLACES + "SELECT id, coalesce(lat + id % 3 BETWEEN 5.9 AND 9.3 + 0.6 AND lon BETWEEN 79.5 AND 82.0, false) AND id % 7 <> 0 AS valid FROM places")
def valid_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.when(F.col("id") % 7 != 0, F.col("lat") + F.col("id") % 3)
    return places(spark, sf_dir).select("id", geo.valid_fix(lat, F.col("lon")).alias("valid"))


@query("WITH " + PLACES + "SELECT id, round((lon - 80.6957) * 111320 * cos(radians(7.3388)), 5) AS east, round((lat - 7.3388) * 111320, 5) AS north FROM places")
def local_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = geo.local_metres(F.col("lat"), F.col("lon"), F.lit(7.3388), F.lit(80.6957))
    return places(spark, sf_dir).select("id", F.round(e, 5).alias("east"), F.round(n, 5).alias("north"))


_UTM = """WITH c AS (SELECT 6378137.0::DOUBLE AS a, 2 / 298.257223563::DOUBLE - pow(1 / 298.257223563::DOUBLE, 2) AS e2), """


@query(
    _UTM
    + PLACES
    + """, g AS (SELECT id, a, e2, e2 / (1 - e2) AS p2, radians(lat) AS f, radians(lon - 81) AS l FROM places, c), h AS (SELECT *, a / sqrt(1 - e2 * pow(sin(f), 2)) AS n, pow(tan(f), 2) AS t, p2 * pow(cos(f), 2) AS cc, cos(f) * l AS x,
 a * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * f - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * sin(2 * f) + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * sin(4 * f) - (35 * e2 * e2 * e2 / 3072) * sin(6 * f)) AS m FROM g)
SELECT id, round(0.9996 * n * (x + (1 - t + cc) * pow(x, 3) / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * p2) * pow(x, 5) / 120) + 500000, 3) AS east,
 round(0.9996 * (m + n * tan(f) * (x * x / 2 + (5 - t + 9 * cc + 4 * cc * cc) * pow(x, 4) / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * p2) * pow(x, 6) / 720)), 3) AS north FROM h"""
)
def utm_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = geo.utm(F.col("lat"), F.col("lon"))
    return places(spark, sf_dir).select("id", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


@query("SELECT p_partkey, p_size * 4.0::DOUBLE AS area, p_size > 1 AND p_size <= 40 AS valid FROM part")
def route_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of p_size by 4 as rings, and as routes in an image of 40 by 40."""
    s = F.col("p_size").cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(s, F.lit(0.0)), corner(s, F.lit(4.0)), corner(F.lit(0.0), F.lit(4.0)))
    route = F.when(s > 1, ring).otherwise(F.slice(ring, 1, 1))
    return table(spark, sf_dir, "part").select("p_partkey", geo.shoelace(ring).alias("area"), trends.valid_route(route, 40, 40).alias("valid"))


_CLIP = """WITH r AS (SELECT p_partkey, p_size::DOUBLE AS w, (p_partkey % 7 + 1)::DOUBLE AS h, (p_partkey % 11)::DOUBLE AS c FROM part)"""


@query(
    _CLIP + """ SELECT p_partkey, round(CASE WHEN c >= w + h THEN w * h ELSE greatest(0, c * c / 2 - pow(greatest(0, c - w), 2) / 2 - pow(greatest(0, c - h), 2) / 2) END, 6) AS diagonal, round(least(w, c) * h, 6) AS upright,
 round(CASE WHEN c = 0 THEN NULL ELSE least(w, c) / 2 END, 6) AS cx, round(CASE WHEN c = 0 THEN NULL ELSE h / 2 END, 6) AS cy FROM r"""
)
def clipped_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles cut by x + y <= c, whose area is a triangle's less two corners', and by x <= c, whose centre is known."""
    k = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"), (k % 7 + 1).cast("double").alias("h"), (k % 11).cast("double").alias("c"))
    zero, w, h, c = F.lit(0.0), F.col("w"), F.col("h"), F.col("c")
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (w, zero), (w, h), (zero, h))])
    # Small rows that cost much: dealt out by number, as their file is one task.
    df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("ring", ring).withColumn("upright", geo.clipped(F.col("ring"), (c, zero), (F.lit(1.0), zero)))
    df = df.withColumn("centre", F.when(c > 0, geo.ring_centroid(F.col("upright"))))
    diagonal = geo.clipped(F.col("ring"), (c, zero), (F.lit(1.0), F.lit(1.0)))
    areas = {"diagonal": geo.shoelace(diagonal), "upright": geo.shoelace(F.col("upright")), "cx": F.col("centre.x"), "cy": F.col("centre.y")}
    return df.select("p_partkey", *[F.round(v, 6).alias(n) for n, v in areas.items()])


@query("""WITH p AS (SELECT c_custkey, 'A0' || CAST(c_nationkey % 5 + 1 AS VARCHAR) AS block, lpad(CAST(c_custkey % 100 AS VARCHAR), 3, '0') AS n FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE block || '-P' || n END AS slot_id, CASE WHEN c_custkey % 3 = 1 THEN 'Z' ELSE 'A' END AS zone, block FROM p""")
def located_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot from the record, else from the id; a zone of the plant, else from the id."""
    k = F.col("c_custkey")
    plant = F.concat(F.lit("A0"), (F.col("c_nationkey") % 5 + 1).cast("string"), F.lit("-P"), F.lpad((k % 100).cast("string"), 3, "0"), F.lit("-G"), k.cast("string"))
    c = table(spark, sf_dir, "customer").select("c_custkey", plant.alias("plant_id"), F.when(k % 3 == 0, "own").otherwise(" ").alias("slot_id"))
    p = c.where("c_custkey % 2 = 0 or c_custkey % 3 = 1").select("plant_id", F.lit("").alias("slot_id"), F.when(F.col("c_custkey") % 3 == 1, "Z").alias("zone"), F.lit(None).cast("string").alias("block"))
    return records.located(c, p).select("c_custkey", "slot_id", "zone", "block")


@query("SELECT o_orderkey, o_custkey IN (SELECT user_id FROM events) AS known FROM orders")
def rows_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    known, rest = twin.with_parents(o, table(spark, sf_dir, "events"), "user_id")
    return known.select("o_orderkey", F.lit(True).alias("known")).unionByName(rest.select("o_orderkey", F.lit(False).alias("known")))


@query("SELECT 'P' || CAST(c_custkey AS VARCHAR) || '-G' || CAST(c_nationkey AS VARCHAR) AS previous_plant_id, 'P' || CAST(c_custkey AS VARCHAR) || '-G' || CAST(c_nationkey + 1 AS VARCHAR) AS plant_id, c_nationkey + 1 AS generation, CAST(c_custkey AS VARCHAR) AS slot_id FROM customer WHERE c_custkey % 9 = 0")
def replaced_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, g = F.col("c_custkey").cast("string"), F.col("c_nationkey")
    plants = table(spark, sf_dir, "customer").select(F.concat(F.lit("P"), k, F.lit("-G"), g.cast("string")).alias("plant_id"), k.alias("slot_id"), g.alias("generation"), "c_custkey")
    day = F.lit("2026-01-01").cast("date")
    retired, born, slots = twin.replaced(plants.drop("c_custkey"), plants.where("c_custkey % 9 = 0").select("plant_id", day.alias("day")))
    both = born.join(retired.select(F.col("replaced_by").alias("plant_id")), "plant_id").join(slots.select(F.col("active_plant_id").alias("plant_id")), "plant_id")
    return both.select("previous_plant_id", "plant_id", "generation", "slot_id")


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'zone' ELSE 'block' END AS level, CAST(o_custkey AS VARCHAR) AS entity_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL")
def latest_area_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    t = o.select(F.when(F.col("o_orderkey") % 2 == 0, "zone").otherwise("block").alias("level"), F.col("o_custkey").cast("string").alias("entity_id"), F.col("o_orderdate").alias("window_end"), F.col("o_orderkey").alias("created_at"), "o_orderkey")
    return twin.latest_areas(t).select("level", "entity_id", "o_orderkey")


@query("WITH k AS (SELECT c_custkey AS k FROM customer), m AS (SELECT k // 100 AS cluster, k % 10 AS x, (k // 10) % 10 AS y FROM k) SELECT cluster, count(*) AS size, avg(x) AS cx, avg(y) AS cy, ((max(x) - min(x)) * (max(y) - min(y)))::DOUBLE AS area_m2 FROM m GROUP BY cluster")
def cluster_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full grids of 10 by 10, whose hulls are squares."""
    k = F.col("c_custkey")
    m = table(spark, sf_dir, "customer").select(F.floor(k / 100).alias("cluster"), (k % 10).cast("double").alias("x"), (F.floor(k / 10) % 10).cast("double").alias("y"))
    return spatial.cluster_summary(m, ["cluster"])


@query("SELECT c_custkey AS hotspot_id, row_number() OVER (ORDER BY c_custkey % 3 = 0 DESC, c_nationkey DESC, c_custkey) AS place FROM customer ORDER BY place LIMIT 20")
def hotspots_to_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of the first twenty, which is the page's length."""
    h = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hotspot_id"), (F.col("c_custkey") % 3 == 0).alias("referred"), F.col("c_nationkey").alias("size"))
    first = records.to_check(h).limit(20)
    w = Window.orderBy(F.desc("referred"), F.desc("size"), "hotspot_id")
    return first.select("hotspot_id", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT c_custkey AS plant_id, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE CASE WHEN c_custkey % 3 = 0 THEN 1.5 END END::DOUBLE AS lat FROM customer")
def plant_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    slots = c.where("c_custkey % 2 = 0").select(k.alias("slot_id"), F.col("c_acctbal").alias("latitude"), F.lit(1.0).alias("longitude"))
    old = c.where("c_custkey % 3 = 0").select(k.alias("plant_id"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"))
    return records.coordinates(c.select(k.alias("plant_id"), k.alias("slot_id")), slots, old).select("plant_id", "lat")


_D = HAVERSINE.format(a="a", b="b")
_NEAR = "WITH " + PLACES + f", d AS (SELECT a.id AS a, b.id AS b, {_D} AS distance FROM places a JOIN places b ON a.id % 50 = 0 WHERE {_D} <= 20.0), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM d) "


@query(_NEAR + "SELECT a, string_agg(CAST(b AS VARCHAR), ';' ORDER BY rank) AS ids, round(max(distance), 2) AS farthest FROM r WHERE rank <= 10 GROUP BY a")
def retrieval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    log = records.retrieval_log(spatial.nearest(p.where("id % 50 = 0"), p, 10, 20.0), "a")
    return log.select("a", F.array_join(F.transform("nearest", lambda n: n["b"].cast("string")), ";").alias("ids"), F.array_max(F.transform("nearest", lambda n: n["distance"])).alias("farthest"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS session_id, l_partkey AS slot_id FROM lineitem UNION ALL SELECT 'legacy-' || CAST(p_partkey AS VARCHAR), p_partkey FROM part")
def legacy_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("session_id"), F.col("l_partkey").alias("slot_id"))
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slot_id"))
    once = records.with_legacy_session(own, old)
    return records.with_legacy_session(once, old)


@query("SELECT event_id, ceil((epoch(TIMESTAMP '2024-02-10 12:00:00') - epoch(date_trunc('second', ts))) / 86400) > 30 AS expired FROM events")
def carried_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", records.carry_over_expired(t, F.lit("2024-02-10 12:00:00").cast("timestamp")).alias("expired"))


_EPS, _LEAST = [2.0, 3.0, 4.0, 6.0], [3, 5, 10]


@query(
    "WITH RECURSIVE " + PLACES + f""", g AS (SELECT eps, pts FROM (VALUES {", ".join(f"({e}::DOUBLE)" for e in _EPS)}) a(eps), (VALUES {", ".join(f"({k})" for k in _LEAST)}) b(pts)),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b, {_D} AS d FROM places a JOIN places b ON a.id <> b.id WHERE {_D} <= {max(_EPS)}), core AS MATERIALIZED (SELECT eps, pts, id FROM g JOIN (SELECT eps AS x, id, (SELECT count(*) FROM e WHERE e.a = places.id AND d <= eps) + 1 AS n FROM places, (SELECT DISTINCT eps FROM g)) ON x = eps AND n >= pts),
inner_ AS MATERIALIZED (SELECT ca.eps, ca.pts, e.a, e.b FROM e JOIN core ca ON ca.id = e.a AND e.d <= ca.eps JOIN core cb ON cb.id = e.b AND cb.eps = ca.eps AND cb.pts = ca.pts),
r AS (SELECT eps, pts, id, id AS c FROM core UNION SELECT i.eps, i.pts, i.b, r.c FROM r JOIN inner_ i ON i.a = r.id AND i.eps = r.eps AND i.pts = r.pts WHERE r.c < i.b), lab AS (SELECT eps, pts, id, min(c) AS c FROM r GROUP BY ALL),
bord AS (SELECT DISTINCT l.eps, l.pts, e.a AS id FROM e JOIN lab l ON l.id = e.b AND e.d <= l.eps), inside AS (SELECT eps, pts, id FROM lab UNION SELECT * FROM bord)
SELECT g.eps AS eps_m, g.pts AS min_pts, (SELECT count(DISTINCT c) FROM lab WHERE lab.eps = g.eps AND lab.pts = g.pts) AS clusters, (SELECT count(*) FROM places) - (SELECT count(*) FROM inside i WHERE i.eps = g.eps AND i.pts = g.pts) AS noise FROM g"""
)
def dbscan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.dbscan_grid(places(spark, sf_dir), _EPS, _LEAST)


_FLAGGED = "WITH RECURSIVE " + PLACES + f""", f AS (SELECT id % 3 AS cycle, id, lat, lon FROM places WHERE id % 2 = 0), e AS MATERIALIZED (SELECT a.cycle, a.id AS a, b.id AS b FROM f a JOIN f b ON a.cycle = b.cycle AND a.id <> b.id WHERE {_D} <= 5.0),
core AS MATERIALIZED (SELECT a AS id FROM e GROUP BY a HAVING count(*) + 1 >= 3), i AS MATERIALIZED (SELECT a, b FROM e WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
r AS (SELECT id, id AS c FROM core UNION SELECT i.b, r.c FROM r JOIN i ON i.a = r.id WHERE r.c < i.b), lab AS (SELECT id, min(c) AS label FROM r GROUP BY id), bord AS (SELECT e.a AS id, min(l.label) AS label FROM e JOIN lab l ON l.id = e.b WHERE e.a NOT IN (SELECT id FROM core) GROUP BY e.a),
al AS (SELECT * FROM lab UNION ALL SELECT * FROM bord), found AS (SELECT f.cycle, coalesce(al.label, -1) AS cluster, f.id FROM f LEFT JOIN al USING (id)) """


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = places(spark, sf_dir).select("id", (F.col("id") % 3).alias("cycle"), "lat", "lon", (F.col("id") % 2 == 0).alias("flag"))
    return spatial.detected(rows, "flag", 5.0, 3)


@query(_FLAGGED + "SELECT cycle, cluster, id FROM found")
def hotspots_by_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir)


@query(_FLAGGED + "SELECT cycle, count(DISTINCT cluster) FILTER (cluster <> -1) AS hotspots, count(*) FILTER (cluster <> -1) AS clustered, count(*) FILTER (cluster = -1) AS noise FROM found GROUP BY cycle")
def hotspot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.hotspot_counts(_detected(spark, sf_dir))


@query(
    """WITH p AS (SELECT c_custkey AS k, c_nationkey % 3 AS zone, c_nationkey AS block, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 50)::DOUBLE END AS x, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 70)::DOUBLE END AS y FROM customer),
a AS (SELECT *, median(x) OVER b AS ax, median(y) OVER b AS ay, row_number() OVER (PARTITION BY zone, block, x IS NULL ORDER BY k) - 1 AS i FROM p WINDOW b AS (PARTITION BY zone, block))
SELECT k, x IS NULL AS placed, round(coalesce(x, ax + 3 * sqrt(i + 1) * cos(i * 2.399963229728653)), 5) AS x, round(coalesce(y, ay + 3 * sqrt(i + 1) * sin(i * 2.399963229728653)), 5) AS y FROM a"""
)
def plants_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    known = lambda n: F.when(k % 4 != 0, (k % n).cast("double"))
    p = table(spark, sf_dir, "customer").select(k.alias("k"), (F.col("c_nationkey") % 3).alias("zone"), F.col("c_nationkey").alias("block"), known(50).alias("x"), known(70).alias("y"))
    return spatial.placed_in_zone(p, "k").select("k", "placed", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


_KDIST = f"""k AS (SELECT d AS kdist FROM (SELECT a.id, {_D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS rn FROM places a JOIN places b ON a.id <> b.id) WHERE rn = 4), o AS (SELECT kdist, row_number() OVER (ORDER BY kdist) AS i, count(*) OVER () AS n, min(kdist) OVER () AS lo, max(kdist) OVER () AS hi FROM k),
elbow AS (SELECT max_by(kdist, abs((i - 1) / CAST(n - 1 AS DOUBLE) - (kdist - lo) / greatest(hi - lo, 1e-9))) AS e FROM o)"""


@query("WITH " + PLACES + ", " + _KDIST + " SELECT gps_error, round(greatest(e, 2 * gps_error), 5) AS eps FROM elbow, (VALUES (0.1::DOUBLE), (50.0::DOUBLE)) g(gps_error)")
def chosen_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a small position error the elbow decides, under a large one twice the error."""
    k = cut(spatial.k_distances(places(spark, sf_dir), 4))
    one = lambda g: spatial.chosen_eps(k, g).select(F.lit(g).alias("gps_error"), F.round("eps", 5).alias("eps"))
    return one(0.1).unionByName(one(50.0))


@query(
    "WITH " + JUDGED + """, f AS (SELECT source, avg(CASE WHEN quality = guess THEN 1.0::DOUBLE ELSE 0 END) - avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END) AS d FROM judged GROUP BY source),
s AS (SELECT avg(d) AS mean, avg(d) / sqrt((1 / CAST(count(*) AS DOUBLE) + 0.25) * var_samp(d)) AS t, count(*) - 1 AS df FROM f) SELECT round(mean, 6) AS mean, round(t, 5) AS t, df, round("""
    + t_tail("abs(t)", "df")
    + ", 6) AS p FROM s"
)
def corrected_t_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = lambda c: F.avg((F.col("quality") == F.col(c)).cast("double"))
    d = judged(spark, sf_dir).groupBy("source").agg((right("guess") - right("toxic")).alias("d"))
    return evaluate.corrected_t(d, "d", 0.2).select(F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"), "df", F.round("p", 6).alias("p"))


@query("SELECT o_custkey, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) * 0.1, 4) AS observed_cm, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 0) * 0.1, 4) AS estimated_cm FROM orders GROUP BY o_custkey")
def observed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") != "F").alias("estimated"), F.col("o_totalprice").alias("length"))
    return graph.observed_and_estimated(o, "o_custkey", 0.1).select("o_custkey", *[F.round(c, 4).alias(c) for c in ("observed_cm", "estimated_cm")])


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS s, l_quantity::DOUBLE AS x, l_discount * 100 AS y FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT k, s, x + 1 AS x, y * 2 AS y FROM a),
n AS (SELECT a.k, 1 AS w, a.s, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM a JOIN b USING (k) GROUP BY ALL UNION ALL SELECT b.k, 2, b.s, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) FROM b JOIN a USING (k) GROUP BY ALL),
m AS (SELECT k, w, avg(d) AS d FROM n GROUP BY ALL) SELECT k, round(avg(d), 5) AS disagreement FROM m GROUP BY k""")
def route_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4")
    li = li.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("step"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 100).alias("y")).count().drop("count")
    b = li.select("k", "step", (F.col("x") + 1).alias("x"), (F.col("y") * 2).alias("y"))
    return graph.route_disagreement(li, b, "k").withColumn("disagreement", F.round("disagreement", 5))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k, l_linenumber % 3 AS r, l_partkey AS s, l_quantity::DOUBLE AS x, l_discount::DOUBLE * 100 AS y FROM lineitem),
n AS (SELECT a.k, a.r, b.r AS q, a.s, a.x, a.y, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM a JOIN a b ON b.k = a.k AND b.r <> a.r GROUP BY ALL), w AS (SELECT k, r, q, s, min(d) AS d FROM n GROUP BY ALL),
m AS (SELECT k, r, q, avg(d) AS d FROM w GROUP BY ALL), p AS (SELECT k, least(r, q) AS a, greatest(r, q) AS b, avg(d) AS d FROM m GROUP BY ALL) SELECT k, round(max(d), 5) AS disagreement FROM p GROUP BY k""")
def route_disagreement_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines dealt into three routes."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 3).alias("r"), F.col("l_partkey").alias("step"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount").cast("double") * 100).alias("y")).distinct()
    return graph.routes_disagreement(li, "k", "r").withColumn("disagreement", F.round("disagreement", 5))


@query("SELECT DATE '2024-01-01' AS start, greatest(DATE '2024-01-31', CAST(max(ts) AS DATE) + 1) AS end FROM events")
def study_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.study_window(table(spark, sf_dir, "events"), "ts", "2024-01-01", "2024-01-31")


@query("SELECT l_orderkey, l_linenumber, p_brand AS plant_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 2 = 0")
def fixes_of_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("slot_id"))
    p = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("slot_id"), F.col("p_brand").alias("plant_id"))
    return records.fixes_of_plants(f, p).drop("slot_id")


@query("SELECT d.doc_id, n_chars, quality, source FROM documents d JOIN labels USING (doc_id)")
def features_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    x = d.join(y.select("doc_id"), "doc_id", "left_semi")
    return records.checked_join(x.select("doc_id", "n_chars"), y, d.select("doc_id", "source"), "doc_id", "quality", 2)
