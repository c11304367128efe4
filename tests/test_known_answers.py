"""Small cases with known answers."""

import datetime as dt
import math
import shutil

import pytest
from pyspark.sql import functions as F

from fieldlark.functions import cleaning as fc
from fieldlark.functions import geo
from fieldlark.functions import text as ft
from fieldlark.operators import cleaning, evaluate, gps, graph, learn, permutation, records, retrieval, spatial, temporal, tracks, twin
from fieldlark.sources import cache


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_ids_and_numbers(spark):
    for raw, want in [("a01-p1-g1", "A01-P001-G1"), ("A1-P1-G1", "A01-P001-G1"), ("A01_P001_G1", "A01-P001-G1"), ("E01-P001-G1", None), ("x", None)]:
        assert one(spark, fc.plant_id(F.lit(raw))) == want
    for raw, want in [("24.5°C", 24.5), ("78%", 78.0), ("6,4", 6.4), ("1.5d", 1.5), ("--", None), ("", None)]:
        assert one(spark, fc.number(F.lit(raw))) == want
    assert [one(spark, fc.is_number(F.lit(s))) for s in ("1.5", "1.5d", "inf", " 2 ")] == [True, False, False, True]


def test_dates(spark):
    lit = lambda d: F.lit(d).cast("date")
    run = lambda raw, created: one(spark, fc.reconciled_date(F.lit(raw), lit(created), lit("2026-07-01"), lit("2026-10-31")))
    assert tuple(run("05/08/2026", "2026-08-05")) == (dt.date(2026, 8, 5), "ok")
    assert tuple(run("08/05/2026", "2026-08-05")) == (dt.date(2026, 8, 5), "ok")
    assert tuple(run("2026-09-01 00:00", "2026-08-05")) == (dt.date(2026, 9, 1), "parsed")
    assert tuple(run("nonsense", "2026-08-05")) == (dt.date(2026, 8, 5), "reconciled_from_created_at")


def test_lags_and_interpolation(spark):
    df = spark.createDataFrame([("p", i, float(m)) for i, m in enumerate([4, 8, 6])], "p string, i int, moisture double")
    rows = temporal.lag_features(df, "p", ["i"], ["moisture"]).orderBy("i").collect()
    assert [r.moisture_prev for r in rows] == [4, 4, 8] and [r.moisture_delta for r in rows] == [0, 4, -2]
    days = [dt.date(2026, 7, d) for d in (1, 8, 15)]
    df = spark.createDataFrame(list(zip("ppp", days, [6.0, None, 6.4], strict=True)), "p string, day date, ph double")
    assert [round(r.ph, 6) for r in cleaning.interpolated(df, "p", "day", "ph").orderBy("day").collect()] == [6.0, 6.2, 6.4]


def test_onsets_and_peers(spark):
    df = spark.createDataFrame([("p", i, f) for i, f in enumerate([True, False, True, True, True])], "p string, c int, flag boolean")
    assert [r.onset for r in temporal.run_onsets(df, "p", "c", "flag").orderBy("c").collect()] == [0, None, 2, 2, 2]
    values = [1.0, 2.0, 2.0, 9.0, 5.0]
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate(values)] + [(9, "g", None)], "i int, g string, v double")
    got = {r.i: r.peer_dev for r in temporal.peer_deviation(df, ["g"], "v").collect()}
    for i, v in enumerate(values):
        rest = sorted(values[:i] + values[i + 1 :])
        assert got[i] == pytest.approx(v - (rest[1] + rest[2]) / 2)
    assert got[9] is None


def test_distances(spark):
    d = one(spark, geo.haversine(F.lit(7.3388), F.lit(80.6957), F.lit(7.3388 + 50 / 111_195), F.lit(80.6957)))
    assert abs(d - 50) < 0.2
    (e1, n1), (e2, n2) = (geo.utm(F.lit(a), F.lit(b)) for a, b in ((7.3388, 80.6957), (7.3398, 80.6967)))
    planar = one(spark, F.sqrt(F.pow(e1 - e2, 2) + F.pow(n1 - n2, 2)))
    sphere = one(spark, geo.haversine(F.lit(7.3388), F.lit(80.6957), F.lit(7.3398), F.lit(80.6967)))
    assert abs(planar / sphere - 1) < 0.006
    assert geo.polygon_area(geo.convex_hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)])) == 4


def line(spark, metres):
    return spark.createDataFrame([(i, 7.3388, 80.6957 + m / (111_194.93 * math.cos(math.radians(7.3388)))) for i, m in enumerate(metres)], "id long, lat double, lon double")


def test_dbscan(spark):
    points = line(spark, [0, 5, 10, 100])
    assert [r.cluster for r in spatial.dbscan(points, 6, 3).orderBy("id").collect()] == [1, 1, 1, -1]
    assert [r.cluster for r in spatial.numbered(spatial.dbscan(points, 6, 3)).orderBy("id").collect()] == [0, 0, 0, -1]
    assert [r.cluster for r in spatial.dbscan(points, 4, 3).orderBy("id").collect()] == [-1] * 4
    assert spatial.dbscan(points.limit(0), 6, 3).count() == 0


def test_elbow(spark):
    df = spark.createDataFrame([(i, float(k)) for i, k in enumerate([5, 5.5, 6, 6.2, 6.5, 40, 45])], "id long, kdist double")
    assert spatial.elbow(df).first()["elbow"] == 6.5


def test_join_count(spark):
    points = line(spark, [0, 5, 10, 15, 20, 25, 30, 35]).withColumn("flag", F.col("id") < 5).withColumn("zone", F.lit("A"))
    edges = spatial.edges_within(points, 6)
    r = permutation.join_count_test(points, edges, "flag", ["zone"], 199).first()
    assert r["join_count"] == 4 and 0 < r["p"] <= 0.2


def test_tracks(spark):
    rows = [("r", 0, 1, i, float(i), 0.0, 0.0) for i in (1, 2, 3)] + [("r", 1, 1, i, float(i), 0.0, float(i > 3)) for i in (1, 2, 3, 4)] + [("r", 1, 2, 9, 99.0, 0.0, 1.0)]
    rows += [("r", 2, 1, i, float(i), 0.0, 0.0) for i in (2, 3, 4, 30)]
    df = spark.createDataFrame(rows, "run string, cycle int, cluster int, id long, x double, y double, onset double")
    got = {(r.cycle, r.hotspot_id): r for r in tracks.tracks(df, "run", 5.0).collect()}
    assert {k: r.status for k, r in got.items()} == {(0, "H001"): "new", (1, "H001"): "expanding", (1, "H002"): "new", (2, "H001"): "persistent", (2, "H002"): "resolved"}
    assert [got[c, "H001"].added for c in range(3)] == [0, 1, 1] and [got[c, "H001"].persistence for c in range(3)] == [1, 2, 3]
    one, two = got[1, "H001"], got[2, "H001"]
    assert (one.adjacent, one.shift_m, one.net_growth, one.adjacent_total) == (1.0, 0.5, 1, None) and (two.adjacent, two.adjacent_total) == (0.0, 0.5)
    assert one.onset_spread == pytest.approx(math.sqrt(3) / 4) and got[2, "H002"].persistence == 1


def test_field_plan(spark):
    day = dt.date
    rows = [
        ("a", "high-risk", day(2026, 1, 1), 7.0, "gps", "likely_disease", 180), ("b", "moderate", day(2026, 1, 1), 7.0, None, "uncertain_expert_review", 110), ("c", "not-inspected", None, None, None, None, 55),
        ("d", "healthy", day(2026, 3, 1), 7.0, "single_fix", None, 15), ("e", "dead", day(2026, 1, 1), None, None, "likely_disease", None), ("f", "high-risk", day(2026, 3, 1), 7.0, "smoothed", None, None),
    ]
    df = spark.createDataFrame(rows, "plant_id string, status string, last_day date, latitude double, location_source string, likely_cause string, want int").withColumn("longitude", F.col("latitude"))
    plan = twin.top_of_plan(twin.field_plan(df, F.lit("2026-03-10").cast("date")), "plant_id", 9).collect()
    assert [r.plant_id for r in plan] == ["a", "b", "c", "d"] and all(r.priority == r.want for r in plan)
    assert plan[0].reasons == ["disease_hotspot", "high_risk_stale"] and plan[2].reasons == ["never_inspected", "weak_location"]


def test_class_before_date(spark):
    lit = lambda v, t="string": F.lit(v).cast(t)
    status = lambda c, d: one(spark, twin.status(lit(c), F.lit("Green"), F.lit(6.2), lit(d, "date")))
    assert [status("Poor", None), status("MODERATE", "2026-01-01"), status("healthy", None), status("odd", None), status("odd", "2026-01-01")] == ["high-risk", "moderate", "healthy", "not-inspected", "healthy"]


def test_question_class(spark):
    ask = lambda t: one(spark, ft.question_class(F.lit(t), [("why", "so", "reason"), ("many", None, "amount")], {"who": ["who"], "what": ["wha"]}, {"what": ["which"]}, ["ever"]))
    assert [ask(t) for t in ("Why so, who?", "how many of what", "many", "whatever who", "what ever is it", "(which)?", "")] == ["reason", "amount", "other", "who", "other", "what", "other"]


def test_rolling_weights(spark):
    values = [1.0, None, 4.0, 2.0, 8.0]
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate(values)], "p string, i int, v double")
    import pandas as pd

    want = pd.Series(values).ewm(alpha=0.4).mean().tolist()
    assert [r.ewm for r in temporal.ewm(df, "p", ["i"], "v").orderBy("i").collect()] == pytest.approx(want)
    long = spark.range(5000).select(F.lit("p").alias("p"), F.col("id").alias("i"), F.sin("id").alias("v"))
    want = pd.Series([math.sin(i) for i in range(5000)]).ewm(alpha=0.4).mean().tolist()
    assert [r.ewm for r in temporal.ewm(long, "p", ["i"], "v").orderBy("i").collect()] == pytest.approx(want)


def test_checked_join(spark):
    f = lambda rows, c: spark.createDataFrame(rows, f"k int, {c} int")
    x, y, m = f([(1, 5), (2, 6)], "x"), f([(1, 0), (2, 1)], "y"), f([(1, 7), (2, 8), (3, 9)], "m")
    assert sorted(tuple(r) for r in records.checked_join(x, y, m, "k", "y", 2).collect()) == [(1, 5, 0, 7), (2, 6, 1, 8)]
    for bad in [(x.unionAll(x), y, m, 2), (x, y.limit(1), m, 2), (x, y, m, 3)]:
        with pytest.raises(Exception, match="rows without one partner"):
            records.checked_join(*bad[:3], "k", "y", bad[3]).collect()


def test_coverage_and_upsert(spark):
    layout = {"A": (5, 5), "B": (4, 8), "C": (3, 8), "D": (2, 10)}
    grid = twin.expected_slots(layout, spark.range(1))
    assert grid.count() == 101
    found = spark.createDataFrame([("A01-P001",), ("A01-P001",), ("Z99-P001",)], "slot_id string")
    assert {r.state: r.n for r in twin.coverage_check(grid, found).collect()} == {"present": 1, "missing": 100, "unexpected": 1, "duplicate": 1}
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "k int, v string, t int")
    up = twin.upsert(old, new, ["k"], "t")
    assert {r.k: r.v for r in up.collect()} == {1: "c", 2: "b", 3: "e"}
    assert sorted(twin.upsert(up, new, ["k"], "t").collect()) == sorted(up.collect())


def test_status(spark):
    rows = [("Red", 6.2, "dead"), ("Brown", 6.2, "high-risk"), ("Green", 5.0, "high-risk"), ("Yellow", 6.2, "moderate"), ("Green", 5.7, "moderate"), ("Green", 6.2, "healthy")]
    for foliage, ph, want in rows:
        assert one(spark, twin.status(F.lit(None).cast("string"), F.lit(foliage), F.lit(ph), F.lit("2026-01-01").cast("date"))) == want
    assert one(spark, twin.status(F.lit(None).cast("string"), F.lit("Green"), F.lit(6.2), F.lit(None).cast("date"))) == "not-inspected"


def test_text(spark):
    assert one(spark, ft.words(F.lit(" Hello, (world)! "))) == ["Hello", "world"]
    assert one(spark, ft.small_talk(F.lit("Hello!"))) == "greeting" and one(spark, ft.small_talk(F.lit("hi how do you grow a vine"))) is None
    assert one(spark, ft.without_greeting(F.lit("Hello, how are vines fed?"), ["hello", "hi"])) == "how are vines fed?"
    assert one(spark, ft.section_references(F.lit("see 3.1 and 4.2.1"))) == ["3.1", "4.2.1"]
    docs = spark.createDataFrame([(1, "1 Intro\nbody a\n1.1 Part\nbody b\n9.9 no heading\n2 Next\nbody c")], "id int, text string")
    assert [(r.number, r.body) for r in retrieval.sections(docs, "id", "text").collect()] == [("1", "body a"), ("1.1", "body b 9.9 no heading"), ("2", "body c")]


def test_statistics(spark):
    df = spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 2, "a boolean, b boolean")
    assert evaluate.mcnemar(df, "a", "b").first()["p"] == pytest.approx(0.109375, abs=1e-9)
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(20)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(0.55)
    assert evaluate.mann_whitney(df.withColumn("g", F.col("y") == 1), "g", "s").first()["u"] == 55
    r = evaluate.bootstrap(df, "s", 200, buckets=20).first()
    assert r["low"] < r["mean"] < r["high"]


def test_kalman_and_dispersion(spark):
    df = spark.createDataFrame([("s", i, float(i % 3), float(i % 2), 5.0) for i in range(12)], "s string, i int, x double, y double, acc double")
    k = gps.kalman(df, ["s"], "x", "y", "acc", ["i"], 0.0).first()
    assert (k["kalman_x"], k["kalman_y"]) == (pytest.approx(1.0), pytest.approx(0.5))
    d = gps.dispersion(df, ["s"], "x", "y", "acc").first()
    assert d["n"] == 12 and d["cep50"] <= d["cep95"]


def test_graph(spark):
    pix = spark.createDataFrame([(1, x, 0) for x in range(30)] + [(1, 15, 1), (1, 15, 2)] + [(1, 60, 60)], "image int, x int, y int")
    stem = graph.main_stems(graph.pixel_edges(pix)).orderBy("step").collect()
    assert len(stem) == 30 and stem[0].length == pytest.approx(29)


def test_folds_do_not_leak(spark):
    df = spark.createDataFrame([(i, i % 13, i % 2) for i in range(200)], "id int, g int, y int")
    folds = learn.group_folds(df, "g", "y", 4)
    assert learn.leaking_groups(folds, "g").isEmpty() and folds.select("fold").distinct().count() == 4


def test_changed_predictions(spark):
    """Rows that are not changed keep their prediction, and no model has seen the row it scores."""
    df = spark.createDataFrame([(i, float(i % 7), float(i % 7 > 3)) for i in range(120)], "id int, x double, y double")
    folds = learn.repeated_folds(df, "id", "y", 2, 3)
    p = learn.changed_predictions(df, {"same": df, "high": df.withColumn("x", F.lit(9.0))}, learn.pipeline(["x"], [], "y"), folds, "id", 2, 3)
    p = {(r.id, r.variant): r.p for r in p.collect()}
    assert len(p) == 360 and all(p[i, "same"] == p[i, "original"] and p[i, "high"] >= p[i, "original"] and p[i, "high"] > 0.5 for i in range(120))
    one_odd = spark.createDataFrame([(i, float(i == 5), float(i == 5 or i % 2)) for i in range(60)], "id int, x double, y double")
    own = one_odd.select("id", F.lit(0).alias("repeat"), F.when(F.col("id") == 5, 0).otherwise(1).alias("fold"))
    p = learn.changed_predictions(one_odd, {}, learn.pipeline(["x"], [], "y"), own.where("fold = 0"), "id", 1, 1).collect()
    assert [r.id for r in p] == [5] and p[0].p == pytest.approx(0.5, abs=0.02)  # the mark of row 5 alone says nothing without it


def test_boosted_classes(spark):
    df = spark.createDataFrame([(float(i % 3), float(i % 3) * 2 + (i % 5) / 10) for i in range(90)], "y double, x double")
    model = learn.pipeline(["x"], [], "y", "boost", rounds=5).fit(df)
    assert model.transform(df).where("prediction != y").isEmpty()


def test_cache(spark, tmp_path):
    df, built = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), []

    def build():
        built.append(1)
        return df.select("k")

    for model, rows in (("m", df), ("m", df.orderBy(F.desc("k"))), ("m2", df), ("m", df.where("k = 1")), ("m", df)):
        assert cache.cached(spark, str(tmp_path), model, {"rows": rows}, build).count() == 2
    assert len(built) == 3
    for d in tmp_path.glob("*/description"):  # as a run leaves it that broke off before the end
        shutil.rmtree(d)
    cache.cached(spark, str(tmp_path), "m", {"rows": df}, build)
    assert len(built) == 4


def test_top_k_apart(spark):
    rows = [(i, [1.0, float(i)], i % 2) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, part int")
    got = {(r.query_id, r.item_id) for r in retrieval.top_k(df.where("id <= 5"), df, 2, 3, apart="part").collect()}
    assert got == {(q, i) for q in range(1, 6) for i in ((28, 26) if q % 2 else (29, 27))}


def test_study_window(spark):
    df = spark.createDataFrame([("2026-11-05T10:00:00",), (None,), ("2026-08-01T00:00:00",)], "t string")
    end = lambda d: str(records.study_window(d, "t", "2026-07-01", "2026-10-31").first()["end"])
    assert (end(df), end(df.where("t < '2026-09'")), end(df.limit(0))) == ("2026-11-06", "2026-10-31", "2026-10-31")


def test_gaps_of_stems(spark):
    from fieldlark.operators import gaps

    p = lambda x, y: (float(x), float(y))
    rows = [
        ("straight on", p(0, 0), p(30, 0), p(1, 0), p(1, 0)), ("no tangents", p(0, 0), p(30, 40), None, None), ("against travel", p(0, 0), p(30, 0), p(-1, 0), p(0, 1)), ("too far", p(0, 0), p(161, 0), p(1, 0), p(1, 0)),
        ("bend", p(0, 0), p(20, 0), p(0.6, 0.8), p(0.6, -0.8)), ("same point", p(5, 5), p(5, 5), None, p(1, 0)),
    ]
    df = spark.createDataFrame(rows, "k string, p0 struct<x:double,y:double>, p1 struct<x:double,y:double>, t0 struct<x:double,y:double>, t1 struct<x:double,y:double>")
    got = {r.k: r for r in gaps.filled_gaps(df).collect()}
    assert {k: r.method for k, r in got.items()} == {"straight on": "hermite", "no tangents": "hermite", "against travel": "hermite", "too far": "too_long", "bend": "hermite", "same point": "straight"}
    assert got["straight on"].length == pytest.approx(30) and got["no tangents"].length == pytest.approx(50) and got["against travel"].length == pytest.approx(30)
    assert got["too far"].length is None and len(got["straight on"].points) == 90 and got["same point"].length == 0
    mid = got["bend"].points[len(got["bend"].points) // 2]
    assert 20 < got["bend"].length < 36 and mid.y == pytest.approx(0.8 * 0.55 * 20 / 4, rel=0.02)
    # The same curve under a tighter limit is given up for its chord.
    tight = {r.k: r for r in gaps.filled_gaps(df, most_bend=1.01).collect()}
    assert tight["bend"].method == "straight" and tight["bend"].length == 20 and all(q.y == 0 for q in tight["bend"].points)
    # The directions at a gap come from 20 pixels of stem on either side.
    stem = spark.createDataFrame([("a", 1, [p(0, 0), p(0, 25), p(0, 50)]), ("a", 2, [p(0, 60), p(30, 60)]), ("a", 3, [p(40, 60)])], "k string, s int, points array<struct<x:double,y:double>>")
    g = {r.s: r for r in gaps.stem_gaps(stem, "k", "s", "points").collect()}
    assert tuple(g[1].t0) == (0, 1) and tuple(g[1].t1) == (1, 0) and tuple(g[2].t0) == (1, 0) and g[2].t1 is None


def test_density_clusters_against_brute_force(spark):
    import random

    from fieldlark.operators import density

    assert density.reach_of_cells()
    rng, deg = random.Random(4), 180 / math.pi / 6_371_000
    for lat0, metres, least in [(7.3, 5.0, 4), (59.9, 5.0, 3), (0.0, 3.0, 1), (-45.0, 4.0, 9)]:
        pts = [(i, i % 2, lat0 + rng.gauss(0, 12) * deg, 80 + rng.choice([rng.gauss(0, 12), rng.gauss(60, 3)]) * deg) for i in range(240)]
        pts += [(1000 + i, 0, lat0, 80.0) for i in range(30)]

        def near(a, b, metres=metres):
            h = math.sin(math.radians(a[2] - b[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(a[3] - b[3]) / 2) ** 2
            return a[1] == b[1] and 2 * 6_371_000 * math.asin(math.sqrt(h)) <= metres

        around = {a[0]: [b[0] for b in pts if near(a, b)] for a in pts}
        core = {i for i, n in around.items() if len(n) >= least}
        label = {i: i for i in core}
        while True:
            new = {i: min(label[j] for j in around[i] if j in core) for i in core}
            if new == label:
                break
            label = new
        want = {i: label.get(i, min((label[j] for j in n if j in core), default=None)) for i, n in around.items()}
        df = spark.createDataFrame([*pts, (5000, 0, None, 80.0)], "id long, g int, lat double, lon double")
        assert {r.id: r.cluster for r in density.clusters(df, metres, least, ["g"]).collect()} == want | {5000: None}


def test_swap_or_not_is_a_permutation():
    import numpy as np

    from fieldlark.operators import permutation

    for n in (1, 2, 7, 64, 101):
        at = permutation.places(np.arange(n), np.full(n, n), 50, seed=3)
        assert all(sorted(at[:, r]) == list(range(n)) for r in range(50))
    at = permutation.places(np.arange(20), np.full(20, 20), 4000)
    assert abs(np.bincount(at[3], minlength=20) - 200).max() < 75  # each place alike often
    assert abs(((at[0] < 5) & (at[1] < 5)).mean() - 5 * 4 / (20 * 19)) < 0.015  # pairs as without replacement


def test_a_planted_patch_is_significant(spark):
    from fieldlark.operators import permutation

    step = 5 / (111_194.93 * math.cos(math.radians(7.3388)))
    df = spark.createDataFrame([(i, "z", 7.3388 + (i // 10) * 5 / 111_194.93, 80.6957 + (i % 10) * step, i % 10 < 3 and i < 30) for i in range(60)], "id long, zone string, lat double, lon double, flag boolean")
    edges = spatial.edges_within(df, 6.5)
    r = permutation.join_count_test(df, edges, "flag", ["zone"]).first()
    assert r["join_count"] == 12 and r["p"] <= 0.01
    s = permutation.clustered_share_test(df, edges, "flag", ["zone"], 3).first()
    assert s["observed"] == 1.0 and s["p"] <= 0.02
    mixed = df.withColumn("flag", F.col("id") % 7 == 0)
    assert permutation.join_count_test(mixed, edges, "flag", ["zone"]).first()["p"] > 0.5


def test_tracks_take_each_cluster_once(spark):
    """Two clusters want the same one before: the one that shares more takes it; a cycle without clusters ends a track."""
    at = lambda c, k, ids: [("r", c, k, i, float(i), 0.0, 0.0) for i in ids]
    df = spark.createDataFrame(at(0, 1, [1, 2, 3, 4]) + at(1, 7, [1]) + at(1, 8, [2, 3, 4]) + at(3, 1, [2, 3, 4]), "run string, cycle int, cluster int, id long, x double, y double, onset double")
    all_cycles = spark.createDataFrame([("r", c) for c in range(5)], "run string, cycle int")
    got = sorted((r.cycle, r.hotspot_id, r.status, r.size, r.persistence) for r in tracks.tracks(df, "run", 1.6, 0.2, all_cycles).collect())
    assert got == [(0, "H001", "new", 4, 1), (1, "H001", "shrinking", 3, 2), (1, "H002", "new", 1, 1), (2, "H001", "resolved", 0, 2), (2, "H002", "resolved", 0, 1), (3, "H003", "new", 3, 1), (4, "H003", "resolved", 0, 1)]


def test_outline(spark):
    text = "0.1 Preface\nwords\n1. First\n 2.1 Not here\n1.2 Second level\n1.2.3 Third level\n1. Kill the pods\n1.2.3.4 Too deep\n2 lower case\n2.\n2 Ab\n2 Then this\n3.4 Later\n1.2.9 Closed"
    got = [(r.number, r.title, r.body) for r in retrieval.sections(spark.createDataFrame([(1, text), (2, None), (3, "no outline")], "id int, text string"), "id", "text").collect()]
    assert got == [("0.1", "Preface", "words"), ("1", "First", "2.1 Not here"), ("1.2", "Second level", ""), ("1.2.3", "Third level", "1. Kill the pods 1.2.3.4 Too deep 2 lower case 2. 2 Ab"), ("2", "Then this", "3.4 Later 1.2.9 Closed")]


def test_block_top_k_against_numpy(spark):
    import numpy as np

    rng = np.random.RandomState(3)
    v = rng.randint(-3, 4, (700, 3)).astype(float)  # small whole numbers: many ties
    df = spark.createDataFrame([(i, x.tolist(), i % 7 if i % 5 else None) for i, x in enumerate(v)], "id long, vector array<double>, part int").repartition(5)
    q = df.where("id % 10 = 0")
    s = v[::10] @ v.T
    for apart in (None, "part"):
        got = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in retrieval.top_k(q, df, 4, query_block=16, item_block=90, apart=apart).collect()}
        for k, row in enumerate(s):
            i = 10 * k
            other = [j for j in range(700) if not apart or i % 5 == 0 or j % 5 == 0 or j % 7 != i % 7]
            want = sorted(other, key=lambda j: (-row[j], j))[:4]
            assert [got[i, n + 1] for n in range(4)] == [(j, row[j]) for j in want]
    assert retrieval.top_k(q.limit(0), df, 2).count() == 0 and retrieval.top_k(q, df.limit(0), 2).count() == 0


def test_probabilities(spark):
    from fieldlark.functions import probability

    for z in (0.0, 1.0, 1.96, 2.99, 3.01, 6.0, 20.0):
        assert one(spark, probability.normal_two_sided(F.lit(z))) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)
    for t, n, p in [(1.0, 1, 0.5), (12.706204736432095, 1, 0.05), (4.302652729911275, 2, 0.05), (2.093024054408263, 19, 0.05), (2.0095752371292397, 49, 0.05), (0.0, 7, 1.0), (3.169272667175838, 10, 0.01)]:
        assert one(spark, probability.t_two_sided(F.lit(t), F.lit(n))) == pytest.approx(p, rel=1e-7)
        if 0 < p < 1:
            assert one(spark, probability.t_quantile(F.lit(n), p)) == pytest.approx(t, rel=1e-7)
    same = spark.createDataFrame([(0.5,)] * 4, "d double")
    assert tuple(evaluate.corrected_t(same, "d", 0.2).select("p", "ci_low", "ci_high").first()) == (0.0, 0.5, 0.5)
    assert evaluate.corrected_t(same.withColumn("d", F.lit(0.0)), "d", 0.2).first()["p"] == 1.0


def test_clipped_rings(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0))])
    cut_ = lambda at, away: one(spark, geo.clipped(ring, tuple(map(F.lit, at)), tuple(map(F.lit, away))))
    assert [tuple(p) for p in cut_((1.0, 0.0), (1.0, 0.0))] == [(0, 0), (1, 0), (1, 2), (0, 2)]
    assert cut_((9.0, 0.0), (-1.0, 0.0)) == [] and len(cut_((9.0, 0.0), (1.0, 0.0))) == 4
    assert tuple(one(spark, geo.ring_centroid(ring))) == (2, 1) and one(spark, geo.shoelace(geo.clipped(ring, (F.lit(3.0), F.lit(0.0)), (F.lit(1.0), F.lit(1.0))))) == 4
    flat = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(1.0).alias("y")) for x in (1.0, 2.0)])
    assert tuple(one(spark, geo.ring_centroid(flat))) == (1, 1)


def test_kernel_map_and_machine(spark, tmp_path):
    import numpy as np
    from pyspark.ml import PipelineModel
    from pyspark.ml.linalg import Vectors

    from fieldlark.operators.kernels import RandomFourier

    rng = np.random.RandomState(5)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["id", "v"])
    z = np.array([r.z.toArray() for r in RandomFourier(inputCol="v", outputCol="z", size=2048, gamma=0.3, seed=1).transform(df).orderBy("id").collect()])
    true = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - true).max() < 6 * (2 / 2048) ** 0.5
    # A ring around a disc: no line parts them.
    p = rng.normal(size=(400, 2))
    r = np.hypot(*p.T)
    rows = [(i, float(a), float(b), float(q > 1.2)) for i, ((a, b), q) in enumerate(zip(p, r, strict=True))]
    points = spark.createDataFrame(rows, "id long, a double, b double, y double")
    folds = learn.repeated_folds(points, "id", "y", 1, 3).select("id", "fold")
    got = learn.calibrated(points, learn.pipeline(["a", "b"], [], "y", "svm"), folds, "id", "y", 3).collect()
    assert len(got) == 400 and np.mean([g.prediction == g.y for g in got]) > 0.93 > max(np.mean([g.y for g in got]), 0.6) and np.mean([(g.probability_1 - g.y) ** 2 for g in got]) < 0.08
    model = learn.pipeline(["a", "b"], [], "y", "svm").fit(points)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert [s.prediction for s in again.transform(points).orderBy("id").collect()] == [s.prediction for s in model.transform(points).orderBy("id").collect()]


def test_nested_search_sees_no_outer_group(spark, monkeypatch):
    rows = [(i, i % 12, float(i % 12), float((i // 3) % 2)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, g int, a double, y double")
    seen, real = [], learn.random_search
    monkeypatch.setattr(learn, "random_search", lambda train, *a, **k: seen.append({r.g: r.fold for r in train.select("g", "fold").distinct().collect()}) or real(train, *a, **k))
    out = learn.nested_search(df, learn.pipeline(["a"], [], "y"), {"regParam": [0.01, 0.1, 1.0]}, "id", "g", "y", outer=3, inner=2, tries=2).collect()
    judged_ = {}
    for r in out:
        judged_.setdefault(r.fold, set()).add(rows[r.id][1])
    assert sorted(r.id for r in out) == list(range(240)) and len(seen) == 3
    assert sorted(sorted(set(range(12)) - set(s)) for s in seen) == sorted(sorted(g) for g in judged_.values()) and all(set(s.values()) == {0, 1} for s in seen)
    clf = learn.pipeline(["a"], [], "y").getStages()[-1]
    assert len(learn.drawn_settings(clf, {"regParam": [1, 2], "maxIter": [3, 4]}, 9)) == 4


def test_only_touched_buckets_are_written(spark, tmp_path):
    import json
    import pathlib

    from fieldlark.sources import writers

    path = str(tmp_path / "t")
    rows = lambda ids, v: spark.createDataFrame([(i, v, f"r{v}") for i in ids], "id long, v long, what string")
    assert writers.upsert_table(rows(range(1000), 1), path, ["id"], "v", buckets=16) == 1
    size = lambda: sum(f.stat().st_size for f in pathlib.Path(path, "data").rglob("*.parquet"))
    whole = size()
    assert writers.upsert_table(rows([5], 2), path, ["id"], "v") == 2 and size() - whole < 0.2 * whole
    assert writers.upsert_table(rows([5, 2000], 1), path, ["id"], "v") == 3
    now = {r.id: r.what for r in writers.current_table(spark, path).collect()}
    assert len(now) == 1001 and now[5] == "r2" and now[2000] == "r1" and now[6] == "r1"
    assert {r.what for r in writers.current_table(spark, path, 1).collect()} == {"r1"} and writers.current_table(spark, path, 1).count() == 1000
    held = json.loads(pathlib.Path(path, "manifests", "000000000003.json").read_text())
    with pytest.raises(Exception, match="(?i)exists"):  # another writer has taken the number
        writers._publish(spark, path, held)
    assert writers.upsert_table(rows([], 1), path, ["id"], "v") == 3
    with pytest.raises(FileNotFoundError):
        writers.current_table(spark, path, 9)


def test_morans_i_of_a_slope_is_significant(spark):
    from fieldlark.operators import permutation

    step = 5 / (111_194.93 * math.cos(math.radians(7.3388)))
    df = spark.createDataFrame([(i, 7.3388 + (i // 30) * 5 / 111_194.93, 80.6957 + (i % 30) * step, float(i % 30), float(i * 7919 % 13), None if i == 3 else 1.0) for i in range(300)], "id long, lat double, lon double, slope double, mixed double, flat double")
    edges = spatial.edges_within(df, 6.0)
    r = permutation.morans_i_test(df, edges, "slope").first()
    assert r["morans_i"] == pytest.approx(spatial.morans_i(df, edges, "slope").first()["morans_i"], abs=1e-9) and r["morans_i"] > 0.9 and r["p"] == 0.001
    assert permutation.morans_i_test(df, edges, "mixed", 199).first()["p"] > 0.02
    assert permutation.morans_i_test(df, edges, "flat", 19).first()["morans_i"] is None


def test_disagreement_of_three_routes(spark):
    rows = [("a", r, i, float(i), float(r == 2) * 3 + float(r == 1)) for r in range(3) for i in range(5)] + [("b", 0, 0, 0.0, 0.0)]
    got = graph.routes_disagreement(spark.createDataFrame(rows, "k string, r int, step int, x double, y double"), "k", "r").collect()
    assert [(g.k, g.disagreement) for g in got] == [("a", 3.0)]
