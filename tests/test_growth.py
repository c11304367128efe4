"""Steps whose work must follow the number of rows."""

import math

import pytest
from pyspark.sql import functions as F

from fieldlark.operators import gaps
from fieldlark.plans import queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_curves_are_measured_without_their_points(spark, sf_dir):
    for name in ("stem_gaps_filled", "stem_lengths"):
        assert "_curve#" not in plan(queries()[name](spark, sf_dir))
    at = lambda x, y: (float(x), float(y))
    rows = [(1, at(0, 0), at(100, 50), at(1, 0), at(0, 1)), (2, at(0, 0), at(3, 0), None, None), (3, at(1, 1), at(1, 1), None, None), (4, at(0, 0), at(500, 0), None, None), (5, at(0, 0), at(60, 0), at(0.6, 0.8), at(0.6, -0.8))]
    p = "struct<x: double, y: double>"
    found = gaps.filled_gaps(spark.createDataFrame(rows, f"k int, p0 {p}, p1 {p}, t0 {p}, t1 {p}"))
    got = {r.k: r for r in found.withColumn("again", gaps.length_of(F.col("points"))).collect()}
    assert {k: r.method for k, r in got.items()} == {1: "hermite", 2: "hermite", 3: "straight", 4: "too_long", 5: "hermite"}
    assert all(got[k].length == pytest.approx(got[k].again, abs=1e-9) for k in (1, 2, 3, 5)) and got[4].length is None
    assert got[1].length > math.hypot(100, 50)


def test_rings_are_computed_once(spark, sf_dir):
    # The plan had a copy of the ring's expression for each mention: 126,295 characters.
    assert len(plan(queries()["clipped_rings"](spark, sf_dir))) < 30_000


def test_company_is_found_without_all_pairs(spark):
    import random

    from fieldlark.operators import density

    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, None]), 7.0 + rng.random() * 4e-4, 80.0 + rng.random() * 4e-4) for i in range(150)]
    rows += [(150, 0, 7.1, 80.0), (150, 0, 7.1, 80.0), (151, 1, 7.1, 80.0), (152, 0, None, 80.0), (153, 0, 7.2, 80.0), (154, 0, 7.2, 80.0)]
    hav = lambda a, b: 2 * 6_371_000 * math.asin(math.sqrt(math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2))
    pts = [r for r in rows if None not in r]
    df = spark.createDataFrame(rows, "id long, zone int, lat double, lon double")
    for metres in (1.5, 4.0, 75.0):
        want = {a[0] for a in pts for b in pts if a[0] != b[0] and a[1] == b[1] and hav(a, b) <= metres}
        assert sorted(r.id for r in density.accompanied(df, metres, ["zone"]).collect()) == sorted(want)
    # A crowd at one place: its 3,600,000,000 pairs would not be done in time.
    many = spark.range(60_000).select("id", F.lit(0).alias("zone"), F.lit(7.0).alias("lat"), F.lit(80.0).alias("lon"))
    assert density.accompanied(many, 75.0, ["zone"]).count() == 60_000


def test_pairs_by_tiles_are_those_of_the_edges(spark, monkeypatch):
    import random

    from fieldlark.operators import permutation, spatial, tiles

    rng = random.Random(8)
    at = lambda i: (i, "ab"[i % 2], 7.3388 + rng.gauss(0, 8e-5), 80.6957 + rng.gauss(0, 8e-5), i % 3 == 0, rng.random() if i % 11 else None)
    df = spark.createDataFrame([at(i) for i in range(300)] + [(300, "a", 7.3388, 80.6957, True, 0.5), (301, "a", 7.3388, 80.6957, True, 0.25)], "id long, zone string, lat double, lon double, flag boolean, value double").repartition(3)
    monkeypatch.setattr(tiles, "_BLOCK", 16)
    monkeypatch.setattr(tiles, "_HELD", 7)
    for metres in (4.0,):
        edges = spatial.edges_within(df, metres)
        for test, how in ((permutation.join_count_test, ("flag", ["zone"], 99)), (permutation.morans_i_test, ("value", 99)), (permutation.clustered_share_test, ("flag", ["zone"], 3, 99))):
            tiled = test(df, metres, *how)
            assert tuple(tiled.first()) == pytest.approx(tuple(test(df, edges, *how).first()), abs=1e-11)
    # No join makes a row for each pair.
    text = plan(permutation.join_count_test(df, 2.0, "flag", ["zone"], 99))
    assert "cy#" not in text and "cx#" not in text


def test_nearest_by_growing_radii(spark):
    import random

    from fieldlark.operators import spatial

    rng = random.Random(2)
    rows = [(i, 7.0 + rng.gauss(0, 2e-4), 80.0 + rng.gauss(0, 2e-4)) for i in range(250)] + [(250, 7.0, 80.05), (251, None, 80.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    every = spatial.pairs_within(df.where("id % 5 = 0"), df, 30.0).collect()
    want = sorted((r.a, i + 1, r.b) for a in {r.a for r in every} for i, r in enumerate(sorted((r for r in every if r.a == a), key=lambda r: (r.distance, r.b))[:4]))
    assert sorted((r.a, r["rank"], r.b) for r in spatial.nearest(df.where("id % 5 = 0"), df, 4, 30.0).collect()) == want
    # A crowd at one place: 2,000 queries against 100,000 points would be 200,000,000 pairs in one cell.
    many = spark.range(100_000).select("id", F.lit(7.0).alias("lat"), F.lit(80.0).alias("lon"))
    got = spatial.nearest(many.where("id % 50 = 0"), many, 3, 25.0).groupBy("rank").agg(F.count("*").alias("n"), F.sum("b").alias("s")).collect()
    assert {r["rank"]: (r.n, r.s) for r in got} == {1: (2000, 0), 2: (2000, 2000), 3: (2000, 4000)}


def test_a_model_does_not_differ_from_itself(spark):
    import random

    from fieldlark.operators import evaluate

    drawn = F.udf(lambda _: random.SystemRandom().random(), "double").asNondeterministic()
    folds = spark.range(20).select(F.lit("m").alias("model"), F.lit("all").alias("classifier"), F.lit("brier").alias("metric"), F.col("id").alias("fold"), drawn("id").alias("value"))
    pairs = spark.createDataFrame([("m_vs_m", "all", "m", "m", "all")], "comparison string, classifier string, model_a string, model_b string, classifier_b string")
    r = evaluate.comparisons(folds, pairs, ["fold"], 0.2).first()
    assert (r["mean"], r["df"], r["p"], r["ci_low"]) == (0.0, 19, 1.0, 0.0)


def test_routes_meet_without_joins(spark):
    from fieldlark.operators import graph

    rows = [("k", 1, 1, 0.0, 0.0), ("k", 1, 2, 4.0, 0.0), ("k", 1, 2, 5.0, 0.0), ("k", 2, 1, 0.0, 3.0), ("k", 2, 9, None, 1.0), ("one", 1, 1, 0.0, 0.0), (None, 1, 1, 0.0, 0.0), (None, 2, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, r int, step int, x double, y double")
    both = graph.routes_disagreement(df, "k", "r"), graph.route_disagreement(df.where("r = 1"), df.where("r = 2"), "k")
    for found in both:
        assert [tuple(r) for r in found.collect()] == [("k", pytest.approx(((3 + 5) / 2 + 3) / 2))]
        assert "Join" not in plan(found)


def test_vectors_without_a_kernel_are_no_error(spark, tmp_path):
    rows = [(0, [0.1, 0.2, 0.3, 0.4]), (50, None), (100, [float("nan"), 0.0, 0.0, 0.0]), (3, [0.2, 0.1, None, 0.0]), (4, [0.3, 0.1, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries()["kernel_approximation"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(0, 5, True), (50, 5, True), (100, 5, True)]


def test_forest_scores_rows_in_many_tasks(spark):
    from fieldlark.operators import temporal

    df = spark.range(40).select("id", (F.col("id") % 7).cast("double").alias("v")).coalesce(1)
    found = temporal.isolation_scores(df, ["v"], trees=5)
    assert found.rdd.getNumPartitions() == 4 and found.count() == 40


def test_kernel_machine_is_fitted_once_a_fold_in_tasks_of_bounded_rows(spark, monkeypatch):
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import vector_to_array

    from fieldlark.operators import kernels, learn

    monkeypatch.setattr(learn, "_WIDE_ROWS", 200, raising=False)
    df = spark.range(600, numPartitions=1).select("id", F.sin("id").alias("x"), (F.col("id") % 7).cast("double").alias("z"), (F.sin("id") * F.cos(F.col("id") % 7) > 0.1).cast("double").alias("y"), (F.col("id") % 3).cast("int").alias("fold"))
    build = learn.pipeline(["x", "z"], [], "y", "svm")
    both = build.fit(df.where("fold != 0")).transform(df.where("fold = 0")).select("id", vector_to_array("rawPrediction").alias("m")).collect()
    fits, fit = [], LinearSVC._fit
    monkeypatch.setattr(LinearSVC, "_fit", lambda self, data: fits.append(data.rdd.getNumPartitions()) or fit(self, data))
    out = {r.id: r for r in learn.calibrated(df.drop("fold"), build, df.select("id", "fold"), "id", "y", 3).collect()}
    assert fits == [3, 3, 3]  # before, six fits in one task each
    assert len(out) == 600 and all(out[r.id].margin == pytest.approx(r.m[1] - r.m[0], abs=1e-6) for r in both)

    rows = spark.createDataFrame([([0.5, -1.0],), (None,), ([2.0, 3.5],)], "x array<double>").repartition(1)
    got = rows.select(kernels.mapped(F.col("x"), 2, 16, 0.3, 5).alias("a"), kernels.fourier(F.col("x"), 2, 16, 0.3, 5).alias("b"), "x").collect()
    assert all(r.a is None if r.x is None else r.a == pytest.approx(r.b, abs=1e-12) for r in got)


def test_fits_of_a_repeat_read_its_rows_alone(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    from fieldlark.operators import learn

    monkeypatch.setattr(learn, "_ROWS", 50)
    df = spark.range(300, numPartitions=1).select("id", F.sin("id").alias("x"), (F.sin("id") + F.cos(F.col("id") * 3) > 0.1).cast("double").alias("y"))
    folds = df.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("repeat")).withColumn("fold", F.pmod(F.xxhash64("id", "repeat"), F.lit(2)).cast("int"))
    build, read, fit = learn.pipeline(["x"], [], "y"), [], LogisticRegression._fit
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, data: read.append(data.inputFiles()) or fit(self, data))
    out = {(r.id, r["repeat"]): r for r in learn.repeated_out_of_fold(df, build, folds, "id", 2, 2, ["y"]).collect()}
    # Before, each fit read the rows of all repeats, in as few tasks as they had bytes for.
    assert len(read) == 4 and all(len(f) >= 2 and len({x.split("/repeat=")[1][0] for x in f}) == 1 for f in read)
    own = df.join(folds.where("repeat = 1"), "id")
    want = learn.scored(build.fit(own.where("fold != 0")), own.where("fold = 0")).collect()
    assert len(out) == 600 and all(out[r.id, 1].probability_1 == pytest.approx(r.probability_1, abs=1e-9) for r in want)


def test_joins_of_density_clusters_send_no_side_through_the_driver(spark, monkeypatch):
    import random

    from fieldlark.operators import components, density

    rng, plans, kept = random.Random(6), [], density.cut
    for m in (density, components):
        monkeypatch.setattr(m, "cut", lambda df: plans.append(plan(df)) or kept(df))
    df = spark.createDataFrame([(i, 7.0 + rng.gauss(0, 4e-5), 80.0 + rng.gauss(0, 4e-5)) for i in range(60)], "id long, lat double, lon double").coalesce(1)
    out = density.clusters(df, 3.0, 3)
    joins = [line for p in [*plans, plan(out)] for line in p.splitlines() if "Join " in line]
    assert len(joins) > 8 and all("strategy=merge" in j for j in joins)
    assert out.count() == 60


def test_joins_of_words_send_no_side_through_the_driver(spark, monkeypatch):
    from fieldlark.llm import spelling

    plans, cut, written = [], spelling.cut, spelling.written
    monkeypatch.setattr(spelling, "cut", lambda df: plans.append(plan(df)) or cut(df))
    monkeypatch.setattr(spelling, "written", lambda df: plans.append(plan(df)) or written(df))
    texts = ["variant " * 120 + "varient " * 10 + "varieent variant", "varient varieent vvarieent vvarieent"]
    out = spelling.variants(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spelling.Spelling(slip=0))
    joins = [line for p in [*plans, plan(out)] for line in p.splitlines() if "Join " in line]
    # Before, sides that Spark took for small were broadcast: 268 MB of words over 0.51 GB of documents.
    assert len(joins) >= 9 and all("strategy=merge" in j for j in joins)
    assert {(r.word, r.form, r.root) for r in out.collect()} == {("variant", None, "variant"), ("varient", "variant", "variant"), ("varieent", None, "varieent"), ("vvarieent", None, "vvarieent")}


def test_kernel_errors_come_from_blocks_and_not_from_pairs(spark, sf_dir, monkeypatch):
    import random

    import numpy as np

    from fieldlark.operators import kernels
    from fieldlark.plans import models

    for name, most in (("_QUERIES", 6), ("_ROWS", 7), ("_HELD", 3)):
        monkeypatch.setattr(kernels, name, most)
    rng = random.Random(3)
    rows = [(i % 60, [rng.gauss(0, 1) for _ in range(3)]) for i in range(64)] + [(None, [0.1, 0.2, 0.3])]
    rows += [(70, None), (80, [0.1, None, 0.2]), (90, [0.1, float("nan"), 0.2]), (100, [0.1, float("inf"), 0.2]), (110, [0.1, 0.2])]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    found = kernels.deviations(df.where("id % 10 = 0"), df, 3, 32, 0.25, 4)
    got = {r.id: r for r in found.collect()}
    w = kernels.directions(3, 32, 0.25, 4)
    z = lambda x: np.sqrt(2 / 32) * np.cos(w[:, :-1] @ x + w[:, -1])
    whole = [np.array(x) for _, x in rows if x and len(x) == 3 and None not in x and np.isfinite(x).all()]
    assert len(got) == 11 and len(whole) == 65
    for key in got:
        own = [np.array(x) for k, x in rows if k == key]
        assert got[key].n == len(own) * len(rows)
        off = [abs(np.exp(-0.25 * ((x - y) ** 2).sum()) - z(x) @ z(y)) for x in own if any(x is v or np.array_equal(x, v) for v in whole) for y in whole]
        assert got[key].c == len(off) and got[key].s == pytest.approx(sum(off), abs=1e-9) and got[key].most == (pytest.approx(max(off), abs=1e-9) if off else None)
    plans, cut = [], models.cut
    monkeypatch.setattr(models, "cut", lambda d: plans.append(plan(d)) or cut(d))
    assert queries()["kernel_approximation"](spark, sf_dir).where("not close").isEmpty()
    # Before, each pair was a row of a cross join with two maps of 1,024 features.
    assert plans and "Join" not in "".join(plans)


def test_nearest_of_others_where_ids_repeat_or_are_missing(spark, tmp_path):
    import random

    from fieldlark.operators import spatial
    from fieldlark.plans import oracle_sql
    from tests.oracle import difference

    rng = random.Random(5)
    at = lambda: [rng.gauss(0, 0.004), rng.gauss(0, 0.004), 0.5]
    one, two = at(), at()
    rows = [(i, at(), i % 4) for i in range(120)] + [(None, at(), 1) for _ in range(40)]
    rows += [(50, one, 0) for _ in range(9)] + [(i, one, 1) for i in range(300, 312)] + [(300, one, 1) for _ in range(7)]  # an id nine times at a place with others
    rows += [(100, two, 0), (100, at(), 0), (100, at(), 0), (7, [float("nan"), 0.0, 0.0], 1), (150, [float("nan"), 0.0, 0.0], 1), (200, [30.0, 0.0, 0.0], 2), (200, [30.0, 0.0, 0.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).coalesce(1).write.parquet(f"{tmp_path}/spark")
    (file,) = (tmp_path / "spark").glob("*.parquet")
    (tmp_path / "tables").mkdir()
    file.rename(tmp_path / "tables" / "embeddings.parquet")
    for name in ("nearest_plants_topk", "retrieval_log"):
        # Before, copies of a query's own id and points without one took places of others, and a position that is not a number was an error.
        assert difference(spark, str(tmp_path / "tables"), queries()[name], oracle_sql()[name]) == ""
    # At a crowded place each query still has its k, whichever id is its own.
    crowd = spark.createDataFrame([(i, 7.0, 80.0) for i in (1, 1, 1, 2, 3, 3, 4, 5)], "id long, lat double, lon double")
    got = {(r.a, r["rank"]): r.b for r in spatial.nearest(crowd.distinct(), crowd, 3, 25.0, others=True).collect()}
    assert [got[1, r] for r in (1, 2, 3)] == [2, 3, 3] and [got[2, r] for r in (1, 2, 3)] == [1, 1, 1] and [got[5, r] for r in (1, 2, 3)] == [1, 1, 1] and len(got) == 15
