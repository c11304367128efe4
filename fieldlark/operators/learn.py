"""Classifiers, folds, weights and resampling with Spark ML."""

from __future__ import annotations

import itertools
import json
import math
import random
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.operators.kernels import RandomFourier
from fieldlark.operators.lineage import cut, shared_dir
from fieldlark.operators.numbering import dealt

#: Rows of a task of a fit: of the kernel machine's, whose features are many, and of others.
_WIDE_ROWS, _ROWS = 20_000, 100_000


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``weight`` = n / (classes * rows of the class) (M4)."""
    own = df.groupBy(label).agg(F.count("*").alias("_c"))
    total = own.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    w = own.crossJoin(total).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return df.join(w, label)


def group_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """``fold`` by group, groups of each majority class dealt in turn, so that no group is in two folds (M5, M6)."""
    own = df.groupBy(group).agg(F.mode(label, True).alias("_class"))
    w = Window.partitionBy("_class").orderBy(F.xxhash64(group, F.lit(seed)), group)
    return df.join(own.select(group, F.pmod(F.row_number().over(w) - 1, F.lit(folds)).alias("fold")), group)


def leaking_groups(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups that are in more than one fold (M6)."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("n_folds")).where("n_folds > 1")


def repeated_folds(df: DataFrame, key: str, label: str, repeats: int = 5, folds: int = 10) -> DataFrame:
    """(key, repeat, fold), stratified by the label."""
    each = df.select(key, label, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    each = dealt(each, ["repeat", label], F.xxhash64(key, "repeat"), key)
    return each.select(key, "repeat", F.pmod(F.col("_n") - 1, F.lit(folds)).cast("int").alias("fold"))


def undersampled(df: DataFrame, label: str, key: str) -> DataFrame:
    """As many rows of each class as the smallest has."""
    least = df.groupBy(label).agg(F.count("*").alias("_c")).agg(F.min("_c").alias("_least"))
    return dealt(df, [label], F.xxhash64(key), key).crossJoin(F.broadcast(least)).where("_n <= _least").drop("_n", "_size", "_least")


def stratified_fraction(df: DataFrame, label: str, key: str, fraction: float) -> DataFrame:
    """The first share of each class in a fixed random order."""
    return dealt(df, [label], F.xxhash64(key), key).where(F.col("_n") <= F.ceil(F.col("_size") * fraction)).drop("_n", "_size")


def pipeline(numeric: Sequence[str], categorical: Sequence[str], label: str, model: str = "lr", weight: str | None = None, seed: int = 0, rounds: int = 400) -> Pipeline:
    """Scaled numbers, one-hot categories (unknown ones kept apart) and a classifier.

    ``boost`` has ``rounds`` boosted trees of a class against the others, for any number of classes. ``svm`` is a support
    vector machine on the features of an RBF kernel; it gives no probabilities, see :func:`calibrated`.
    """
    stages = [VectorAssembler(inputCols=list(numeric), outputCol="_num", handleInvalid="error"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True)]
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"_i_{c}" for c in categorical], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical]))
    stages.append(VectorAssembler(inputCols=["_scaled", *[f"_o_{c}" for c in categorical]], outputCol="features"))
    kinds = {
        "lr": lambda: LogisticRegression(labelCol=label, maxIter=50, regParam=0.01),
        "tree": lambda: DecisionTreeClassifier(labelCol=label, maxDepth=6, minInstancesPerNode=5, seed=seed),
        "forest": lambda: RandomForestClassifier(labelCol=label, numTrees=400, minInstancesPerNode=2, seed=seed),
        "svm": lambda: OneVsRest(labelCol=label, featuresCol="mapped", classifier=LinearSVC(maxIter=60, regParam=0.001, featuresCol="mapped")),
        "boost": lambda: OneVsRest(labelCol=label, classifier=GBTClassifier(maxIter=rounds, stepSize=0.05, maxDepth=4, subsamplingRate=0.8, seed=seed)),
    }
    if model == "svm":
        stages.append(RandomFourier(inputCol="features", outputCol="mapped", seed=seed))
    clf = kinds[model]()
    return Pipeline(stages=[*stages, clf.setWeightCol(weight) if weight else clf])


def _each(tasks: Sequence, run, parallel: int = 6) -> list:
    """Several fits at a time: each is a few small Spark jobs, so one after the other would leave executors idle."""
    with ThreadPoolExecutor(parallel) as pool:
        return [f.result() for f in [pool.submit(run, t) for t in tasks]]


def _spread(df: DataFrame, key: str, rows: int) -> tuple[DataFrame, int]:
    """The frame, cut, in tasks of about ``rows`` rows, and its number of rows.

    Rows that learners read are short, so tasks of a number of bytes hold very many of them, and a fit of millions of rows
    would run in one or two.
    """
    df = cut(df)
    n = df.count()
    tasks = max(1, math.ceil(n / rows))
    return (df if tasks == 1 else cut(df.repartition(tasks, key).sortWithinPartitions(key))), n


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def out_of_fold(df: DataFrame, build: Pipeline, folds: int, keep: Sequence[str]) -> DataFrame:
    """Predictions of each fold by a model of the others."""

    def one(k: int) -> DataFrame:
        model = build.fit(df.where(F.col("fold") != k))
        return scored(model, df.where(F.col("fold") == k)).select(*keep, "fold", "probability_1", "prediction")

    return _union(_each(range(folds), one))


def repeated_out_of_fold(df: DataFrame, build: Pipeline, assignment: DataFrame, key: str, repeats: int, folds: int, keep: Sequence[str]) -> DataFrame:
    """(key, repeat, fold, *keep, probability_1, prediction): each row once a repeat, by a model that was fitted without its fold.

    ``assignment`` is (key, repeat, fold), as :func:`repeated_folds` gives it.
    """
    # A fit reads its rows several times, so they are written once, in a folder a repeat and files of a bounded number of rows.
    all_ = df.join(assignment, key)
    files = max(1, math.ceil(df.count() / _ROWS))
    folder = f"{shared_dir(df.sparkSession)}/folds-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64(key), F.lit(files))
    all_.repartition(files * repeats, "repeat", part).sortWithinPartitions("repeat", part, key).write.option("maxRecordsPerFile", 2 * _ROWS).partitionBy("repeat").parquet(folder)
    of = [df.sparkSession.read.schema(all_.drop("repeat").schema).parquet(f"{folder}/repeat={r}").withColumn("repeat", F.lit(r)) for r in range(repeats)]

    def one(at: tuple[int, int]) -> DataFrame:
        own = of[at[0]]
        model = build.fit(own.where(F.col("fold") != at[1]))
        return scored(model, own.where(F.col("fold") == at[1])).select(key, "repeat", "fold", *keep, "probability_1", "prediction")

    return _union(_each([(r, k) for r in range(repeats) for k in range(folds)], one))


def changed_predictions(features: DataFrame, changed: Mapping[str, DataFrame], build: Pipeline, assignment: DataFrame, key: str, repeats: int, folds: int) -> DataFrame:
    """(key, variant, p): mean prediction for each row as it is ("original") and as it is in ``changed``.

    ``assignment`` is (key, repeat, fold), as :func:`repeated_folds` gives it. A row and its variants are scored only
    by models that were fitted without the row, one of each repeat.
    """
    variants = {name: cut(df) for name, df in {"original": features, **changed}.items()}
    assignment = cut(assignment)

    def one(at: tuple[int, int]) -> DataFrame:
        test = assignment.where((F.col("repeat") == at[0]) & (F.col("fold") == at[1])).select(key)
        model = build.fit(variants["original"].join(test, key, "left_anti"))
        return _union([scored(model, df.join(test, key, "left_semi")).select(key, F.lit(name).alias("variant"), "probability_1") for name, df in variants.items()])

    out = _union(_each([(r, k) for r in range(repeats) for k in range(folds)], one))
    return out.groupBy(key, "variant").agg(F.avg("probability_1").alias("p"))


def _of_two(build: Pipeline, label: str) -> Pipeline:
    """The same pipeline for two classes: a linear machine of each against the other is one machine and its mirror image."""
    *front, last = build.getStages()
    if not isinstance(last, OneVsRest) or not isinstance(last.getClassifier(), LinearSVC):
        return build
    machine = last.getClassifier().copy().setLabelCol(label)
    return Pipeline(stages=[*front, machine.setWeightCol(last.getWeightCol()) if last.isDefined("weightCol") else machine])


def calibrated(df: DataFrame, build: Pipeline, assignment: DataFrame, key: str, label: str, folds: int, keep: Sequence[str] = ()) -> DataFrame:
    """(key, fold, label, *keep, margin, probability_1, prediction) of a machine that gives margins only (M3).

    Margins of each fold come from a model of the others; a logistic curve through the margins of the other folds makes
    them probabilities (Platt 1999), so no row has a part in its own score. Binary labels 0 and 1.
    """
    all_, n = _spread(df.join(assignment, key), key, _WIDE_ROWS)
    build = _of_two(build, label)
    # A class against the rest has one margin for each class; that of class 1 against that of class 0.
    margin = vector_to_array("rawPrediction")
    margin = F.get(margin, F.lit(1)) - F.get(margin, F.lit(0))

    def one(k: int) -> DataFrame:
        model = build.fit(all_.where(F.col("fold") != k))
        return model.transform(all_.where(F.col("fold") == k)).select(key, "fold", label, *keep, margin.alias("margin"))

    # A fit keeps its wide rows in memory: the more rows, the fewer fits at a time, as each then has tasks for all cores.
    margins = cut(_union(_each(range(folds), one, max(1, min(6, 2_000_000 // max(1, n))))))
    curve = Pipeline(stages=[VectorAssembler(inputCols=["margin"], outputCol="_m"), LogisticRegression(featuresCol="_m", labelCol=label, maxIter=50)])

    def fitted(k: int) -> DataFrame:
        return scored(curve.fit(margins.where(F.col("fold") != k)), margins.where(F.col("fold") == k)).select(key, "fold", label, *keep, "margin", "probability_1", "prediction")

    return _union(_each(range(folds), fitted))


def final_model(df: DataFrame, build: Pipeline, features: Sequence[str], folder: str, facts: Mapping[str, object]) -> None:
    """Fits on all rows and writes the model, and a card that says what it is, beside it.

    The card holds the number of rows, the features and ``facts``, such as the threshold and the measured scores.
    """
    build.fit(df).write().overwrite().save(f"{folder}/model")
    card = {"n_training_rows": df.count(), "feature_list": list(features), **facts}
    df.sparkSession.createDataFrame([(json.dumps(card),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/card")


def read_model(spark, folder: str) -> tuple[PipelineModel, dict]:
    """The model and the card that :func:`final_model` wrote."""
    return PipelineModel.load(f"{folder}/model"), json.loads(spark.read.text(f"{folder}/card", wholetext=True).first()["value"])


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with the prediction and the probability of class 1."""
    return model.transform(df).withColumn("probability_1", vector_to_array("probability")[1])


def permuted(df: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """The same rows with one column's values dealt anew.

    Values move inside buckets of rows of a bounded size, in which two orders are matched.
    """
    n = max(1, df.count() // 50_000)
    df = df.withColumn("_b", F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(n)))
    own = df.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    dealt = df.select("_b", F.col(column).alias("_v"), F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(key, F.lit(seed)), key)).alias("_k"))
    return own.join(dealt, ["_b", "_k"]).withColumn(column, F.col("_v")).drop("_b", "_k", "_v")


def coefficients(model: PipelineModel) -> list[tuple[str, float]]:
    """Signed coefficients by feature name (E24): as many as the model has."""
    lr = model.stages[-1]
    sizes = [s for s in model.stages if isinstance(s, VectorAssembler)]
    names = list(sizes[0].getInputCols())
    for s in model.stages:
        if hasattr(s, "labelsArray"):
            for c, labels in zip(s.getInputCols(), s.labelsArray, strict=True):
                names += [f"{c}={v}" for v in labels]
    return sorted(zip(names, lr.coefficients.toArray().tolist(), strict=False), key=lambda p: -abs(p[1]))


def left_out(df: DataFrame, group: str) -> DataFrame:
    """``fold`` numbers of groups, one for each, for leave-one-group-out."""
    own = df.groupBy(group).agg(F.lit(1).alias("_"))
    return df.join(own.select(group, (F.row_number().over(Window.orderBy(group)) - 1).alias("fold")), group)


def neighbours_vote(neighbours: DataFrame, labels: DataFrame, k: int = 15) -> DataFrame:
    """(query_id, prediction, share): the class with the most weight among the k nearest, each by 1 / distance (M3).

    ``neighbours`` is (query_id, item_id, distance, rank), such as :func:`retrieval.top_k` gives, ``labels`` (item_id,
    label). Neighbours at no distance outvote all others; ties go to the lesser class.
    """
    near = neighbours.where(F.col("rank") <= k).join(labels, "item_id")
    w = Window.partitionBy("query_id")
    equal = F.max((F.col("distance") <= 0).cast("int")).over(w)
    near = near.withColumn("_w", F.when(equal == 1, (F.col("distance") <= 0).cast("double")).otherwise(1 / F.col("distance")))
    votes = near.groupBy("query_id", "label").agg(F.sum("_w").alias("_v"))
    best = F.min_by(F.struct("label", "_v"), F.struct(-F.col("_v"), F.col("label")))
    return votes.groupBy("query_id").agg(best.alias("_b"), F.sum("_v").alias("_t")).select("query_id", F.col("_b.label").alias("prediction"), (F.col("_b._v") / F.col("_t")).alias("share"))


def majority(train: DataFrame, label: str) -> DataFrame:
    """(prediction, share): the most frequent class, the least at a tie; the model without features (M3)."""
    n = train.groupBy(label).agg(F.count("*").alias("_c"))
    return n.agg(F.min_by(label, F.struct(-F.col("_c"), F.col(label))).alias("prediction"), (F.max("_c") / F.sum("_c")).alias("share"))


def time_forward(df: DataFrame, week: str, cut: int) -> tuple[DataFrame, DataFrame]:
    """Weeks up to the cut, and those after it (M5)."""
    return df.where(F.col(week) <= cut), df.where(F.col(week) > cut)


def drawn_settings(clf, grid: Mapping[str, Sequence], tries: int, seed: int = 0) -> list[dict]:
    """As many different combinations of a grid as are asked for, or all there are, in an order drawn at random (M7)."""
    every = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    random.Random(seed).shuffle(every)
    return [{clf.getParam(n): v for n, v in one.items()} for one in every[:tries]]


def random_search(df: DataFrame, build: Pipeline, grid: Mapping[str, Sequence], tries: int, folds: int, seed: int = 0, parallel: int = 4) -> CrossValidatorModel:
    """The best of randomly drawn settings of the last stage by macro F1 over the folds in ``fold``, fitted on all rows (M7)."""
    clf = build.getStages()[-1]
    judge = MulticlassClassificationEvaluator(labelCol=clf.getLabelCol(), predictionCol="prediction", metricName="f1")
    cv = CrossValidator(estimator=build, estimatorParamMaps=drawn_settings(clf, grid, tries, seed), evaluator=judge, numFolds=folds, foldCol="fold", parallelism=parallel)
    return cv.fit(df)


def nested_search(df: DataFrame, build: Pipeline, grid: Mapping[str, Sequence], key: str, group: str, label: str, outer: int = 5, inner: int = 3, tries: int = 8, seed: int = 0) -> DataFrame:
    """(key, fold, label, prediction, settings): folds inside folds, all by group (M7).

    Settings are searched on the other outer folds only, in inner folds dealt anew among their groups, and the winner,
    fitted on all of these, predicts the outer fold. So neither the search nor the fit sees a group that is judged.
    """
    dealt_ = cut(group_folds(df, group, label, outer, seed).withColumnRenamed("fold", "outer"))

    def one(k: int) -> DataFrame:
        train = group_folds(dealt_.where(F.col("outer") != k), group, label, inner, seed + 1 + k)
        found = random_search(train, build, grid, tries, inner, seed + k, parallel=2)
        best = found.getEstimatorParamMaps()[max(range(len(found.avgMetrics)), key=lambda i: found.avgMetrics[i])]
        settings = ", ".join(f"{p.name}={v}" for p, v in best.items())
        return found.bestModel.transform(dealt_.where(F.col("outer") == k)).select(key, F.col("outer").alias("fold"), label, "prediction", F.lit(settings).alias("settings"))

    return _union(_each(range(outer), one, 3))


def permutation_importance(model: PipelineModel, df: DataFrame, columns: Sequence[str], key: str, label: str, seed: int = 0) -> list[tuple[str, float]]:
    """Loss of accuracy when a column's values are dealt anew."""
    accuracy = lambda d: scored(model, d).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
    base = accuracy(df)
    return sorted(((c, base - accuracy(permuted(df, c, key, seed))) for c in columns), key=lambda p: -p[1])


def learning_curve(df: DataFrame, test: DataFrame, build: Pipeline, label: str, key: str, fractions: Sequence[float]) -> list[tuple[float, float]]:
    """Accuracy on a test set by share of the training rows."""
    out = []
    for f in fractions:
        model = build.fit(stratified_fraction(df, label, key, f))
        out.append((f, scored(model, test).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]))
    return out
