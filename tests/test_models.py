import random

import numpy as np
import pytest

from brocal.operators import models as M


@pytest.fixture(scope="module")
def marked(spark):
    r = random.Random(2)
    rows = []
    for i in range(240):
        y = i % 2
        rows.append((i, r.gauss(2 * y, 0.5), r.gauss(-2 * y, 0.5), y))
    return spark.createDataFrame(rows, "id long, a double, b double, y int").cache()


def test_each_member_of_the_ensemble_is_what_it_is_said_to_be(spark, marked):
    from pyspark.ml.feature import VectorAssembler

    d = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(M.flip_labels(marked, "id", "y", 0.1)).withColumnRenamed("y", "label").selectExpr("id", "cast(label as double) label", "features").cache()
    rows = d.withColumn("fold", M._folds("id", 5, 0)).orderBy("id").collect()
    x, y, fold = np.array([r["features"].toArray() for r in rows]), np.array([r["label"] for r in rows]), np.array([r["fold"] for r in rows])
    near, lda = [], []
    for i in range(len(x)):
        t = fold != fold[i]
        near.append(int(y[t][((x[t] - x[i]) ** 2).sum(axis=1).argmin()] != y[i]))
        means = [x[t & (y == c)].mean(axis=0) for c in (0, 1)]
        s = sum((x[t & (y == c)] - means[c]).T @ (x[t & (y == c)] - means[c]) for c in (0, 1)) / (t.sum() - 2)
        score = [np.log((t & (y == c)).sum() / t.sum()) - (x[i] - means[c]) @ np.linalg.solve(s, x[i] - means[c]) / 2 for c in (0, 1)]
        lda.append(int(np.argmax(score) != y[i]))
    assert [r["wrong"] for r in M._neighbour_errors(d, "id", 5).orderBy("id").collect()] == near
    assert [r["wrong"] for r in M._discriminant_errors(d, "id", 5).orderBy("id").collect()] == lda


@pytest.mark.parametrize("how", ["EF", "CVCF"])
def test_turned_labels_are_found(marked, how):
    r = M.noise_check(marked, "id", ["a", "b"], "y", how, 0.1, 3)
    assert r["injected"] == 24 and r["recall"] > 0.7 and r["precision"] > 0.7


def test_repeated_filter_goes_on_until_nothing_is_found(marked, monkeypatch):
    rounds = []

    def one_at_a_time(d, key, folds, salt, classes):
        rounds.append(salt)
        left = sorted(r[0] for r in d.select(key).collect())
        return [d.selectExpr(key, f"int({key} = {left[0]} and {left[0]} < 6) wrong")]

    monkeypatch.setattr(M, "_tree_errors", one_at_a_time)
    assert sorted(r[0] for r in M.label_noise(marked, "id", ["a", "b"], "y", "IPF", 3).collect()) == list(range(6))
    assert rounds == [0, 1, 2] * 7


def test_registered_map_has_all_complete_rows(spark):
    import __spark_entry__
    from brocal.plans.prep import NUM

    data = "/root/testdata/sf0.001"
    complete = spark.read.parquet(f"{data}/robots.parquet").dropna(subset=NUM).count()
    assert 300 < complete < 2000
    assert __spark_entry__.queries()["ml_tsne"](spark, data).count() == complete


def test_wrappers_and_families_find_the_columns_that_tell(spark):
    from pyspark.sql import functions as F

    r = random.Random(6)
    rows = [(i, i % 2, 3 * (i % 2) + r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, good double, bad double, worse double")
    for how in ("forward", "backward", "rfe"):
        steps = M.wrapper(df, "id", ["bad", "good", "worse"], "y", 1, how, trees=5, depth=3).collect()
        moved = [s["columna"] for s in steps]
        assert (moved == ["good"] if how == "forward" else sorted(moved) == ["bad", "worse"]) and steps[-1]["auc"] > 0.9, how
    votes = {x["columna"]: (x["votos"], x["consenso"]) for x in M.family_consensus(df, "id", ["bad", "good", "worse"], "y", 1, trees=5, depth=3).collect()}
    assert votes == {"good": (3, True), "bad": (0, False), "worse": (0, False)}
    shown = M.scatter(df, "id", ["bad", "good", "worse"], 50)
    assert shown.count() == 50 and abs(shown.agg(F.avg("x")).first()[0]) < 1
    load = M.loadings(df, ["bad", "good", "worse"], 2).groupBy("componente").agg(F.round(F.sum(F.pow("carga", F.lit(2.0))), 6).alias("s")).collect()
    assert {x["componente"]: x["s"] for x in load} == {1: 1.0, 2: 1.0}


def test_planted_groups_and_what_is_built_on_clusters(spark):
    r = random.Random(9)
    rows = [(i, 10.0 * (i % 3) + r.gauss(0, 0.5), -10.0 * (i % 3) + r.gauss(0, 0.5), i % 3, None if i % 10 == 0 else 5.0 * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, k int, v double")
    pred, scores = M.clusters(df, ("a", "b"), (3, 4))
    assert max(scores, key=scores.get) == 3 and pred.groupBy("prediction", "k").count().count() == 3
    assert sorted(x["n"] for x in M.cluster_summary(pred, ("a", "b")).collect()) == [100, 100, 100]
    filled = {x["id"]: x["valor"] for x in M.impute_kmeans(df, "id", "v", ("a", "b"), 3).collect()}
    assert all(abs(filled[i] - 5.0 * (i % 3)) < 0.6 for i in range(0, 300, 10))
    assert {x["k"]: x["n"] for x in M.prototypes(df, ("a", "b"), "k", 3).collect()} == {0: 100, 1: 100, 2: 100}
    assert M.largest_clusters(df, ("a", "b"), 3, 2).count() == 200
    assert [round(x["acumulada"], 2) for x in M.principal(df, ("a", "b")).collect()][0] > 0.95


def test_supervised_models_learn_what_is_there(spark, tmp_path):
    r = random.Random(11)
    rows = [(f"u{i}", *[float(i % 2) * 3 + r.gauss(0, 1) if j == 0 else r.gauss(0, 1) for j in range(len(M.SPAM_FEATURES))], i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "_id string, " + ", ".join(f"{c} double" for c in M.SPAM_FEATURES) + ", label int")
    pred, values = M.spam_detector(df, 10, 4)
    assert values["auc"] > 0.9 and values["f1"] > 0.8
    points = [(x["fpr"], x["tpr"]) for x in M.roc(pred, 20).orderBy("umbral").collect()]
    assert points == sorted(points, reverse=True) and points[0] == (1.0, 1.0) and len(points) == 21
    folder = str(tmp_path)

    def fails():
        raise ValueError("no table")

    report = M.run_all({"spam": lambda: values, "empty": lambda: None, "broken": fails}, folder)
    assert {x["modelo"]: x["estado"] for x in report.collect()} == {"spam": "ok", "empty": "empty", "broken": "failed"} and M.read_metrics(folder, "spam") == values
    M.save_run(folder, "spam", predictions=pred, values=values)
    assert 0 < M.read_predictions(spark, folder, "spam", 1.0).count() < M.read_predictions(spark, folder, "spam").count() == pred.count()
    assert M.read_metrics(folder, "none") == {}
    imp = {x["columna"]: x["peso"] for x in M.importances(df, M.SPAM_FEATURES, "label").collect()}
    assert max(imp, key=imp.get) == M.SPAM_FEATURES[0]
