"""Supervised and unsupervised models over feature tables, with pyspark.ml; each gives its predictions or its metrics as rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brocal.operators.neighbours import nearest
from brocal.operators.ranking import balance, split
from brocal.session import cut
from brocal.sources import store

SEED = 42
SPAM_FEATURES = ("posts_count", "avg_text_length", "avg_hashtags_per_post", "unique_texts_ratio", "days_active", "posts_per_day", "likes_given", "likes_received", "followers_count", "following_count", "follow_ratio")


def vectors(df: DataFrame, columns: Sequence[str], scale: bool = True):
    """The fitted stages and the table with `features`; nulls count as 0."""
    filled = df.fillna(0, list(columns))
    stages = [VectorAssembler(inputCols=list(columns), outputCol="raw" if scale else "features")]
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    model = Pipeline(stages=stages).fit(filled)
    return model, model.transform(filled)


def metrics(spark, **values) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "metrica string, valor double")


def confusion(pred: DataFrame, label: str = "label") -> dict[str, float]:
    r = pred.agg(*[F.count_if((F.col(label) == a) & (F.col("prediction") == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)]).first()
    tp, fp, fn, tn = r["c11"], r["c01"], r["c10"], r["c00"]
    p, q = tp / max(1, tp + fp), tp / max(1, tp + fn)
    return {"precision": p, "recall": q, "f1": 2 * p * q / max(1e-12, p + q), "accuracy": (tp + tn) / max(1, tp + tn + fp + fn), "tp": tp, "fp": fp, "fn": fn, "tn": tn}


def roc(pred: DataFrame, points: int = 50, label: str = "label") -> DataFrame:
    """umbral, fpr, tpr at `points` levels of the score."""
    s = pred.select(vector_to_array("probability")[1].alias("s"), F.col(label).alias("y"))
    levels = s.sparkSession.range(points + 1).select((F.col("id") / points).alias("umbral"))
    cut = s.select(F.floor(F.col("s") * points).alias("b"), "y").groupBy("b").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    total = cut.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    above = Window.orderBy(F.desc("b"))
    by = levels.withColumn("b", F.round(F.col("umbral") * points).cast("bigint")).join(cut, "b", "left").fillna(0)
    return by.join(F.broadcast(total)).select("umbral", F.round(F.sum("n").over(above) / F.greatest("tn", F.lit(1)), 6).alias("fpr"), F.round(F.sum("p").over(above) / F.greatest("tp", F.lit(1)), 6).alias("tpr"))


def _sides(df: DataFrame, key: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    d = cut(split(df, key, share))
    return d.where("parte = 'train'"), d.where("parte = 'test'")


def spam_detector(features: DataFrame, trees: int = 100, depth: int = 8) -> tuple[DataFrame, dict]:
    """Predictions of the held-out users, and auc, precision, recall, f1, accuracy."""
    _, d = vectors(features, SPAM_FEATURES)
    train, test = _sides(d, "_id")
    pred = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED).fit(train).transform(test)
    return pred, {"auc": BinaryClassificationEvaluator().evaluate(pred), **confusion(pred)}


def engagement(posts: DataFrame) -> dict:
    """rmse, mae, r2 of the likes of a post from its length, tags, hour and weekday."""
    d = posts.select("_id", F.col("likes_count").cast("double").alias("label"), F.length("text").alias("largo"), F.size("hashtags").alias("tags"), F.hour("created_at").alias("hora"), F.dayofweek("created_at").alias("dia"))
    _, d = vectors(d, ("largo", "tags", "hora", "dia"), scale=False)
    train, test = _sides(d, "_id")
    pred = GBTRegressor(maxIter=50, maxDepth=6, seed=SEED).fit(train).transform(test)
    return {m: RegressionEvaluator(metricName=m).evaluate(pred) for m in ("rmse", "mae", "r2")}


def virality(posts: DataFrame) -> dict:
    """auc of a logistic model of the posts at or above the 90th percentile of likes."""
    limit = posts.approxQuantile("likes_count", [0.9], 0.01)
    d = posts.select("_id", (F.col("likes_count") >= F.lit(limit[0] if limit else 0)).cast("int").alias("label"), F.length("text").alias("largo"), F.size("hashtags").alias("tags"), F.hour("created_at").alias("hora"))
    _, d = vectors(d, ("largo", "tags", "hora"))
    train, test = _sides(d, "_id")
    pred = LogisticRegression(maxIter=100, regParam=0.01).fit(train).transform(test)
    return {"limite": limit[0] if limit else 0, "auc": BinaryClassificationEvaluator().evaluate(pred), **confusion(pred)}


def churn(stats: DataFrame, last: DataFrame, days: int = 30) -> dict:
    """auc of a boosted model of users who haven't posted for so many days; the days are among the features, on purpose."""
    newest = last.agg(F.max("ultimo").alias("hoy"))
    d = stats.join(last, "_id").join(F.broadcast(newest)).withColumn("dias", F.datediff("hoy", "ultimo")).withColumn("label", (F.col("dias") >= days).cast("int"))
    _, d = vectors(d, ("dias", "posts_count", "likes_given", "followers_count"), scale=False)
    train, test = _sides(d, "_id")
    pred = GBTClassifier(maxIter=50, maxDepth=6, seed=SEED).fit(train).transform(test)
    return {"auc": BinaryClassificationEvaluator().evaluate(pred), **confusion(pred)}


def clusters(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = (3, 4, 5, 6, 7)) -> tuple[DataFrame, dict]:
    """Rows with the cluster of the k of the best silhouette, and these by k."""
    _, d = vectors(df, columns)
    d = cut(d)
    fitted = {k: KMeans(k=k, seed=SEED).fit(d).transform(d) for k in ks}
    scores = {k: ClusteringEvaluator().evaluate(p) for k, p in fitted.items()}
    best = max(scores, key=scores.get)
    return fitted[best], scores


def cluster_summary(pred: DataFrame, columns: Sequence[str]) -> DataFrame:
    return pred.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 1).alias(c) for c in columns])


def impute_kmeans(df: DataFrame, key: str, column: str, features: Sequence[str], k: int = 5) -> DataFrame:
    """`key`, valor: nulls of a column replaced by the value of their cluster's centre (clusters over standardised features, medians for nulls)."""
    columns = list(dict.fromkeys([*features, column]))
    full = Imputer(inputCols=columns, outputCols=[f"{c}__i" for c in columns], strategy="median").fit(df.select(key, *[F.col(c).cast("double") for c in columns]))
    d = full.transform(df.select(key, *[F.col(c).cast("double") for c in columns]))
    _, d = vectors(d, [f"{c}__i" for c in columns])
    pred = KMeans(k=k, seed=SEED).fit(d).transform(d)
    centre = pred.groupBy("prediction").agg(F.avg(f"{column}__i").alias("c"))
    return pred.join(F.broadcast(centre), "prediction").select(key, F.coalesce(column, "c").alias("valor"))


def largest_clusters(df: DataFrame, columns: Sequence[str], k: int, keep: int) -> DataFrame:
    """All rows of the `keep` largest clusters."""
    pred, _ = clusters(df, columns, (k,))
    big = pred.groupBy("prediction").count().orderBy(F.desc("count"), "prediction").limit(keep).select("prediction")
    return pred.join(F.broadcast(big), "prediction", "left_semi").select(*df.columns)


def prototypes(df: DataFrame, columns: Sequence[str], label: str, k: int) -> DataFrame:
    """The k centres with the most frequent label of their rows (the least on a tie), and the number of these."""
    pred, _ = clusters(df, columns, (k,))
    modal = pred.groupBy("prediction", label).count().groupBy("prediction").agg(F.min_by(label, F.struct(-F.col("count"), label)).alias(label), F.sum("count").alias("n"))
    return pred.groupBy("prediction").agg(*[F.avg(c).alias(c) for c in columns]).join(modal, "prediction")


def loadings(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """componente, columna, carga of the first k components of standardised columns."""
    _, d = vectors(df.dropna(subset=list(columns)), columns)
    pc = PCA(k=k, inputCol="features", outputCol="pc").fit(d).pc.toArray()
    return df.sparkSession.createDataFrame([(j + 1, c, float(pc[i, j])) for j in range(k) for i, c in enumerate(columns)], "componente int, columna string, carga double")


def scatter(df: DataFrame, key: str, columns: Sequence[str], most: int = 500) -> DataFrame:
    """`key`, x, y: up to `most` rows (by hash) on the first two components."""
    from brocal.operators.ranking import sample_exact

    _, d = vectors(df.dropna(subset=list(columns)), columns)
    shown = PCA(k=2, inputCol="features", outputCol="pc").fit(d).transform(d).select(key, vector_to_array("pc").alias("p"))
    return sample_exact(shown, key, most).select(key, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def principal(df: DataFrame, columns: Sequence[str], enough: float = 0.95) -> DataFrame:
    """componente, varianza, acumulada of as many components as explain enough."""
    _, d = vectors(df.dropna(subset=list(columns)), columns)
    shares = PCA(k=len(columns), inputCol="features", outputCol="pc").fit(d).explainedVariance.toArray().tolist()
    rows, total = [], 0.0
    for i, s in enumerate(shares):
        total += s
        rows.append((i + 1, s, total))
        if total >= enough:
            break
    return df.sparkSession.createDataFrame(rows, "componente int, varianza double, acumulada double")


def importances(df: DataFrame, columns: Sequence[str], label: str, how: str = "forest") -> DataFrame:
    """columna, peso by a random forest, or by a logistic model that punishes absolute weights."""
    _, d = vectors(df.withColumn("label", F.col(label).cast("int")), columns)
    if how == "forest":
        weights = RandomForestClassifier(numTrees=50, maxDepth=8, seed=SEED).fit(d).featureImportances.toArray()
    else:
        weights = abs(LogisticRegression(elasticNetParam=1.0, regParam=0.01).fit(d).coefficients.toArray())
    return df.sparkSession.createDataFrame([(c, float(w)) for c, w in zip(columns, weights)], "columna string, peso double")


def _auc(d: DataFrame, columns: Sequence[str], folds: int, trees: int, depth: int) -> float:
    """Mean area under the curve of a forest over folds by hash."""
    v = VectorAssembler(inputCols=list(columns), outputCol="features").transform(d)
    scores = []
    for f in range(folds):
        m = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED).fit(v.where(F.col("fold") != f))
        scores.append(BinaryClassificationEvaluator().evaluate(m.transform(v.where(F.col("fold") == f))))
    return float(np.mean(scores))


def wrapper(df: DataFrame, key: str, columns: Sequence[str], label: str, keep: int = 3, how: str = "forward", folds: int = 3, trees: int = 50, depth: int = 8) -> DataFrame:
    """paso, columna, auc: features chosen by what a forest makes of them, in `folds` folds.

    forward: added one by one, each the one with which the forest does best.
    backward: dropped one by one, each the one without which it does best.
    rfe: dropped one by one, each the one to which it gives the least weight.
    The auc of a step is that of the set after it.
    """
    d = df.select(key, F.col(label).cast("int").alias("label"), *[F.col(c).cast("double") for c in columns]).fillna(0, list(columns)).withColumn("fold", _folds(key, folds, 0)).cache()
    chosen, rows = ([], []) if how == "forward" else (list(columns), [])
    keep = min(keep, len(columns))
    while len(chosen) != keep:
        if how == "rfe":
            v = VectorAssembler(inputCols=chosen, outputCol="features").transform(d)
            weights = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED).fit(v).featureImportances.toArray()
            moved = chosen[int(np.argmin(weights))]
            new = [c for c in chosen if c != moved]
            score = _auc(d, new, folds, trees, depth)
        else:
            tried = {c: [*chosen, c] if how == "forward" else [x for x in chosen if x != c] for c in (columns if how == "forward" else chosen) if how != "forward" or c not in chosen}
            scores = {c: _auc(d, s, folds, trees, depth) for c, s in tried.items()}
            moved = max(scores, key=scores.get)
            new, score = tried[moved], scores[moved]
        chosen = new
        rows.append((len(rows) + 1, moved, score))
    d.unpersist()
    return df.sparkSession.createDataFrame(rows, "paso int, columna string, auc double")


def family_consensus(df: DataFrame, key: str, columns: Sequence[str], label: str, keep: int = 3, **forest) -> DataFrame:
    """columna, familias, votos, consenso: which of filter (correlation), wrapper (forward) and embedded (forest weights) selection choose a column; consensus is all three."""
    from brocal.operators.prep import filter_scores

    keep = min(keep, len(columns))
    by_filter = [r["columna"] for r in filter_scores(df, columns, label).orderBy(F.desc_nulls_last("pearson"), "columna").limit(keep).collect()]
    by_wrapper = [r["columna"] for r in wrapper(df, key, columns, label, keep, **forest).collect()]
    by_weight = [r["columna"] for r in importances(df, columns, label).orderBy(F.desc("peso"), "columna").limit(keep).collect()]
    chosen = {"filtro": by_filter, "envoltorio": by_wrapper, "incrustado": by_weight}
    rows = [(c, [n for n, cs in chosen.items() if c in cs]) for c in columns]
    return df.sparkSession.createDataFrame([(c, ",".join(f), len(f), len(f) == 3) for c, f in rows], "columna string, familias string, votos int, consenso boolean")


def save_run(folder: str, name: str, model=None, predictions: DataFrame | None = None, values: dict | None = None) -> None:
    """A model, its predictions and metrics.json under folder/name."""
    if model is not None:
        model.write().overwrite().save(f"{folder}/{name}/model")
    if predictions is not None:
        predictions.drop("rawPrediction", "raw", "features").write.mode("overwrite").parquet(f"{folder}/{name}/predictions")
    store.write_text(f"{folder}/{name}/metrics.json", json.dumps(values or {}))


def read_metrics(folder: str, name: str) -> dict:
    text = store.read_text(f"{folder}/{name}/metrics.json")
    return json.loads(text) if text else {}


def read_predictions(spark, folder: str, name: str, value: float | None = None) -> DataFrame:
    """Predictions of a saved run, of one value if given."""
    d = spark.read.parquet(f"{folder}/{name}/predictions")
    return d if value is None else d.where(F.col("prediction") == value)


def run_all(jobs: dict[str, Callable[[], dict | None]], folder: str | None = None) -> DataFrame:
    """modelo, estado (ok, empty, failed), detalle of jobs in their order; a failure doesn't stop those that follow. Metrics are saved under `folder`."""
    rows = []
    for name, job in jobs.items():
        try:
            values = job()
        except Exception as e:  # the report says what went wrong
            rows.append((name, "failed", f"{type(e).__name__}: {e}"[:500]))
            continue
        if folder is not None and values:
            save_run(folder, name, values=values)
        rows.append((name, "ok" if values else "empty", json.dumps(values or {})))
    return SparkSession.active().createDataFrame(rows, "modelo string, estado string, detalle string")


def _folds(key: str, folds: int, salt: int):
    return F.pmod(F.xxhash64(F.col(key), F.lit(SEED + salt)), F.lit(folds)).cast("bigint")


def _tree_errors(d: DataFrame, key: str, folds: int, salt: int, classes: int) -> list[DataFrame]:
    """`key`, wrong: rows by fold, judged by a tree that is grown from the other folds."""
    kinds = {"ml_attr": {"type": "nominal", "vals": [str(c) for c in range(classes)]}}  # a fold may lack a class
    d = d.select(key, F.col("label").alias("label", metadata=kinds), "features", _folds(key, folds, salt).alias("fold"))
    out = []
    for (f,) in d.select("fold").distinct().orderBy("fold").collect():
        p = DecisionTreeClassifier(maxDepth=5, seed=SEED).fit(d.where(F.col("fold") != f)).transform(d.where(F.col("fold") == f))
        out.append(p.select(key, (F.col("prediction") != F.col("label")).cast("int").alias("wrong")))
    return out


def _neighbour_errors(d: DataFrame, key: str, folds: int) -> DataFrame:
    """`key`, wrong: rows judged by the nearest row of all in other folds."""
    x = vector_to_array("features").alias("x")
    q = d.select(F.col(key).alias("k"), x, _folds(key, folds, 0).alias("grupo"), "label")
    t = d.select(F.xxhash64(key).alias("orden"), x, _folds(key, folds, 0).alias("grupo"), F.col("label").alias("valor"))
    best = nearest(q.drop("label"), t, 1).select("k", F.col("cerca")[0]["valor"].alias("p"))
    return q.join(best, "k").select(F.col("k").alias(key), (F.col("p") != F.col("label")).cast("int").alias("wrong"))


def _discriminant_errors(d: DataFrame, key: str, folds: int) -> DataFrame:
    """`key`, wrong: rows judged by a linear discriminant of the other folds, from sums by fold and class."""
    d = d.select(key, "label", vector_to_array("features").alias("x"), _folds(key, folds, 0).alias("fold"))
    n = len(d.first()["x"])
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = d.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(n)]).alias("s"), F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).alias("ss")).collect()
    rules = []
    for f in sorted({r["fold"] for r in sums}):
        rest, within, total = {}, np.zeros((n, n)), 0
        for c in sorted({r["label"] for r in sums if r["fold"] != f}):
            of = [r for r in sums if r["fold"] != f and r["label"] == c]
            m, mean = sum(r["n"] for r in of), sum(np.array(r["s"]) for r in of) / sum(r["n"] for r in of)
            square = np.zeros((n, n))
            for (i, j), v in zip(pairs, sum(np.array(r["ss"]) for r in of)):
                square[i, j] = square[j, i] = v
            rest[c], within, total = (m, mean), within + square - m * np.outer(mean, mean), total + m
        inverse = np.linalg.pinv(within / max(1, total - len(rest)), hermitian=True)
        for c, (m, mean) in rest.items():
            w = inverse @ mean
            rules.append((int(f), float(c), [float(v) for v in w], float(np.log(m / total) - mean @ w / 2)))
    scored = d.join(F.broadcast(d.sparkSession.createDataFrame(rules, "fold bigint, c double, w array<double>, b double")), "fold")
    score = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.col("b"), lambda a, b: a + b)
    return scored.groupBy(key, "label").agg(F.max_by("c", F.struct(score, -F.col("c"))).alias("p")).select(key, (F.col("p") != F.col("label")).cast("int").alias("wrong"))


def label_noise(df: DataFrame, key: str, columns: Sequence[str], label: str, how: str = "EF", k: int = 5) -> DataFrame:
    """`key` of rows whose label models of the other of k folds contradict.

    EF: a tree, the nearest row and a linear discriminant all do.  CVCF: more
    than half of k trees, each with folds of its own.  IPF: CVCF over what is
    left, until no more is found.
    """
    d = df.select(key, F.col(label).cast("int").cast("double").alias("label"), *columns).fillna(0, list(columns))
    d = MinMaxScaler(inputCol="v", outputCol="features").fit(a := VectorAssembler(inputCols=list(columns), outputCol="v").transform(d)).transform(a).select(key, "label", "features").cache()
    found = d.select(key).limit(0)
    while True:
        rest = d.join(found, key, "left_anti").cache()
        labels = rest.agg(F.count_distinct("label").alias("n"), F.max("label").alias("most")).first()
        if labels["n"] < 2:
            break
        classes = int(labels["most"]) + 1
        if how == "EF":
            votes, most = [*_tree_errors(rest, key, k, 0, classes), _neighbour_errors(rest, key, k), _discriminant_errors(rest, key, k)], 2
        else:
            votes, most = [v for i in range(k) for v in _tree_errors(rest, key, k, i, classes)], k / 2
        new = cut(reduce(DataFrame.unionByName, votes).groupBy(key).agg(F.sum("wrong").alias("w")).where(F.col("w") > most).select(key))
        rest.unpersist()
        if new.isEmpty():
            break
        found = cut(found.unionByName(new))
        if how != "IPF":
            break
    d.unpersist()
    return found


def flip_labels(df: DataFrame, key: str, label: str, share: float) -> DataFrame:
    """`df` with the 0/1 label of a share of the rows turned round, the first by hash; volteada marks them."""
    n = round(df.count() * share)
    chosen = df.select(key).orderBy(F.xxhash64(F.col(key), F.lit(SEED)), key).limit(n).withColumn("volteada", F.lit(True))
    d = df.join(chosen, key, "left").withColumn("volteada", F.coalesce("volteada", F.lit(False)))
    return d.withColumn(label, F.when(F.col("volteada"), 1 - F.col(label).cast("int")).otherwise(F.col(label).cast("int")))


def noise_check(df: DataFrame, key: str, columns: Sequence[str], label: str, how: str = "EF", share: float = 0.1, k: int = 5) -> dict:
    """What a filter finds of labels turned round on purpose."""
    d = flip_labels(df, key, label, share).cache()
    r = d.select(key, "volteada").join(label_noise(d, key, columns, label, how, k).withColumn("ruido", F.lit(True)), key, "left").agg(F.count_if("volteada").alias("injected"), F.count_if("ruido").alias("detected"), F.count_if(F.col("volteada") & F.col("ruido")).alias("tp")).first()
    d.unpersist()
    p, q = r["tp"] / max(1, r["detected"]), r["tp"] / max(1, r["injected"])
    return {"injected": r["injected"], "detected": r["detected"], "true_positives": r["tp"], "false_positives": r["detected"] - r["tp"], "false_negatives": r["injected"] - r["tp"], "precision": p, "recall": q, "f1": 2 * p * q / max(1e-12, p + q)}


def studio(df: DataFrame, key: str, columns: Sequence[str], label: str, config: dict) -> dict:
    """One run: missing (drop, mean, median, knn, kmeans), outliers (iqr), normalize (standard, minmax), pca, balance (train only), a forest; its metrics, with `roc` the points of the curve."""
    from brocal.operators.prep import handle_outliers

    d = df.select(key, F.col(label).cast("int").alias("label"), *[F.col(c).cast("double") for c in columns])
    if config.get("missing", "drop") == "drop":
        d = d.dropna(subset=list(columns))
    elif config["missing"] in ("knn", "kmeans"):
        from brocal.operators.prep import impute_knn

        for c in columns:
            fill = impute_knn(d, key, c, columns) if config["missing"] == "knn" else impute_kmeans(d, key, c, columns)
            d = cut(d.drop(c).join(fill.withColumnRenamed("valor", c), key))
    else:
        d = Imputer(inputCols=list(columns), outputCols=list(columns), strategy=config["missing"]).fit(d).transform(d)
    if config.get("outliers") == "iqr":
        for c in columns:
            d = handle_outliers(d, c, "remove")
    scaler = {"standard": StandardScaler(inputCol="raw", outputCol="features", withMean=True), "minmax": MinMaxScaler(inputCol="raw", outputCol="features")}.get(config.get("normalize"))
    stages = [VectorAssembler(inputCols=list(columns), outputCol="raw" if scaler else "features")] + ([scaler] if scaler else [])
    if config.get("pca"):
        stages.append(PCA(k=config["pca"], inputCol="features", outputCol="pc"))
    d = Pipeline(stages=stages).fit(d).transform(d)
    if config.get("pca"):
        d = d.drop("features").withColumnRenamed("pc", "features")
    train, test = _sides(d, key, 0.75)
    if config.get("balance"):
        train = balance(train.select(key, "label", "features"), key, "label", config["balance"])
    pred = RandomForestClassifier(numTrees=config.get("trees", 100), maxDepth=8, seed=SEED).fit(train).transform(test)
    made = {"filas": d.count(), "auc": BinaryClassificationEvaluator().evaluate(pred), **confusion(pred)}
    if config.get("roc"):
        made["roc"] = [(r["umbral"], r["fpr"], r["tpr"]) for r in roc(pred).orderBy("umbral").collect()]
    return made
