"""Queries of the models; what they learn isn't SQL, so only rows are checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from brocal.operators import models as M
from brocal.operators.embed import map_sample
from brocal.operators import social as S
from brocal.plans.prep import NUM
from brocal.plans.problems import table
from brocal.plans.social import silver


def _stats(s):
    return S.user_stats(s["users"], s["posts"], s["likes"], s["follows"])


def spam(spark, sf):
    s = silver(spark, sf)
    return M.metrics(spark, **M.spam_detector(S.spam_features(s["users"], s["posts"], s["likes"], s["follows"]))[1])


def roc(spark, sf):
    s = silver(spark, sf)
    return M.roc(M.spam_detector(S.spam_features(s["users"], s["posts"], s["likes"], s["follows"]))[0])


def engagement(spark, sf):
    s = silver(spark, sf)
    return M.metrics(spark, **M.engagement(S.loaded_likes(s["posts"], s["likes"])))


def virality(spark, sf):
    s = silver(spark, sf)
    return M.metrics(spark, **M.virality(S.loaded_likes(s["posts"], s["likes"])))


def churn(spark, sf):
    s = silver(spark, sf)
    last = s["posts"].groupBy(F.col("user_id").alias("_id")).agg(F.max("created_at").alias("ultimo")).where("ultimo is not null")
    return M.metrics(spark, **M.churn(_stats(s), last))


def clusters(spark, sf):
    columns = ("posts_count", "likes_given", "followers_count")
    pred, _ = M.clusters(_stats(silver(spark, sf)), columns)
    return M.cluster_summary(pred, columns)


def noise_check(d):
    """What each filter finds of labels turned round on purpose."""
    found = {how: M.noise_check(d, "id", NUM, "failure_next_48h", how) for how in ("EF", "CVCF", "IPF")}
    return d.sparkSession.createDataFrame([(how, m, float(v)) for how, r in found.items() for m, v in r.items()], "filtro string, metrica string, valor double")


def robots(f):
    return lambda spark, sf: f(table(spark, sf, "robots"))


QUERIES = {
    "ml_spam": spam, "ml_engagement": engagement, "ml_virality": virality, "ml_churn": churn, "ml_clusters": clusters,
    "ml_pca": robots(lambda d: M.principal(d, NUM)), "ml_importances": robots(lambda d: M.importances(d, NUM, "failure_next_48h")), "ml_l1": robots(lambda d: M.importances(d, NUM, "failure_next_48h", "l1")),
    "ml_wrapper": robots(lambda d: M.wrapper(d, "id", NUM, "failure_next_48h")),
    "ml_wrapper_backward": robots(lambda d: M.wrapper(d, "id", NUM, "failure_next_48h", how="backward")), "ml_wrapper_rfe": robots(lambda d: M.wrapper(d, "id", NUM, "failure_next_48h", how="rfe")),
    "ml_families": robots(lambda d: M.family_consensus(d, "id", NUM, "failure_next_48h")), "ml_loadings": robots(lambda d: M.loadings(d, NUM, 2)), "ml_scatter": robots(lambda d: M.scatter(d, "id", NUM)),
    "ml_noise_ipf": robots(lambda d: M.label_noise(d, "id", NUM, "failure_next_48h", "IPF")), "ml_noise_check": robots(noise_check),
    "ml_noise_ef": robots(lambda d: M.label_noise(d, "id", NUM, "failure_next_48h", "EF")), "ml_noise_cvcf": robots(lambda d: M.label_noise(d, "id", NUM, "failure_next_48h", "CVCF")),
    "ml_tsne": robots(lambda d: map_sample(d, "id", NUM)), "ml_roc": roc,
    "impute_kmeans": robots(lambda d: M.impute_kmeans(d, "id", "battery_health_v2", NUM)), "sample_clusters": robots(lambda d: M.largest_clusters(d, NUM, 5, 2).select("id")), "sample_prototypes": robots(lambda d: M.prototypes(d, NUM, "failure_next_48h", 8)),
    "ml_studio_knn": lambda spark, sf: M.metrics(spark, **M.studio(table(spark, sf, "robots"), "id", NUM, "failure_next_48h", {"missing": "knn", "normalize": "minmax"})),
    "ml_studio": lambda spark, sf: M.metrics(spark, **M.studio(table(spark, sf, "robots"), "id", NUM, "failure_next_48h", {"missing": "median", "outliers": "iqr", "normalize": "standard", "pca": 3, "balance": "under"})),
}
SQL: dict[str, str] = {}
