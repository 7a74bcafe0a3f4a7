"""ML rows."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions.wavelets import WAVELETS
from tidemark.operators import clusters as C
from tidemark.operators import detect as D
from tidemark.operators import models as M
from tidemark.operators import neighbours as N
from tidemark.operators import windows as W
from tidemark.plans.features import with_features
from tidemark.plans.lineage import cut_lineage

from .base import BY_TYPE, EV, ORD, events, over, query, r, rounded, table

o = f"({ORD})"
HASH = f"{EV}, h AS (SELECT *, CAST(CAST('0x' || substr(md5(concat(event_id, ':7')), 1, 13) AS BIGINT) AS DOUBLE) AS h FROM ev), q AS (SELECT label AS g, quantile_cont(h, 0.7) AS q7, quantile_cont(h, 0.85) AS q85 FROM h GROUP BY label)"
FEATURES = ["m30", "sd30", "z30", "d1", "lag1"]


@query("ml_01_stratified_split", f"WITH {HASH} SELECT event_id, CASE WHEN h <= q7 THEN 'train' WHEN h <= q85 THEN 'val' ELSE 'test' END AS part FROM h JOIN q ON label = g")
def stratified(spark, sf):
    return M.stratified_split(events(spark, sf), "event_id", "label", {"train": 0.7, "val": 0.15, "test": 0.15}, seed=7).select("event_id", "part")


NUM = f"{EV}, n AS (SELECT *, row_number() OVER {o} - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM ev)"


@query("ml_02_temporal_split", f"WITH {NUM} SELECT event_id, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'val' ELSE 'test' END AS part FROM n")
def temporal(spark, sf):
    return M.temporal_split(events(spark, sf), BY_TYPE, {"train": 0.7, "val": 0.15, "test": 0.15}).select("event_id", "part")


FOLDS = " UNION ALL ".join(f"SELECT event_id, CAST({i} AS BIGINT) AS fold, CASE WHEN i < floor(n * {a}) THEN 'train' ELSE 'validate' END AS role FROM n WHERE i < floor(n * {b})"
                           for i, (a, b) in enumerate(((0.6, 0.7), (0.7, 0.8), (0.8, 0.9))))


@query("ml_03_temporal_folds", f"WITH {NUM} {FOLDS}")
def folds(spark, sf):
    return M.temporal_folds(events(spark, sf), BY_TYPE).select("event_id", F.col("fold").cast("long"), "role")


@query("ml_04_class_weights", f"WITH {EV}, w AS (SELECT count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1) AS w FROM ev) SELECT event_id, {r('CASE WHEN label = 1 THEN w ELSE 1 END')} AS weight FROM ev, w")
def weights(spark, sf):
    return rounded(M.class_weights(events(spark, sf), "label"), ["event_id"], ["weight"])


def featured(spark, sf):
    f = {"m30": R.rolling_mean("x", 30, 1), "sd30": R.rolling_std("x", 30, 2), "z30": R.rolling_z("x", 30, 2, 1e-9), "d1": R.diff("x"), "lag1": R.lag("x", 1)}
    # a label the features can explain: the step is large for its surroundings
    rows = with_features(events(spark, sf), BY_TYPE, f).na.fill(0.0, FEATURES)
    return rows.withColumn("label", F.when((F.col("z30") > 1.5) | (F.col("k") >= 98), 1).otherwise(0))


def temporal_model(spark, sf):
    """The model of the earlier rows, and the later ones. Training reads its rows many times, so features and positions are computed once."""
    rows = M.temporal_split(featured(spark, sf), BY_TYPE, {"train": 0.7, "test": 0.3})
    rows = cut_lineage(rows.select("s", "ts", "event_id", "x", "label", "part", *FEATURES))
    train = M.class_weights(rows.filter("part = 'train'"), "label")
    return M.train_boosted(train, FEATURES, "label", "weight", maxIter=8, maxDepth=3), rows.filter("part = 'test'")


@query("ml_05_boosted_trees")
def boosted(spark, sf):
    model, test = temporal_model(spark, sf)
    return rounded(M.score(test, model), ["event_id"], ["probability_1"], ["label"])


@query("ml_06_random_search")
def search(spark, sf):
    _, results = M.random_search(featured(spark, sf), BY_TYPE, FEATURES, {"maxDepth": [2, 3], "stepSize": [0.1, 0.3], "maxIter": [3]}, tries=2, folds=((0.6, 0.7), (0.7, 0.8)))
    return results


@query("ml_07_feature_importance")
def feature_importance(spark, sf):
    return M.importance(spark, temporal_model(spark, sf)[0], 15)


@query("ml_08_forest_importance")
def forest_importance(spark, sf):
    return M.importance(spark, M.train_forest(featured(spark, sf), FEATURES, "label", trees=100, maxDepth=5), 20)


@query("ml_09_isolation_forest")
def isolation(spark, sf):
    return rounded(M.isolation_outliers(featured(spark, sf), ["x", "d1", "sd30"], "event_id", 0.1), ["event_id"], ["isolation"], ["outlier"])


@query("ml_09_isolation_forest_vectors")
def isolation_vectors(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return rounded(M.isolation_outliers(df, [f"e{i}" for i in range(64)], "vec_id", 0.05), ["vec_id"], ["isolation"], ["outlier"])


DUAL = f"{EV}, b AS (SELECT avg(x) AS mu, stddev_samp(x) AS sd FROM ev WHERE label = 0)"


@query("ml_10_dual_expert", f"WITH {DUAL} SELECT event_id, {r('0.4 * (k / 100.0) + 0.6 * least(abs((x - mu) / sd) / 3, 1)')} AS combined FROM ev, b")
def dual(spark, sf):
    df = D.normal_baseline_z(events(spark, sf), "x", "label").withColumns({"expert": F.col("k") / 100, "normality": M.normality_score(F.col("z"))})
    return rounded(M.dual_expert(df, "expert", "normality", 0.4), ["event_id"], ["combined"])


@query("ml_11_projection")
def projection(spark, sf):
    df, shares = M.project(featured(spark, sf), FEATURES, 2)
    return df.select("event_id", r(F.abs("pc1"), 4).alias("abs_pc1"), r(F.abs("pc2"), 4).alias("abs_pc2"), F.lit(round(sum(shares), 6)).alias("explained"))


@query("ml_12_reconstruction_error")
def reconstruction(spark, sf):
    scored = M.reconstruction_error(events(spark, sf), BY_TYPE, 50, 5)
    return rounded(D.apply_threshold(scored, "error", D.percentile_threshold(scored, "error", 80)), ["event_id"], ["error"], ["pred"])


@query("ml_13_forecast_error")
def forecast(spark, sf):
    scored = M.forecast_error(events(spark, sf), BY_TYPE, 60)
    t = D.percentile_threshold(scored, "error", 95, F.col("label") == 0)
    return rounded(D.apply_threshold(scored, "error", t), ["event_id"], ["error"], ["pred"])


# the factor by comparing all pairs; the features are exact numbers in both engines, so ties are the same
D2 = "(a.x - b.x) * (a.x - b.x) + (a.d1 - b.d1) * (a.d1 - b.d1) + (a.sd - b.sd) * (a.sd - b.sd)"
LOF = f"""{EV}, p AS (SELECT event_id, x, coalesce(x - lag(x) OVER {o}, 0) AS d1, round(CASE WHEN count(x) OVER w30 >= 2 THEN stddev_samp(x) OVER w30 ELSE 0 END, 4) AS sd FROM ev WINDOW {over(30)}),
kth AS (SELECT a.event_id AS id, min({D2}, 20)[20] AS k2 FROM p a JOIN p b ON a.event_id <> b.event_id GROUP BY a.event_id),
near AS (SELECT a.event_id AS id, b.event_id AS other, sqrt({D2}) AS d FROM p a JOIN kth ON kth.id = a.event_id JOIN p b ON a.event_id <> b.event_id AND {D2} <= k2),
lrd AS (SELECT near.id, 1 / (avg(greatest(d, sqrt(k2))) + 1e-10) AS lrd FROM near JOIN kth ON kth.id = other GROUP BY near.id)"""


@query("ml_14_local_outlier_factor", f"WITH {LOF} SELECT near.id AS event_id, {r('avg(l.lrd) / any_value(m.lrd)')} AS lof FROM near JOIN lrd l ON l.id = other JOIN lrd m ON m.id = near.id GROUP BY near.id")
def lof(spark, sf):
    rows = featured(spark, sf).withColumn("sd", F.round("sd30", 4))
    return rounded(N.local_outlier_factor(rows, ["x", "d1", "sd"], 20), ["event_id"], ["lof"])


def clustered(spark, sf):
    return C.density_clusters(events(spark, sf), ["x", "k"], "event_id", 1.5, 8)


# core rows and noise by comparing all pairs; the labels of clusters have a brute-force test
PAIRS = f"""{EV}, c AS (SELECT a.event_id, any_value(a.x) AS x, any_value(a.k) AS k, count(*) >= 8 AS core FROM ev a JOIN ev b
  ON (a.x - b.x) * (a.x - b.x) + (a.k - b.k) * (a.k - b.k) <= 2.25 GROUP BY a.event_id),
reached AS (SELECT DISTINCT a.event_id FROM c a JOIN c b ON b.core AND (a.x - b.x) * (a.x - b.x) + (a.k - b.k) * (a.k - b.k) <= 2.25)"""


@query("ml_15_density_core", f"WITH {PAIRS} SELECT event_id, core, event_id NOT IN (SELECT event_id FROM reached) AS noise FROM c")
def density_core(spark, sf):
    return clustered(spark, sf).select("event_id", "core", (F.col("cluster") == -1).alias("noise"))


@query("ml_15_density_clusters")
def density_clusters(spark, sf):
    return rounded(C.cluster_scores(clustered(spark, sf), ["x", "k"]), ["event_id"], ["cluster_score"], ["core", "cluster"])


@query("ml_16_compare_wavelets")
def wavelets(spark, sf):
    return rounded(M.compare_wavelets(events(spark, sf), BY_TYPE, WAVELETS), ["wavelet"], ["roc_auc"])


@query("ml_17_batch_scoring")
def batch(spark, sf):
    model, test = temporal_model(spark, sf)
    out = M.score_batch(test, BY_TYPE, model, FEATURES, 0.5, 10)
    return rounded(out, ["event_id"], ["anomaly_probability"], ["anomaly_prediction", "anomaly_prediction_filled"])


@query("ml_18_user_sequence_model", f"WITH {EV}, q AS (SELECT event_id, avg(x) OVER w40 AS a, max(label) OVER w40 AS b, count(*) OVER w40 AS n FROM ev WINDOW {over(40)}) SELECT event_id, {r('1 / (1 + exp(-(a - 50) / 10)) + b')} AS score FROM q WHERE n = 40")
def user_model(spark, sf):
    seq = W.sequences(events(spark, sf).withColumn("y", F.col("label").cast("double")), BY_TYPE, 40, ["x", "y"])
    model = lambda block: 1 / (1 + np.exp(-(block[:, :, 0].mean(axis=1) - 50) / 10)) + block[:, :, 1].max(axis=1)
    return rounded(M.score_sequences(seq, ["x", "y"], model), ["event_id"], ["score"])
