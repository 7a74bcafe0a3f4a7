"""Distributed order statistics against numpy, with limits small enough that every distributed path is taken."""

import numpy as np
import pytest
from helpers import SPEC, close, column, events, frame
from pyspark.sql import functions as F

from tidemark.operators import clean as C
from tidemark.operators import detect as D
from tidemark.operators import evaluate as E
from tidemark.operators import joins as J
from tidemark.operators import models as M
from tidemark.operators import profile as P
from tidemark.operators import signals as G
from tidemark.operators import windows as W
from tidemark.plans.series import index_rows, prefix_sum
from tidemark.plans.stats import column_quantiles, ordered_prefix, quantiles


def skewed(spark, n=4000):
    """A third of the values are one number, the rest has a heavy tail."""
    rng = np.random.default_rng(2)
    x = np.where(rng.random(n) < .34, 5.0, np.round(rng.pareto(1.2, n) * 10, 3))
    return x, frame(spark, x, (rng.random(n) < .2).astype(int))


@pytest.mark.parametrize("small", [50, 1_000_000])
def test_quantiles_match_numpy(spark, small):
    x, df = skewed(spark)
    qs = {"a": 0.0, "b": .25, "c": .333, "d": .5, "e": .999, "f": 1.0}
    r = quantiles(df, "x", qs, small=small).first()
    close([r[n] for n in qs], np.quantile(x, list(qs.values())).tolist(), 1e-12)


def test_grouped_quantiles_when_narrowed(spark):
    df = events(spark)
    got = {r.s: (r.p, r.q) for r in quantiles(df, "x", {"p": .1, "q": .95}, ["s"], small=20).collect()}
    for s, part in df.toPandas().groupby("s"):
        close(got[s], np.quantile(part["x"], [.1, .95]).tolist(), 1e-12)


def test_two_level_prefix_sum(spark):
    t = spark.createDataFrame([("a", i, i % 5) for i in range(50)] + [("b", 3, 7)], "k string, c long, n long")
    got = {(r.k, r.c): r.s for r in prefix_sum(t, ["k"], "c", "n", "s", block=4).collect()}
    want = np.concatenate([[0], np.cumsum([i % 5 for i in range(50)])])
    assert all(got["a", i] == want[i] for i in range(50)) and got["b", 3] == 0


@pytest.mark.parametrize("descending", [False, True])
def test_ordered_prefix_in_buckets(spark, descending):
    x, df = skewed(spark)
    t = df.groupBy("x").agg(F.count("*").alias("n"))
    got = {r.x: r.n_upto for r in ordered_prefix(t, "x", ["n"], descending=descending, bucket_rows=100).collect()}
    for v in np.unique(x)[::37]:
        assert got[v] == ((x >= v).sum() if descending else (x <= v).sum())


def test_row_positions_with_a_hot_value(spark):
    x, df = skewed(spark, 900)
    got = P.row_positions(df, "x", "id", spread=7).toPandas().sort_values("position")
    assert (got["position"].to_numpy() == np.arange(1, 901)).all() and (np.diff(got["x"]) >= 0).all()


def test_auc_over_several_buckets(spark):
    x, df = skewed(spark)
    one = E.roc_auc(df, "label", "x").first()[0]
    t = E.operating_points(df, "label", "x", bucket_rows=100)
    many = t.agg((F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (F.max("positives") * F.max("negatives"))).alias("a")).first()[0]
    assert abs(one - many) < 1e-12


def test_normal_qq_positions(spark):
    from statistics import NormalDist

    rng = np.random.default_rng(4)
    x = rng.normal(10, 3, 300)
    got = P.normal_qq(frame(spark, x), "x", "id").toPandas().sort_values("position")
    n = len(x)
    p = (np.arange(1, n + 1) - .3175) / (n + .365)
    p[-1], p[0] = .5 ** (1 / n), 1 - .5 ** (1 / n)
    assert np.allclose(got["theoretical"], [NormalDist().inv_cdf(v) for v in p]) and np.allclose(got["x"], np.sort(x))
    fit = P.qq_fit(P.normal_qq(frame(spark, x), "x", "id"), "x").first()
    assert abs(fit.slope - 3) < .5 and fit.r > .98


def test_density_curve(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, 400)
    got = P.density_curve(frame(spark, x), "x", 50).toPandas().sort_values("point")
    width = x.std(ddof=1) * len(x) ** -.2
    want = np.exp(-.5 * ((got["at"].to_numpy()[:, None] - x) / width) ** 2).sum(1) / (len(x) * width * np.sqrt(2 * np.pi))
    assert np.allclose(got["density"], want)


def test_interval_context_over_bucket_borders(spark):
    df = index_rows(frame(spark, range(200)), SPEC)
    iv = spark.createDataFrame([("a", 10, 60), ("a", 62, 62), ("a", 199, 199)], "s string, start_idx long, end_idx long")
    got = J.interval_context(df, SPEC, iv, 5, bucket=16).groupBy("start_idx").agg(F.min("idx"), F.max("idx"), F.count("*")).collect()
    assert sorted(tuple(r) for r in got) == [(10, 5, 65, 61), (62, 57, 67, 11), (199, 194, 199, 6)]


def test_sliding_windows_normalise_and_members(spark):
    df = frame(spark, [1.0] * 20 + list(range(20)))
    w = W.sliding_windows(df, SPEC, 10, 5, normalise=True).orderBy("win").collect()
    assert [r.start_idx for r in w] == list(range(0, 31, 5)) and w[0]["values"] == [0.0] * 10
    v = np.arange(10.0)
    close(w[-1]["values"], ((v - v.mean()) / v.std()).tolist())


def test_stratified_split_keeps_shares(spark):
    df = events(spark)
    parts = {"train": .7, "test": .3}
    a = M.stratified_split(df, "id", "label", parts)
    b = M.stratified_split(df, "id", "label", parts, small=100)
    assert column(a, "part") == column(b, "part")
    for r in a.groupBy("label").agg(F.avg((F.col("part") == "train").cast("int")).alias("f")).collect():
        assert abs(r.f - .7) < .02


def test_drift_is_found_only_where_it_is(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.normal()), float(rng.normal() + (2 if i >= 500 else 0))) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, still double, moved double")
    got = {r.feature: r for r in D.with_p_values(D.two_sample(df, ["still", "moved"], F.col("id") >= 500)).collect()}
    assert got["moved"].ks > .5 and got["moved"].ks_p < 1e-6 and got["moved"].u_p < 1e-6
    assert got["still"].ks < .1 and got["still"].ks_p > .01


def test_monitoring_warnings(spark):
    df = frame(spark, [0, .5, 9]).withColumns({"p": F.lit(.3), "f": F.lit(0)})
    r = D.monitoring_report(df, ["x"], "p", "f", .1).first()
    assert len(r.warnings) == 3 and r.performance_check == "WARNING"


def test_one_sided_constant_and_null_data(spark):
    """Degenerate data give NULL where there is no answer, and NULL values and labels change nothing else."""
    from tidemark.operators import detect as D, evaluate as E, profile as P

    labelled = spark.createDataFrame([(1.0, 0), (2.0, None), (3.0, 1)], "x double, label int")
    rows = {r["label"]: r["n"] for r in P.describe(labelled, "x", "label").collect()}
    assert rows == {None: 3, 0: 1, 1: 1}
    one_class = spark.createDataFrame([(0.1, 1), (0.4, 1)], "s double, y int")
    assert E.roc_auc(one_class, "y", "s").first()["roc_auc"] is None
    assert E.average_precision(one_class.withColumn("y", F.lit(0)), "y", "s").first()["average_precision"] is None
    holed = spark.createDataFrame([(None,), (1.0,), (2.0,)], "x double")
    assert [(r["x"], r["p_first"]) for r in P.empirical_cdf(holed, "x").orderBy("x").collect()] == [(1.0, 0.0), (2.0, 1.0)]
    assert P.normal_qq(holed.withColumn("id", F.monotonically_increasing_id()), "x", "id").count() == 2
    flat = spark.createDataFrame([(0.0,), (0.0,)], "x double")
    assert P.shape_metrics(flat, "x").first()["cv"] is None
    assert P.extreme_value_limits(flat, "x").first()["shape"] is None
    assert P.extreme_value_limits(flat.limit(1), "x").count() == 1
    one_side = D.two_sample(holed, ["x"], F.lit(True)).first()
    assert one_side["ks"] is None and one_side["n1"] == 0


def test_narrowing_settles_infinities_and_crowded_values(spark):
    """More values than a task may hold lie at infinities, at one value and at the ends of the number range."""
    x = [float("-inf")] * 30 + [float("inf")] * 25 + [-1.7e308] * 20 + [1.7e308] * 20 + [5e-324 * i for i in range(14)] + [7.0] * 20  # 129 values: ranks are exact
    got = quantiles(spark.createDataFrame([(v,) for v in x], "v double"), "v", {f"q{i}": i / (len(x) - 1) for i in range(0, len(x), 13)}, small=10).first()
    assert [got[f"q{i}"] for i in range(0, len(x), 13)] == [sorted(x)[i] for i in range(0, len(x), 13)]


def test_scored_rows_are_kept_where_a_feature_is_missing(spark):
    rows = [(i, None if i == 5 else float(i % 10), int(i % 10 > 6)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, a double, y int")
    for model in (M.train_boosted(df, ["a"], "y", maxIter=3), M.train_forest(df, ["a"], "y", trees=3)):
        got = {r.id: r.probability_1 for r in M.score(df, model).collect()}
        assert len(got) == 80 and got[5] is None and got[9] > .5 > got[1]


@pytest.mark.parametrize("n", [40, 5000])
def test_every_isolation_tree_grows_on_its_sample(spark, n):
    df = spark.range(n).select("id", F.rand(3).alias("a"), F.rand(4).alias("b"))
    forest = M.fit_isolation_forest(df, ["a", "b"], "id", trees=12, sample=32)
    sizes = [t[0, 4] for t in forest]
    assert len(forest) == 12 and min(sizes) >= min(20, n) and max(sizes) <= 32


@pytest.mark.parametrize("small", [1000, 40])
def test_quantiles_of_many_columns_at_once(spark, small):
    """Twenty columns, one without values, some with gaps: numpy's quantiles, from one scan besides the frame's own and the count."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(5, 3, (300, 20)), 1)
    rows = [tuple(None if j == 7 or (j % 3 == 0 and i % 4 == 0) else float(v) for j, v in enumerate(row)) for i, row in enumerate(x)]
    names = [f"c{j}" for j in range(20)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = column_quantiles(df, names, {"_a": .25, "_b": .999}, small).first()
    known = [np.array([r[j] for r in rows if r[j] is not None]) for j in range(20)]
    close([got[f"c{j}{n}"] for j in range(20) for n in ("_a", "_b")], [None if j == 7 else float(np.quantile(known[j], q)) for j in range(20) for q in (.25, .999)], 1e-9)
    for out in (C.fill_median(df, names), C.winsorise(df, names), G.robust_scale(df, names)):
        assert out.columns == names and out.count() == 300
        assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2
    assert C.fill_median(df, []).columns == C.winsorise(df, []).columns == G.robust_scale(df, []).columns == names
