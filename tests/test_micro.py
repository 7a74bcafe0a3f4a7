"""Hand-computed fixtures and edge cases."""

import math

import numpy as np
import pandas as pd
import pytest
from helpers import SPEC, as_list, close, column, frame
from pyspark.sql import functions as F

from tidemark import with_features
from tidemark.functions import rolling as R
from tidemark.functions import scalars as X
from tidemark.functions import smoothing as S
from tidemark.operators import clean as C
from tidemark.operators import evaluate as E
from tidemark.operators import runs as P
from tidemark.operators import detect as D
from tidemark.operators import profile as G

V = [1, 2, 4, 8, 8]
N = None


@pytest.mark.parametrize("make, want", [
    (lambda: R.rolling_std("x", 3, 1), [N, .707107, 1.527525, 3.05505, 2.309401]),
    (lambda: R.rolling_quantile("x", 3, .25), [N, N, 1.5, 3, 6]),
    (lambda: R.rolling_median("x", 3), [N, N, 2, 4, 8]),
    (lambda: R.rolling_mad("x", 3, 1), [0, .5, 1, 2, 0]),
    (lambda: R.rolling_rank("x", 3, 1), [1, 1, 1, 1, .833333]),
    (lambda: R.rolling_slope("x", 3), [N, N, 1.5, 3, 2]),
    (lambda: R.rolling_skew("x", 4), [N, N, N, 1.137624, -.37037]),
    (lambda: R.rolling_kurt("x", 4), [N, N, N, .757656, -3.901235]),
    (lambda: R.rolling_entropy("x", 4), [N, N, N, 1.386294, 1.039721]),
    (lambda: R.centred_mean("x", 4), [N, N, 3.75, 5.5, N]),
    (lambda: R.centred_mean("x", 3), [N, 2.333333, 4.666667, 6.666667, N]),
    (lambda: S.ewm_mean("x", .5), [1, 1.5, 2.75, 5.375, 6.6875]),
    (lambda: S.ewm_std("x", .5), [N, .707107, 1.643168, 3.433033, 2.901318]),
    (lambda: S.ewm_mean("x", .5, True), [1, 1.666667, 3, 5.666667, 6.870968]),
    (lambda: S.ewm_std("x", .5, True), [N, .707107, 1.581139, 3.327376, 2.697071]),
])
def test_window_values(spark, make, want):
    close(column(with_features(frame(spark, V), SPEC, {"y": make()}), "y"), want)


def test_ewm_keeps_state_over_missing_values(spark):
    close(column(with_features(frame(spark, [N, 1, N, 4, 8]), SPEC, {"y": S.ewm_mean("x", .5)}), "y"),
          as_list(pd.Series([np.nan, 1, np.nan, 4, 8]).ewm(alpha=.5, adjust=False).mean()))


def test_constant_window_entropy_is_zero(spark):
    assert column(with_features(frame(spark, [5] * 4), SPEC, {"y": R.rolling_entropy("x", 4)}), "y")[3] == 0


def test_rsi_and_kalman(spark):
    close(column(with_features(frame(spark, [1, 2, 1.5, 3, 2]), SPEC, R.rsi("x", 3)), "rsi"), [N, N, 66.666667, 83.333333, 50])
    close(column(with_features(frame(spark, [10, 12, 11]), SPEC, {"y": S.kalman_level("x")}), "y"), [10, 10.952436, 10.967782])


def test_spectral_centroid(spark):
    assert abs(column(with_features(frame(spark, [0, 1, 0, -1] * 2), SPEC, {"y": R.spectral("x", 8)}), "y")[-1] - .25) < 1e-9


def test_bins_are_closed_on_the_right(spark):
    df = frame(spark, [20000, 20000.5, 23000, 23001, 90000, 26000, 26001, N])
    edges = [20000, 23000, 26000]
    out = df.select("id", X.bin_index(F.col("x"), edges).alias("a"), X.bin_index(F.col("x"), edges, True).alias("b"))
    assert column(out, "a") == [N, 0, 0, 1, N, 1, N, N]
    assert column(out, "b") == [0, 0, 0, 1, N, 1, N, N]


RUNS = [0, 1, 1, 0, 0, 1, 0, 0, 0, 1]


def test_runs(spark):
    df = frame(spark, range(10), RUNS)
    spans = lambda d: sorted((r.start_idx, r.end_idx) for r in d.collect())
    assert spans(P.run_intervals(df, SPEC, "label")) == [(1, 2), (5, 5), (9, 9)]
    assert spans(P.run_intervals(df, SPEC, "label", keep_open_run=False)) == [(1, 2), (5, 5)]
    assert column(P.fill_gaps(df, SPEC, "label", 2), "filled") == [0, 1, 1, 1, 1, 1, 0, 0, 0, 1]
    assert column(P.fill_gaps(df, SPEC, "label", 3), "filled") == [0, 1, 1, 1, 1, 1, 1, 1, 1, 1]
    assert column(P.drop_short_runs(df, SPEC, "label", 2), "kept") == [0, 1, 1, 0, 0, 0, 0, 0, 0, 0]


@pytest.mark.parametrize("labels, n", [([0] * 6, 0), ([1] * 6, 1), ([1], 1), ([], 0)])
def test_run_edge_cases(spark, labels, n):
    df = frame(spark, range(len(labels)), labels)
    assert P.run_intervals(df, SPEC, "label").count() == n
    assert column(P.drop_short_runs(df, SPEC, "label", 3), "kept") == (labels if len(labels) != 1 else [0])


def test_gap_fill_is_monotone_and_idempotent(spark):
    rng = np.random.default_rng(3)
    labels = (rng.random(300) < .15).astype(int).tolist()
    df = frame(spark, range(300), labels)
    before = np.array(labels)
    for g in (1, 3, 8):
        once = P.fill_gaps(df, SPEC, "label", g)
        now = np.array(column(once, "filled"))
        again = np.array(column(P.fill_gaps(once.drop("label").withColumnRenamed("filled", "label"), SPEC, "label", g), "filled"))
        assert (now >= before).all() and (now == again).all()
        before = now


def test_two_sample_and_ranking_metrics(spark):
    df = frame(spark, [1, 2, 3, 2, 3, 4], [0, 0, 0, 1, 1, 1])
    r = D.two_sample(df, ["x"], F.col("label") == 1).first()
    assert abs(r.ks - 1 / 3) < 1e-12 and r.u == 2
    df = frame(spark, [.1, .4, .35, .8], [0, 0, 1, 1])
    assert abs(E.roc_auc(df, "label", "x").first()[0] - .75) < 1e-12
    assert abs(E.average_precision(df, "label", "x").first()["average_precision"] - .833333) < 1e-6


def test_auc_ignores_monotone_maps(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, rng.random(200), (rng.random(200) < .3).astype(int))
    a = E.roc_auc(df, "label", "x").first()[0]
    b = E.roc_auc(df.withColumn("x", F.exp(3 * F.col("x"))), "label", "x").first()[0]
    assert abs(a - b) < 1e-12


def test_zero_division_is_zero(spark):
    r = E.scores(E.confusion(frame(spark, [1, 2], [0, 0]).withColumn("p", F.lit(0)), "label", "p")).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0, 0, 0, 1)


def test_tail_moments_formula(spark):
    # position .98 * 150 = 147 is the last of 148 zeros, so the peaks are 1, 2, 3
    df = frame(spark, [0] * 148 + [1, 2, 3])
    r = D.tail_fit_moments(df, "x").first()
    assert (r.t, r.n_peaks) == (0, 3) and abs(r.gamma + .071429) < 1e-6 and abs(r.sigma - 1.857143) < 1e-6


def test_plateau_counts_once_at_its_middle(spark):
    df = frame(spark, [0, 1, 3, 5, 7, 8, 8])  # |step|: 1 2 2 2 1 0
    out = D.changepoint_peaks(df, SPEC, 0).collect()
    assert [(r.idx, r.step) for r in out] == [(3, 2.0)]


def test_fill_policies(spark):
    df = frame(spark, [N, 1, N, N, 4, N])
    assert column(C.fill_along(df, SPEC, ["x"]), "x") == [1, 1, 1, 1, 4, 4]
    assert column(C.fill_along(df, SPEC, ["x"], backward=False, rest=0.0), "x") == [0, 1, 1, 1, 4, 4]
    assert column(C.null_infinities(frame(spark, [1, float("inf"), float("-inf"), float("nan")]), ["x"]), "x") == [1, N, N, N]


def test_histogram_edges_and_constant_column(spark):
    df = frame(spark, [0, 5, 10])
    assert {(r.bin, r.n) for r in G.histogram(df, "x", 2).collect()} == {(0, 1), (1, 2)}
    assert [r.n for r in G.histogram(frame(spark, [7, 7]), "x", 4).collect()] == [2]


def test_parse_answer_fallbacks(spark):
    rows = [("ANOMALY_DETECTED: true; START_POINT: 2024-01-01 00:00:05; END_POINT: late; REASON: spike ",), ("ANOMALY_DETECTED: false; REASON: none",), ("ANOMALY_DETECTED: true",)]
    df = spark.createDataFrame(rows, "t string").withColumn("a", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")).withColumn("b", F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'"))
    r = X.parse_answer(df, "t", "a", "b").collect()
    assert (r[0].is_anomaly, str(r[0].anomaly_start), str(r[0].anomaly_end), r[0].reason) == (1, "2024-01-01 00:00:05", "2024-01-02 00:00:00", "spike")
    assert (r[1].is_anomaly, r[1].anomaly_start, r[1].reason) == (0, N, N)
    assert (r[2].is_anomaly, r[2].anomaly_start, r[2].reason) == (1, N, N)


def test_normal_quantile_and_p_values(spark):
    df = spark.createDataFrame([(.5,), (.975,)], "p double").select(X.normal_quantile("p").alias("z"))
    close([r.z for r in df.collect()], [0, 1.959964])
    z = spark.createDataFrame([(1.959964,)], "z double").select(X.normal_two_sided("z").alias("p")).first().p
    assert math.isclose(z, .05, rel_tol=1e-5)
