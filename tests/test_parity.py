"""Operators without SQL form against plain numpy or pandas on small inputs."""

import numpy as np
import pandas as pd
import pytest
from helpers import SPEC, as_list, close, column, frame
from pyspark.sql import functions as F

from tidemark import with_features
from tidemark.functions import rolling as R
from tidemark.functions import smoothing as S
from tidemark.functions.expanding import expanding_quantile
from tidemark.functions.wavelets import WAVELETS, analysis_filters
from tidemark.operators import detect as D
from tidemark.operators import models as M
from tidemark.operators import neighbours as N
from tidemark.operators import signals as G
from tidemark.operators import windows as W
from tidemark.sources import tables as T
from tidemark.streaming.state import fit_tail

rng = np.random.default_rng(11)
X = np.round(rng.gamma(2, 20, 260), 2)


def test_pandas_semantics_with_missing_values(spark):
    x = pd.Series(np.where(rng.random(260) < .15, np.nan, X))
    f = {"m": R.rolling_mean("x", 20, 5), "sd": R.rolling_std("x", 20, 5), "sk": R.rolling_skew("x", 20, 5), "ku": R.rolling_kurt("x", 20, 6), "long": R.rolling_quantile("x", 150, .3, 10),
         "es": S.ewm_std("x", .1), "ea": S.ewm_std("x", .3, True), "ex": expanding_quantile("x", .1, 30), "rank": R.rolling_rank("x", 20, 1), "d": R.diff("x", 3)}
    got = with_features(frame(spark, as_list(x)), SPEC, f).orderBy("id").collect()
    r = x.rolling(20, min_periods=5)
    want = {"m": r.mean(), "sd": r.std(), "sk": r.skew(), "ku": x.rolling(20, min_periods=6).kurt(), "long": x.rolling(150, min_periods=10).quantile(.3), "es": x.ewm(alpha=.1, adjust=False).std(),
            "ea": x.ewm(alpha=.3).std(), "ex": x.expanding(30).quantile(.1), "d": x.diff(3)}
    for n, w in want.items():
        close([g[n] for g in got], as_list(w))


def test_long_windows_agree_with_short_code_path(spark, monkeypatch):
    make = {"mean": R.rolling_mean, "std": R.rolling_std, "min": R.rolling_min, "max": R.rolling_max, "range": R.rolling_range, "skew": R.rolling_skew, "kurt": R.rolling_kurt, "iqr": R.rolling_iqr, "z": R.rolling_z}
    def values():
        f = {n: fn("x", 40, 6) for n, fn in make.items()} | {"bs": R.rolling_skew("x", 40, 6, bias=True), "bk": R.rolling_kurt("x", 40, 6, bias=True)}
        return f, with_features(frame(spark, X), SPEC, f).orderBy("id").collect()
    monkeypatch.setattr(R, "NATIVE_COSTLY_ROWS", 120)
    f, native = values()
    monkeypatch.setattr(R, "NATIVE_ROWS", 10)
    monkeypatch.setattr(R, "NATIVE_COSTLY_ROWS", 10)
    _, moving = values()
    for n in f:
        close([r[n] for r in moving], [r[n] for r in native])


def test_butterworth_is_zero_phase_low_pass(spark):
    b, a = S.butterworth(4, .1)
    close(b.tolist(), [0.00041660, 0.00166640, 0.00249960, 0.00166640, 0.00041660], 1e-3)
    close(a.tolist(), [1, -3.18063855, 3.86119435, -2.11215536, .43826514], 1e-6)
    slow = np.sin(np.arange(260) * .02)
    got = np.array(column(with_features(frame(spark, slow + .3 * np.sin(np.arange(260) * 2.5)), SPEC, {"y": S.butterworth_smooth("x")}), "y"))
    assert np.abs(got - slow)[20:-20].max() < .01


@pytest.mark.parametrize("pad", [False, True])
def test_savgol_reproduces_cubics(spark, pad):
    t = np.arange(60) / 10
    y = t ** 3 - 2 * t
    got = np.array(column(with_features(frame(spark, y), SPEC, {"y": S.savgol("x", 15, pad_left=pad)}), "y"))
    assert np.abs(got - y)[15:].max() < 1e-8


@pytest.mark.parametrize("name", WAVELETS)
def test_wavelets_rebuild_the_window(spark, name):
    low, high = analysis_filters(name)
    assert abs(low.sum() - np.sqrt(2)) < 1e-9 and abs(high.sum()) < 1e-9
    w = W.sliding_windows(frame(spark, X), SPEC, 100, 50)
    back = G.wavelet_reconstruct(G.wavelet_coefficients(w, 100, name), 100, name).collect()
    for r in back:
        close(r["rebuilt"], r["values"], 1e-9)


def test_wavelet_features_of_one_window(spark):
    w = W.sliding_windows(frame(spark, X), SPEC, 100, 50)
    c = G.wavelet_coefficients(w, 100).orderBy("win").first()
    f = G.wavelet_features(w, 100, keep=["win"]).orderBy("win").first()
    d = np.array(c["detail_2"])
    hist, _ = np.histogram(d, bins=50, density=True)
    hist = hist[hist > 0]
    close([f.detail_2_energy, f.detail_2_std, f.detail_2_entropy, f.detail_2_max, f.detail_2_zero_crossings],
          [(d ** 2).sum(), d.std(), -(hist * np.log2(hist + 1e-10)).sum(), np.abs(d).max(), float((np.diff(np.sign(d)) != 0).sum())])
    assert abs(sum(f[f"detail_{i}_energy_ratio"] for i in range(1, 5)) + f.approx_energy_ratio - 1) < 1e-12


def test_spectrum_finds_the_frequency(spark):
    df = frame(spark, np.sin(2 * np.pi * np.arange(512) / 16))
    top = G.segment_spectrum(df, SPEC, 256).filter("bin > 0").orderBy(F.desc("amplitude")).first()
    assert abs(top.frequency - 1 / 16) < 1e-9 and abs(top.amplitude - 1) < 1e-9
    assert abs(G.welch(df, SPEC, 128).orderBy(F.desc("density")).first().frequency - 1 / 16) < 1e-9
    assert G.segment_spectrum(frame(spark, range(300)), SPEC, 256).select("segment").distinct().count() == 2


def test_tail_fit_recovers_the_shape(spark):
    u = np.random.default_rng(5).random(4000)
    y = (u ** -.2 - 1) / .2 * 2  # generalised Pareto, shape .2, scale 2
    r = D.tail_fit_likelihood(frame(spark, y), "x", q=1e-3, pct=50).first()
    peaks = y[y > np.quantile(y, .5)] - np.quantile(y, .5)
    shape, scale = fit_tail(peaks)
    close([r.gamma, r.sigma], [shape, scale], 1e-3)
    assert abs(r.gamma - .2) < .08 and abs(r.z_q - np.quantile(y, .999)) / r.z_q < .25


def test_planted_outliers_rank_first(spark):
    x = np.random.default_rng(9).normal(0, 1, (400, 2))
    x[:4] = [[9, 9], [-9, 9], [9, -9], [-10, -9]]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    iso = M.isolation_outliers(df, ["a", "b"], "id", .05, trees=50, sample=128)
    assert {r.id for r in iso.orderBy(F.desc("isolation")).limit(4).collect()} == {0, 1, 2, 3}
    assert iso.agg(F.sum("outlier")).first()[0] == 20
    lof = N.local_outlier_factor(df, ["a", "b"], 20)
    assert {r.id for r in lof.orderBy(F.desc("lof")).limit(4).collect()} == {0, 1, 2, 3}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) + np.diag([np.inf] * 400)
    near = np.argsort(d, 1)[:, :20]
    dist = np.take_along_axis(d, near, 1)
    lrd = 1 / (np.maximum(dist, dist.max(1)[near]).mean(1) + 1e-10)
    close(column(lof, "lof"), (lrd[near].mean(1) / lrd).tolist(), 1e-6)


def test_user_model_sees_ordered_blocks(spark):
    seq = W.sequences(frame(spark, range(12)), SPEC, 5, ["x"])
    got = column(M.score_sequences(seq, ["x"], lambda block: block[:, -1, 0] - block[:, 0, 0]), "score")
    assert got == [4.0] * 8


def test_model_round_trip_and_batch_scoring(spark, tmp_path):
    x = np.random.default_rng(1).normal(0, 1, 400)
    df = frame(spark, x, (np.abs(x) > 1).astype(int)).withColumn("size", F.abs("x"))
    model = M.train_boosted(M.class_weights(df, "label"), ["size"], "label", "weight", maxIter=5)
    M.save_artifacts(str(tmp_path), model, spark.createDataFrame([(["size"], .5)], "features array<string>, threshold double"))
    loaded, params = M.load_artifacts(spark, str(tmp_path))
    p = params.first()
    out = M.score_batch(df, SPEC, loaded, p.features, p.threshold, gap=0)
    assert out.filter("anomaly_prediction != label").count() == 0
    T.write_table(out.select("s", "id", "anomaly_probability"), str(tmp_path / "csv"), "csv", ["s"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 400


def test_csv_sources(spark, tmp_path):
    df = frame(spark, [1, 2, 3]).select(F.col("ts").alias(T.PRODUCTION_TIME), F.col("x").alias(T.PRODUCTION_VALUE))
    T.write_table(df, str(tmp_path / "a"), "csv")
    T.write_table(df, str(tmp_path / "b"), "csv")
    got = T.read_csv(spark, [str(tmp_path / "a"), str(tmp_path / "b")], df.schema, [T.PRODUCTION_VALUE])
    assert sorted(r.speed for r in T.first_present(got, [T.PRODUCTION_VALUE], "speed").collect()) == [1, 1, 2, 2, 3, 3]
    T.write_summary(df.agg(F.max(f"`{T.PRODUCTION_VALUE}`").alias("top")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().top == 3


def test_rows_with_missing_values_are_kept(spark):
    """A projection and a forecast learn from complete rows, keep the others, and give these NULL."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (60, 2)) @ np.array([[2, 1], [0, .3]])
    df = spark.createDataFrame([(i, None if i == 7 else float(a), float("nan") if i == 9 else float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    out, shares = M.project(df, ["a", "b"], 2)
    got = {r["id"]: r["pc1"] for r in out.collect()}
    assert len(got) == 60 and {i for i, v in got.items() if v is None} == {7, 9} and abs(sum(shares) - 1) < 1e-9
    known = np.delete(x, [7, 9], 0)
    z = (known - known.mean(0)) / known.std(0)
    axis = np.linalg.svd(z)[2][0]
    close(sorted(abs(v) for v in got.values() if v is not None), sorted(np.abs(z @ axis).tolist()), 1e-6)
    values = [float(v) for v in np.sin(np.arange(80) / 3) + rng.normal(0, .1, 80)]
    values[40] = None
    rows = M.forecast_error(frame(spark, values), SPEC, 5).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(5, 80))
    assert {r["id"] for r in rows if r["forecast"] is None} == set(range(41, 46)) and {r["id"] for r in rows if r["error"] is None} == set(range(40, 46))
