"""Chunked and whole layouts must agree, whatever the chunk size, and nothing may look ahead."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from helpers import SPEC, close, events, frame
from pyspark.sql import functions as F

from tidemark import SeriesSpec, index_rows, with_features
from tidemark.functions import rolling as R
from tidemark.functions import smoothing as S
from tidemark.functions.expanding import expanding_quantile
from tidemark.operators import runs as P
from tidemark.operators import windows as W
from tidemark.plans import presets
from tidemark.plans.features import carry_last, carry_next, causal_only, running_sum, with_features as build
from tidemark.plans.series import lay_out


GROUPS = {
    "frames": lambda: {"mean": R.rolling_mean("x", 30, 1), "z": R.rolling_z("x", 30, 2), "q": R.rolling_quantile("x", 20, .25), "nested": R.rolling_mean("z", 10, 1), "lag": R.lag("x", 7),
                       "lead": R.lead("x", 3), "centre": R.centred_mean("x", 12), "slope": R.rolling_slope("x", 10), **R.cusum_windowed("x", 20), **S.causal_decompose("x", 12),
                       **P.filled("label", 4, "filled"), **P.long_runs("label", 2, "kept")},
    "batches": lambda: {"long": R.rolling_std("x", 150, 5), "mad": R.rolling_mad("x", 25, 1), "ema": S.ewm_mean("x", .3), "esd": S.ewm_std("x", .1), "smooth": S.savgol("x", 15),
                        "bw": S.butterworth_smooth("x"), "kalman": S.kalman_level("x"), "again": R.rolling_mean("ema", 9, 1)},
    "scans": lambda: {"total": running_sum(F.col("x"), "x"), "last": carry_last(F.when(F.col("x") > 80, F.col("x")), "x"), "next": carry_next(F.when(F.col("x") > 80, F.col("x")), "x"),
                      **R.cusum_unbounded("x", 20), **W.consecutive_counter("label", "streak")},
    "long": lambda: {"mean": R.rolling_mean("x", 150, 5), "sum": R.rolling_sum("id", 130, 1), "n": R.rolling_count("x", 140), "lo": R.rolling_min("x", 125, 1), "hi": R.rolling_max("mean", 160), "twice": R.rolling_mean("mean", 121, 1),
                     **P.filled("label", 130, "filled")},
    "expanding": lambda: {"expanding": expanding_quantile("x", .9, 20)},
}


@pytest.mark.parametrize("group", list(GROUPS))
@pytest.mark.parametrize("chunk, cell", [(40, 7), (97, 500)])
def test_chunked_equals_whole(spark, group, chunk, cell):
    df = events(spark).filter("s in ('view', 'error')")
    f = GROUPS[group]()
    shown = [n for n in f if not n.startswith("_")] + ["idx"]
    a = build(df, SPEC, f, index=True).orderBy("id").select("id", *shown).collect()
    b = build(df, SPEC.chunked(chunk, cell), f, index=True).orderBy("id").select("id", *shown).collect()
    assert [r.id for r in a] == [r.id for r in b]
    for n in shown:
        close([r[n] for r in b], [r[n] for r in a], 1e-8)


RECURSIVE = {
    "ewm": lambda: {"e": S.ewm_mean("x", .05), "slow": S.ewm_mean("x", 1e-5), "adj": S.ewm_mean("x", .001, True), "sd": S.ewm_std("x", .02), "sd_slow": S.ewm_std("x", 1e-4, True),
                    "twice": S.ewm_mean("slow", .2), "near": R.rolling_mean("twice", 9, 1), **S.derivatives("x", .01)},
    "kalman": lambda: {"k": S.kalman_level("x"), "slow": S.kalman_level("x", process=1e-10), "quick": S.kalman_level("x", process=1.), "last": R.lag("slow", 3)},
    "filters": lambda: {"bw": S.butterworth_smooth("x"), "low": S.butterworth_smooth("x", 4, .02), "sg": S.savgol("x", 15), "sg_left": S.savgol("x", 15, pad_left=True)},
}


@pytest.mark.parametrize("group", list(RECURSIVE))
@pytest.mark.parametrize("keys", [("s",), ()])
def test_carried_state_over_gaps_and_bursts(spark, group, keys):
    """Long gaps (also at the start), a burst at one instant, a far level: the cut must not show."""
    rng = np.random.default_rng(7)
    t0, rows = dt.datetime(2024, 1, 1), []
    for name, n in (("a", 900), (None, 130), ("b", 3)):
        for i in range(n):
            gap = i < 60 or 200 <= i < 420 or (i > 700 and i % 3)
            rows.append((name, t0 + dt.timedelta(seconds=min(i, 500) + max(0, i - 600)), len(rows), None if gap and name else float(1e4 + 5 * rng.standard_normal() + i / 50)))
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, id bigint, x double")
    if not keys:
        df = df.filter("s = 'a'")
    f = RECURSIVE[group]()
    shown = [n for n in f if not n.startswith("_")]
    a = with_features(df, SPEC, f).orderBy("id").collect()
    b = with_features(df, replace(SPEC.chunked(70, 9), keys=keys), f).orderBy("id").collect()
    assert [r.id for r in a] == [r.id for r in b] and len(a[0]) == len(b[0]) == 4 + len(shown)
    for n in shown:
        assert any(r[n] is not None for r in a)
        close([r[n] for r in b], [r[n] for r in a], 1e-9)


def test_one_series_without_keys(spark):
    df = events(spark)
    spec = SeriesSpec((), "ts", ("id",), "x").chunked(64, 5)
    got = with_features(df, spec, {"m": R.rolling_mean("x", 50, 1), "t": running_sum(F.col("x"), "x")}, index=True).toPandas().sort_values(["ts", "id"])
    assert (got["idx"].to_numpy() == np.arange(len(got))).all()
    assert np.allclose(got["m"], got["x"].rolling(50, min_periods=1).mean()) and np.allclose(got["t"], got["x"].cumsum())


def test_burst_in_one_cell_and_equal_times(spark):
    """Most rows share a few instants, so one cell is far larger than a chunk."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=i), i, float(i % 11)) for i in range(60)]
    rows += [("a", t0 + dt.timedelta(hours=30), 100 + i, float(i % 7)) for i in range(400)]
    rows += [("b", t0, 1000, 1.0), (None, t0, 1001, 2.0), (None, t0 + dt.timedelta(hours=1), 1002, 4.0)]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, id bigint, x double")
    f = {"m": R.rolling_mean("x", 90, 1), "ahead": R.lead("x", 80), "t": running_sum(F.col("x"), "x")}
    a = with_features(df, SPEC, f, index=True).orderBy("id").collect()
    b = with_features(df, replace(SPEC.chunked(50, 5)), f, index=True).orderBy("id").collect()
    assert len(a) == len(b) == len(rows)
    for n in ("idx", "m", "ahead", "t"):
        close([r[n] for r in b], [r[n] for r in a], 1e-9)


def test_halo_must_cover_carried_columns(spark):
    bad = {"c": carry_last(F.col("x"), "x"), "m": R.rolling_mean("c", 5)}
    with pytest.raises(ValueError):
        with_features(frame(spark, range(5)), SPEC, bad)


def test_causal_features_ignore_the_future(spark):
    """Changing later rows must not change any causal feature of earlier rows."""
    rng = np.random.default_rng(5)
    x = rng.random(120) * 50
    y = x.copy()
    y[80:] = rng.random(40) * 500
    for name in ("baseline", "pattern", "exploration"):
        f = causal_only(presets.BUILDERS[name]("x"))
        shown = [n for n in f if not n.startswith("_")]
        a, b = (with_features(frame(spark, v), SPEC, f).filter("id < 80").orderBy("id").select(*shown).collect() for v in (x, y))
        for n in shown:
            close([r[n] for r in a], [r[n] for r in b], 1e-9)


def test_non_causal_preset_columns_are_dropped(spark):
    df = frame(spark, range(50))
    _, causal = presets.build(df, SPEC, "robust", causal=True, fill=False)
    _, full = presets.build(df, SPEC, "robust", causal=False, fill=False)
    assert {"local_min", "local_max"} <= set(full) - set(causal)


def test_large_series_are_chunked_and_small_ones_are_not(spark):
    df = events(spark)
    auto = replace(SPEC, mode="auto")
    assert not lay_out(df, auto).is_chunked
    assert lay_out(df, replace(auto, chunk_rows=50)).is_chunked
    assert lay_out(df, replace(auto, keys=())).is_chunked


def test_plans_have_no_single_partition_data_shuffle(spark):
    """Only the tables of block totals may meet in one partition; rows of the series never do."""
    spec = SeriesSpec((), "ts", ("id",), "x").chunked(100, 10)
    plan = with_features(events(spark), spec, {"m": R.rolling_mean("x", 10, 1)})._jdf.queryExecution().executedPlan().toString()
    for at, line in enumerate(plan.splitlines()):
        if "SinglePartition" in line:
            assert "HashAggregate" in plan.splitlines()[at + 1], plan
    keyed = with_features(events(spark), SPEC, {"m": R.rolling_mean("x", 10, 1), "z": R.rolling_z("x", 20, 2)})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in keyed and keyed.count("Exchange hashpartitioning") == 1


def test_index_is_dense_with_a_hot_series(spark):
    df = events(spark).withColumn("s", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("s")))
    got = index_rows(df, SPEC.chunked(60, 8)).groupBy("s").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.max("idx").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in got)


@pytest.mark.parametrize("ties", ["distinct", "equal", "text"])
def test_bursts_are_split(spark, ties):
    """Nearly all rows at one instant: chunks stay small, and nothing changes but the order of rows equal in everything."""
    n, t0 = 6001, dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(days=i == n - 1, microseconds=i // 4000), 5 if ties == "equal" else (i * 7919) % n, float(i % 97)) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, id bigint, x double")
    if ties == "text":
        df = df.withColumn("id", F.format_string("k%06d", "id"))
    spec = SPEC.chunked(1000, 150)
    laid = lay_out(df, spec, back=20, fwd=20)
    sizes = [r["count"] for r in laid.df.groupBy(*laid.part).count().collect()]
    cell = 2 * spec.cell_rows
    assert max(sizes) <= 1000 + 40 + 3 * cell and sum(sizes) <= n + len(sizes) * (40 + 2 * cell) and len(sizes) >= 5
    f = {"m": R.rolling_mean("x", 9, 1), "next": R.lead("x", 2), "ema": S.ewm_mean("x", .3)}
    got = with_features(df, spec, f, index=True)
    assert sorted(r["idx"] for r in got.select("idx").collect()) == list(range(n)) and set(got.columns) == {*df.columns, *f, "idx"}
    if ties != "equal":
        a, b = (x.orderBy("id").select("idx", *f).collect() for x in (with_features(df, SPEC, f, index=True), got))
        for c in ("idx", *f):
            close([r[c] for r in b], [r[c] for r in a], 1e-9)
