"""Python sees a row once, in pieces whose size doesn't grow with the series or the number of features."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from helpers import SPEC, close, events, frame
from pyspark.sql import functions as F

from tidemark import with_features
from tidemark.functions import rolling as R
from tidemark.functions.expanding import expanding_quantile
from tidemark.operators import clean as C
from tidemark.plans import presets
from tidemark.plans.features import Feature, carry_last, chunk_size


def test_expanding_quantiles_share_one_pass(spark):
    df, spec = events(spark), SPEC.chunked(60, 9)
    f = {"lo": expanding_quantile("x", .1, 20), "hi": expanding_quantile("x", .9, 30)}
    got = with_features(df, spec, {"sd": R.rolling_std("x", 150, 5), **f})
    assert got._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInPandas") == 1
    a, b = (g.orderBy("id").collect() for g in (with_features(df, SPEC, f), got))
    for n in f:
        close([r[n] for r in b], [r[n] for r in a], 1e-9)


def test_carried_columns_compute_their_inputs_once(spark):
    """A scan of a chunked layout reads its rows twice; a pass through Python before it runs once all the same."""
    seen = spark.sparkContext.accumulator(0)

    def twice(pdf):
        seen.add(len(pdf))
        return pdf["x"] * 2

    df = frame(spark, range(300))
    f = {"t": Feature(twice, ("x",), kind="pandas"), "odd": carry_last(F.when(F.col("t") % 4 == 2, F.col("t")), "t"), **C.filled_along(["t"])}
    out = with_features(df, SPEC.chunked(60, 9), f).orderBy("id").collect()
    assert [r["odd"] for r in out] == [None if i == 0 else float(2 * (i - 1 + i % 2)) for i in range(300)]
    assert 300 <= seen.value < 400  # cells that straddle two chunks are sent to both


@pytest.mark.parametrize("name", ["residual", "spectral"])
def test_presets_fill_alike_in_chunks(spark, name):
    df = events(spark).filter("s in ('view', 'error')").withColumn("x", F.when(F.col("id") % 9 > 0, F.col("x")))
    options = {"period": 6} if name == "residual" else {"w": 6}
    a, b = (presets.build(df, spec, name, **options) for spec in (SPEC, SPEC.chunked(90, 20)))
    assert a[1] == b[1] and a[0].columns == b[0].columns
    a, b, names = a[0].orderBy("id").collect(), b[0].orderBy("id").collect(), a[1]
    for n in names:
        close([r[n] for r in b], [r[n] for r in a], 1e-7)


def test_many_columns_make_smaller_chunks(spark):
    df, spec = events(spark), replace(SPEC, mode="auto")
    few, many = ({f"q{i}": R.rolling_quantile("x", 60, i / 100) for i in range(n)} for n in (2, 90))
    assert chunk_size(df, spec, {"m": R.rolling_mean("x", 60)}) == spec.chunk_rows
    assert chunk_size(df, spec, many) == 5 * spec.cell_rows < chunk_size(df, spec, few) == 2 ** 19 // 7
    assert chunk_size(df, spec, {**many, "long": R.rolling_std("x", 20_000)}) >= 8 * 19_999


def test_deviations_from_ordered_windows():
    rng = np.random.default_rng(3)
    x = np.round(rng.random(900) * 20, 1)
    x[rng.random(900) < .2] = np.nan
    for v in (x, np.round(x / 9), np.where(rng.random(900) < .5, 1e9, x), np.append(x, np.inf)):
        for w in (1, 2, 7, 60, 301):
            for m in (1, w):
                pdf = pd.DataFrame({"x": v})
                want = R._by_window("x", w, m, lambda b: R.row_medians(np.abs(b - R.row_medians(b)[:, None])))
                assert R.rolling_mad("x", w, m).build(pdf).equals(want.build(pdf))


def test_window_matrices_are_bounded():
    assert max(b.size for _, b in R.trailing_windows(np.arange(20_000.), 1800)) <= R.BLOCK_VALUES


def test_training_and_scoring_read_features_that_are_computed_once(spark, tmp_path):
    from catalog.splits_models import temporal_model
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], float(v), '{"k": %d}' % (i % 100)) for i, v in enumerate(rng.random(400))]
    df = spark.createDataFrame(rows, "event_id bigint, event_type string, value double, props string")
    df = df.selectExpr("event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id) AS ts", "event_id % 7 AS user_id", "event_type", "value", "props")
    df.write.parquet(f"{tmp_path}/events.parquet")
    model, later = temporal_model(spark, str(tmp_path))
    plan = later._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Relation" not in plan
    assert later.count() == 120 and model.stages[-1].getNumTrees == 8
