"""Several micro-batches must give what one batch gives."""

import numpy as np
import pandas as pd
import pytest
from helpers import SPEC, close, events, frame
from pyspark.sql import functions as F

from tidemark import SeriesSpec, with_features
from tidemark.functions import smoothing as S
from tidemark.functions.rolling import rolling_mean
from tidemark.operators.runs import fill_gaps, run_intervals
from tidemark.sources.tables import replay
from tidemark.streaming import state as ST


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events in five files, in time order."""
    path = str(tmp_path_factory.mktemp("events"))
    rows = events(spark).orderBy("ts", "id").toPandas()
    for i, part in enumerate(np.array_split(np.arange(len(rows)), 5)):
        spark.createDataFrame(rows.iloc[part], events(spark).schema).coalesce(1).write.mode("append").parquet(path)
        assert i < 5
    return path


def stream(spark, folder):
    return replay(spark, folder, events(spark).schema)


def test_features_do_not_depend_on_batches(spark, folder):
    f = {"m": ST.moving("mean", "x", 20, 1), "e": S.ewm_mean("x", .3), **ST.decompose("x", 8)}
    got = ST.run_available(ST.stream_features(stream(spark, folder), SPEC, f), "t").orderBy("id").collect()
    want = with_features(events(spark), SPEC, {"m": rolling_mean("x", 20, 1), "e": S.ewm_mean("x", .3), **S.causal_decompose("x", 8)}).orderBy("id").collect()
    for n in ("m", "e", "trend", "residual"):
        close([r[n] for r in got], [r[n] for r in want], 1e-8)


def test_intervals_and_totals(spark, folder):
    alarms = stream(spark, folder).withColumn("f", (F.col("x") > 90).cast("int"))
    got = {tuple(r) for r in ST.run_available(ST.stream_intervals(alarms, SPEC, "f", 3), "i").collect()}
    batch = events(spark).withColumn("f", (F.col("x") > 90).cast("int"))
    want = run_intervals(fill_gaps(batch, SPEC, "f", 3, "g"), SPEC, "g").select("s", "start_idx", "end_idx", "n")
    sizes = {r.s: r.n for r in batch.groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert got == {tuple(r) for r in want.collect() if sizes[r.s] - 1 - r.end_idx > 3}
    totals = {r.s: r.points for r in ST.run_available(ST.running_totals(alarms, ["s"], "f"), "r", "complete").collect()}
    assert totals == sizes


def test_scores_are_null_until_warm(spark, folder):
    got = ST.run_available(ST.score_points(stream(spark, folder), SPEC, lambda w: float(w[-1] > w[:-1].max()), 30, .5), "s")
    assert got.filter("idx < 29 and (score is not null or alarm = 1)").count() == 0
    assert got.filter("idx >= 29 and score is null").count() == 0


def test_tail_threshold_against_a_plain_loop(spark, folder):
    got = ST.run_available(ST.stream_tail_threshold(stream(spark, folder), SPEC, q=.02, first=100, pct=90), "q")
    for s, part in events(spark).toPandas().sort_values(["ts", "id"]).groupby("s"):
        x = part["x"].to_numpy()
        level = np.percentile(x[:100], 90)
        peaks = [v - level for v in x[:100] if v > level]
        limit = ST.tail_quantile(level, *ST.fit_tail(np.array(peaks)), .02, 100, len(peaks))
        alarms = 0
        for n, v in enumerate(x[100:], 101):
            if v > limit:
                alarms += 1
            elif v > level:
                peaks.append(v - level)
                limit = ST.tail_quantile(level, *ST.fit_tail(np.array(peaks)), .02, n, len(peaks))
        mine = got.filter(F.col("s") == s)
        assert mine.agg(F.sum("alarm")).first()[0] == alarms
        assert abs(mine.orderBy(F.desc("ts")).first().threshold - limit) < 2e-4 * limit


def test_a_run_continues_and_a_reset_starts_over(spark, folder):
    def features():
        return ST.stream_features(stream(spark, folder), SPEC, {"n": ST.moving("count", "x", 5, 1)})

    run = ST.fresh_run(spark, "again")
    once = ST.run_available(features(), "again", run=run).count()
    assert ST.run_available(features(), "again", run=run).count() == once
    assert ST.run_available(features(), "again").count() == once


def test_tail_summary_is_small_exact_in_the_mean_and_mergeable():
    rng = np.random.default_rng(3)
    for y in (rng.exponential(3, 5000), (rng.random(5000) ** -.2 - 1) / .2 * 2, rng.random(400) * 1e-6, np.array([1., 1., 4.])):
        whole, left, right = ST.Tail(), ST.Tail(), ST.Tail()
        whole.add(y)
        left.add(y[: len(y) // 3])
        right.add(y[len(y) // 3:])
        both = left.merge(right)
        assert both.n == len(y) and (both.counts == whole.counts).all() and np.allclose(both.sums, whole.sums)
        assert len(whole.counts) == ST.Tail.STEPS * ST.Tail.OCTAVES and abs(whole.sums.sum() / y.sum() - 1) < 1e-12
        used = whole.counts > 0
        assert abs(np.average(np.log(whole.sums[used] / whole.counts[used]), weights=whole.counts[used]) - np.log(y).mean()) < 2e-5
        if len(y) > 1000:
            want, got = ST.fit_tail(y), whole.fit()
            assert abs(want[0] - got[0]) < 2e-3 and abs(want[1] - got[1]) < 2e-3 * want[1]


def test_late_rows_wait_for_the_watermark(spark, tmp_path):
    """Six files whose rows overlap in time: results are those of one batch up to the last watermark, and no row is lost."""
    rows = events(spark).toPandas()
    shown = rows["ts"].astype("int64") + (rows["id"] * 7919 % 86_400) * (rows["ts"].astype("int64").max() - rows["ts"].astype("int64").min()) // 86_400 // 10
    for _, part in rows.groupby(np.minimum(5, (shown - shown.min()) * 6 // (shown.max() - shown.min() + 1))):
        spark.createDataFrame(part.sample(frac=1, random_state=1), events(spark).schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    late = f"{int((rows['ts'].max() - rows['ts'].min()).total_seconds() / 9)} seconds"
    f = {"m": ST.moving("mean", "x", 20, 1), "e": S.ewm_mean("x", .3)}
    got, dropped = ST.run_counted(ST.stream_features(stream(spark, str(tmp_path)), SPEC, f, late=late), "late")
    got = got.orderBy("id").toPandas().set_index("id")
    want = with_features(events(spark), SPEC, {"m": rolling_mean("x", 20, 1), "e": S.ewm_mean("x", .3)}, index=True).toPandas().set_index("id")
    passed = want[want["ts"] <= want["ts"].max() - (rows["ts"].max() - rows["ts"].min()) / 8.9]
    assert dropped == 0 and len(passed) > 700 and set(passed.index) <= set(got.index)
    for c in ("idx", "m", "e"):
        close(got[c].tolist(), want.loc[got.index, c].tolist(), 1e-9)
    with pytest.raises(ValueError):
        ST.stream_intervals(stream(spark, str(tmp_path)), SPEC, "label", 3, idle_ms=10, late=late)


@pytest.fixture
def short_batches(spark):
    """A hundred rows go to Python at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "100")
    yield 100
    spark.conf.set(name, before)


@pytest.mark.parametrize("late", [None, "1 second"])
def test_python_holds_a_batch_of_rows_not_the_micro_batch(spark, tmp_path, short_batches, late):
    """One file in random order, with a long run of missing values that ends of batches fall into."""
    n = 1500
    rng = np.random.default_rng(5)
    x = [None if 290 <= i < 950 or i % 7 == 3 else float(v) for i, v in enumerate(rng.random(n))]
    rows = frame(spark, x).unionByName(frame(spark, x[:40], name="b", first_id=n))
    rows.orderBy(F.xxhash64("id")).coalesce(1).write.mode("append").parquet(str(tmp_path))
    whole = {"e": S.ewm_mean("x", .3), "m": ST.moving("mean", "x", 20, 1)}
    held = {"held": ST.combine(lambda p: p["x"] * 0 + len(p), "x")}
    source = replay(spark, str(tmp_path), rows.schema)
    got = ST.run_available(ST.stream_features(source, SPEC, {**whole, **held}, late=late), "short").toPandas().sort_values("id")
    want = with_features(rows, SPEC, {"e": S.ewm_mean("x", .3), "m": rolling_mean("x", 20, 1)}, index=True).toPandas().set_index("id")
    assert late or len(got) == n + 40
    assert len(got) > n and not got["id"].duplicated().any()
    assert late or got["held"].max() <= short_batches + 2 * 200  # rows that waited come from the state, not from a batch
    for c in ("idx", "e", "m"):
        close([None if v != v else v for v in got[c]], [None if v != v else v for v in want.loc[got["id"], c]], 1e-9)
    assert spark.conf.get(ST.CHECKED) == "true"


def test_rows_held_back_are_merged_with_later_batches():
    import pandas as pd
    at = lambda ids, secs: pd.DataFrame({"id": ids, "ts": pd.to_datetime(secs, unit="s")})
    held = at([1, 9, 3, 4], [10, 20, 20, 50]).sort_values(["ts", "id"])
    got = list(ST._in_order(iter([at([0, 2], [5, 20]), at([5, 6], [20, 40])]), SPEC, held))
    assert [r for p in got for r in p["id"]] == [0, 1, 2, 3, 5, 9, 6, 4]
    assert [r for p in ST._in_order(iter([]), SPEC, held) for r in p["id"]] == [1, 3, 9, 4]
    with pytest.raises(ValueError):
        list(ST._in_order(iter([at([0], [5]), at([1], [4])]), SPEC))


def test_held_rows_are_not_copied_for_every_batch(monkeypatch):
    """Batches read only the held rows among them, with the rows of one time in order of their ties (F5, F6)."""
    n = 20_000
    every = pd.DataFrame({"ts": pd.to_datetime(np.arange(n) // 7, unit="s"), "id": np.arange(n)})
    held, new = every[every["id"] % 3 > 0], every[(every["id"] % 3 == 0) | (every["id"] % 500 == 1)]
    copied, concat = [], pd.concat
    monkeypatch.setattr(pd, "concat", lambda frames, **k: copied.append(sum(map(len, frames))) or concat(frames, **k))
    parts = [p for p in ST._in_order((new.iloc[i:i + 100] for i in range(0, len(new), 100)), SPEC, held.reset_index(drop=True))]
    assert sum(copied) < 2 * n
    got = concat(parts)
    assert got["id"].tolist() == sorted([*held["id"], *new["id"]])
    late = pd.DataFrame({"ts": pd.to_datetime([9, None], unit="s"), "id": [1, 2]})
    assert [r for p in ST._in_order(iter([late.iloc[:1], late.iloc[1:]]), SPEC, late) for r in p["id"]] == [1, 1, 2, 2]


def test_scores_of_many_windows_at_once(spark):
    """A scorer that takes a matrix gives what one that takes a window gives, missing values and short series included (F5)."""
    from catalog.streams import last_z

    x = np.random.default_rng(4).normal(size=25_000)
    x[[70, 9000]] = np.nan
    x[200:300] = 1.5
    rows = np.lib.stride_tricks.sliding_window_view(x, 60)
    assert np.array_equal(last_z(rows), [last_z(w) for w in rows])
    frame = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(x[:9050])], "id long, value double").selectExpr("id", "'a' s", "timestamp_seconds(id) ts", "if(isnan(value), null, value) value")
    short = frame.where("id < 59").withColumn("s", F.lit("b"))
    at = ST.fresh_run(spark, "many")
    frame.union(short).coalesce(1).write.parquet(at)
    spec = SeriesSpec(("s",), "ts", ("id",), "value")
    got = [ST.run_available(ST.score_points(spark.readStream.schema(frame.schema).parquet(at), spec, last_z, 60, 2.5, many=many), "many") for many in (True, False)]
    a, b = (r.orderBy("s", "id").collect() for r in got)
    assert a == b and sum(r["alarm"] for r in a) > 0 and len(a) == 9050 + 59
