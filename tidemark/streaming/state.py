"""Structured Streaming: keyed state per series, features, scoring, tail thresholds, intervals, event-time aggregates.

State is keyed by series, Spark sorts the rows of a micro-batch by (ts, tie) before they touch it, and every stateful output is
append-only, so a restarted query continues from its checkpoint without repeating or losing rows. A series is read an Arrow batch at a time,
so Python holds some thousand rows however large a micro-batch is. ``run_counted`` starts streams with such a sort, which Spark does within
a micro-batch but refuses in a query started with its check for unsupported operations.

With ``late`` (an interval such as "10 minutes") rows may also come late across micro-batches: they wait in the state, sorted, until the
watermark has passed them, so a shuffled replay gives what one batch gives. The event-time timer of a series lets its rows go when no
more come. Rows behind the watermark are dropped by Spark and counted (``late_rows``). Without ``late`` arrival order is trusted
across micro-batches.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rolling import _moving
from ..plans.features import Feature
from ..plans.lineage import checkpoint_folder
from ..plans.series import IDX, SeriesSpec, micros


#: Rows that waited in the state and go on at a time.
ROWS = 10_000


def _sorted(stream: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The stream with a micro-batch's rows of a series together and in order; the stateful step asks for the same partitions, so no shuffle follows."""
    return stream.repartition(*spec.keys).sortWithinPartitions(*spec.keys, *[F.col(c).asc_nulls_last() for c in spec.order])


def _in_order(batches: Iterator[pd.DataFrame], spec: SeriesSpec, held: pd.DataFrame | None = None) -> Iterator[pd.DataFrame]:
    """The sorted batches and the rows ``held`` from before, which are sorted too, as batches in one order.

    What is still held is known by its place, so a batch costs its own rows and the held ones among them."""
    newest, at = None, 0
    known_held = 0 if held is None else int(held[spec.ts].notna().sum())
    for rows in batches:
        if not len(rows):
            continue
        known = rows[spec.ts].dropna()
        if not known.is_monotonic_increasing or (newest is not None and len(known) and known.iloc[0] < newest):
            raise ValueError("the rows of a micro-batch have lost their order: start the query with the number of shuffle partitions it goes on with")
        newest = known.iloc[-1] if len(known) else newest
        last = rows[spec.ts].iloc[-1]
        cut = at if held is None else len(held) if pd.isna(last) else int(held[spec.ts].iloc[:known_held].searchsorted(last, "right"))
        if cut <= at:
            yield rows.reset_index(drop=True)
            continue
        both = pd.concat([held.iloc[at:cut], rows], ignore_index=True).sort_values(spec.order, kind="stable")
        done = int(np.flatnonzero(both.index == len(both) - 1)[0]) + 1  # later batches stand behind this one's last row
        at = cut - (len(both) - done)  # behind it are held rows only, the last ones before the cut
        yield both.iloc[:done].reset_index(drop=True)
    for lo in range(at, 0 if held is None else len(held), ROWS):
        yield held.iloc[lo:lo + ROWS].reset_index(drop=True)


MILLIS = "_millis"


def _pickled(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _keyed(stream: DataFrame, spec: SeriesSpec, schema: T.StructType, saved: T.StructType, start: tuple, advance: Callable, late: str | None) -> DataFrame:
    """Runs ``advance(key, state, ordered rows) -> (state, result rows)`` over every series, from the state ``start``."""
    if late is None:
        def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
            after, any_rows = state.get if state.exists else start, False
            for rows in _in_order(batches, spec):
                after, out = advance(key, after, rows)
                any_rows = True
                yield out
            if any_rows:
                state.update(after)

        return _sorted(stream, spec).groupBy(*spec.keys).applyInPandasWithState(step, schema, saved, "append", GroupStateTimeout.NoTimeout)

    def in_time(key, batches: Iterator[pd.DataFrame], state: GroupState):
        *inner, waiting = state.get if state.exists else (*start, None)
        held = None if waiting is None else pa.ipc.open_stream(waiting).read_pandas()
        watermark, later, any_rows = state.getCurrentWatermarkMs(), [], False
        for rows in _in_order(batches, spec, held):
            any_rows, ready = True, rows[MILLIS] <= watermark
            if ready.any():
                inner, out = advance(key, tuple(inner), rows[ready].reset_index(drop=True))
                yield out
            if not ready.all():
                later.append(rows[~ready])
        if not any_rows:
            return
        state.update((*inner, _pickled(pd.concat(later, ignore_index=True)) if later else None))
        if later:
            state.setTimeoutTimestamp(max(int(later[0][MILLIS].iloc[0]), watermark) + 1)

    timed = event_time(stream, spec.ts).withColumn(MILLIS, F.unix_millis(spec.ts)).withWatermark(spec.ts, late)
    saved = T.StructType([*saved.fields, T.StructField("waiting", T.BinaryType())])
    schema = T.StructType([timed.schema[f.name] if f.name == spec.ts else f for f in schema.fields])
    return _sorted(timed, spec).groupBy(*spec.keys).applyInPandasWithState(in_time, schema, saved, "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(query) -> int:
    """Rows a finished streaming query has dropped because the watermark had passed them."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


# ---- features and scores --------------------------------------------------------------------------------

def moving(stat: str, col: str, w: int, m: int | None = None) -> Feature:
    """Rolling statistic (any method of a pandas rolling object) for use on streams."""
    return _moving(col, w, m, lambda r: getattr(r, stat)())


def combine(fn: Callable[[pd.DataFrame], pd.Series], *inputs: str) -> Feature:
    """Row-wise function of earlier features for use on streams."""
    return Feature(fn, inputs, kind="pandas")


def decompose(col: str, period: int, cycles: int = 3) -> dict[str, Feature]:
    """Causal trend, seasonal and residual of the buffered values; NULL until the buffer covers the first full period twice."""
    def seasonal(pdf):
        past = pd.concat([pdf["_flat"].shift(k * period) for k in range(1, cycles + 1)], axis=1)
        return past.mean(axis=1)

    return {"trend": moving("mean", col, period), "_flat": combine(lambda p: p[col] - p["trend"], col, "trend"),
            "seasonal": Feature(seasonal, ("_flat",), back=cycles * period, kind="pandas"), "residual": combine(lambda p: p["_flat"] - p["seasonal"], "_flat", "seasonal")}


def _buffer_rows(features: Mapping[str, Feature]) -> int:
    reach: dict[str, int] = {}
    for name, f in features.items():
        reach[name] = f.back + max((reach.get(i, 0) for i in f.inputs), default=0)
    return max(reach.values(), default=0)


def stream_features(stream: DataFrame, spec: SeriesSpec, features: Mapping[str, Feature], at_most: int | None = None, late: str | None = None) -> DataFrame:
    """Evaluates pandas-kind features over a bounded buffer of the latest values of each series.

    The buffer holds as many rows as the longest chain of features looks back (or ``at_most``), counted from the last known value, as filters
    carry theirs over missing ones; so the results equal the batch results whatever the boundaries of batches are.
    """
    keep = _buffer_rows(features) if at_most is None else at_most
    shown = [n for n in features if not n.startswith("_")]
    schema = T.StructType([*stream.schema.fields, T.StructField(IDX, T.LongType()), *[T.StructField(n, T.DoubleType()) for n in shown]])
    columns, fns, value = stream.columns, {n: f.build for n, f in features.items()}, spec.value

    def advance(key, state, rows: pd.DataFrame):
        seen, buffer = state
        old = len(buffer)
        values = np.concatenate([np.array(buffer, dtype=float), rows[value].to_numpy(dtype=float, na_value=np.nan)])
        work = pd.DataFrame({value: values, IDX: np.arange(seen - old, seen + len(rows))})
        for name, fn in fns.items():
            work[name] = fn(work)
        out = rows[columns].copy()
        for name in [IDX, *shown]:
            out[name] = work[name].to_numpy()[old:]
        known = np.flatnonzero(values == values)
        gap = len(values) - 1 - int(known[-1]) if len(known) and at_most is None else 0
        after = np.concatenate([values[:len(values) - gap][-keep:], np.full(min(gap, keep), np.nan)]) if keep else values[:0]
        return (seen + len(rows), after.tolist()), out

    return _keyed(stream, spec, schema, T.StructType([T.StructField("seen", T.LongType()), T.StructField("buffer", T.ArrayType(T.DoubleType()))]), (0, []), advance, late)


def score_points(stream: DataFrame, spec: SeriesSpec, scorer: Callable[[np.ndarray], float | np.ndarray], window: int, threshold: float, late: str | None = None, many: bool = False) -> DataFrame:
    """Scores each point from the last ``window`` values; NULL (and no alarm) until the buffer is full.

    With ``many`` the scorer is given a matrix, a window in each row, and returns a score for each."""
    def apply(pdf: pd.DataFrame) -> pd.Series:
        x = pdf[spec.value].to_numpy(dtype=float)
        out = np.full(len(x), np.nan)
        if many and len(x) >= window:
            rows = np.lib.stride_tricks.sliding_window_view(x, window)
            for lo in range(0, len(rows), ROWS):
                out[lo + window - 1:lo + window - 1 + len(rows[lo:lo + ROWS])] = scorer(rows[lo:lo + ROWS])
        for i in range(window - 1, 0 if many else len(x)):
            out[i] = scorer(x[i - window + 1:i + 1])
        return pd.Series(out)

    scored = stream_features(stream, spec, {"score": Feature(apply, (spec.value,), back=window - 1, kind="pandas")}, late=late)
    return scored.withColumn("alarm", F.when(F.col("score") > threshold, 1).otherwise(0))


def running_totals(stream: DataFrame, keys: list[str], alarm: str) -> DataFrame:
    """Points and alarms so far per series (complete or update mode)."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.sum(F.col(alarm).cast("long")).alias("anomalies"))


# ---- tail threshold ----------------------------------------------------------------------------------------

def fit_tail(peaks: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Shape and scale of the excesses: best stationary point of the one-parameter likelihood, or the exponential tail."""
    y = np.asarray(peaks, dtype=float)
    mean = lambda x: np.average(x, axis=-1, weights=weights)
    centre = float(mean(y))
    best = (-math.log(centre) - 1, 0.0, centre)
    sides = [np.linspace(-1 / y.max() + 1e-8, -1e-8, 64), np.geomspace(1e-8, max(2 * (centre - y.min()) / max(y.min(), 1e-12) ** 2, 1e-7), 64)]
    for grid in sides:
        for _ in range(5):
            grown = 1 + grid[:, None] * y[None, :]
            shape = mean(np.log(grown))
            with np.errstate(divide="ignore", invalid="ignore"):
                level = np.where(shape / grid > 0, -np.log(shape / grid) - shape - 1, -np.inf)
            i = int(np.argmax(level))
            balance = mean(1 / grown[i]) * (1 + shape[i]) - 1
            found = (level[i], float(shape[i]), float(shape[i] / grid[i]))
            lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
            grid = np.linspace(lo, hi, 64) if lo < 0 else np.geomspace(lo, hi, 64)
        if abs(balance) < 1e-4 and found[0] > best[0]:
            best = found
    return best[1], best[2]


class Tail:
    """Excesses in a space that doesn't grow: counts and sums on a logarithmic scale of ``STEPS`` steps an octave.

    A step is known by its count and mean, so the mean of all is exact; a step's values differ by at most 1.1 %, so the mean of their
    logarithms, which the fit reads, is off by less than 2e-5. Two summaries are merged by adding them.
    Excesses below 2**-40 or from 2**40 on share the outermost steps."""

    STEPS, OCTAVES = 64, 80

    def __init__(self, counts: list[int] | None = None, sums: list[float] | None = None):
        size = self.STEPS * self.OCTAVES
        self.counts = np.zeros(size, np.int64) if not counts else np.array(counts, np.int64)
        self.sums = np.zeros(size) if not sums else np.array(sums, float)

    def add(self, y: np.ndarray | float) -> None:
        y = np.atleast_1d(np.asarray(y, float))
        at = np.clip(np.floor((np.log2(y) + self.OCTAVES / 2) * self.STEPS), 0, len(self.counts) - 1).astype(int)
        np.add.at(self.counts, at, 1)
        np.add.at(self.sums, at, y)

    def merge(self, other: "Tail") -> "Tail":
        return Tail((self.counts + other.counts).tolist(), (self.sums + other.sums).tolist())

    @property
    def n(self) -> int:
        return int(self.counts.sum())

    def fit(self) -> tuple[float, float]:
        used = self.counts > 0
        return fit_tail(self.sums[used] / self.counts[used], self.counts[used])


def tail_quantile(level: float, gamma: float, sigma: float, q: float, n: int, peaks: int) -> float:
    ratio = q * n / peaks
    return level + sigma / gamma * (ratio ** -gamma - 1) if gamma else level - sigma * math.log(ratio)


def stream_tail_threshold(stream: DataFrame, spec: SeriesSpec, q: float = 1e-3, first: int = 1000, pct: float = 98.0, late: str | None = None) -> DataFrame:
    """Streaming peaks-over-threshold per series.

    The first ``first`` values only set the level and the first fit.  Afterwards a value above the threshold is an alarm and leaves
    the fit alone; a value above the level joins the peaks and the tail is fitted again.  Every value counts as observed.
    The peaks are kept as a ``Tail``, so a series' state stays as large as it is after ``first`` values. A missing value gets the last threshold and is
    not observed.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField("threshold", T.DoubleType()), T.StructField("alarm", T.IntegerType())])
    saved = T.StructType([T.StructField("first", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("sums", T.ArrayType(T.DoubleType())),
                          T.StructField("n", T.LongType()), T.StructField("level", T.DoubleType()), T.StructField("limit", T.DoubleType())])
    columns, value = stream.columns, spec.value

    def advance(key, state, rows: pd.DataFrame):
        waiting, counts, sums, n, level, limit = state
        waiting, tail = list(waiting), Tail(counts, sums)
        limits, alarms = [], []
        for v in rows[value].to_numpy(dtype=float, na_value=np.nan).tolist():
            alarm = 0
            if v != v:
                limits.append(limit)
                alarms.append(0)
                continue
            n += 1
            if level is None:
                waiting.append(v)
                if len(waiting) == first:
                    level = float(np.percentile(waiting, pct))
                    if peaks := [w - level for w in waiting if w > level]:
                        tail.add(peaks)
                    limit = tail_quantile(level, *tail.fit(), q, n, tail.n) if tail.n > 1 else float("inf")
                    waiting = []
                limits.append(None)
            else:
                if v > limit:
                    alarm = 1
                elif v > level:
                    tail.add(v - level)
                    limit = tail_quantile(level, *tail.fit(), q, n, tail.n) if tail.n > 1 else limit
                limits.append(limit)
            alarms.append(alarm)
        out = rows[columns].copy()
        out["threshold"] = pd.Series(limits, dtype="float64")
        out["alarm"] = np.array(alarms, dtype="int32")
        kept = (tail.counts.tolist(), tail.sums.tolist()) if level is not None else ([], [])
        return (waiting, *kept, n, level, limit), out

    return _keyed(stream, spec, schema, saved, ([], [], [], 0, None, None), advance, late)


# ---- intervals ------------------------------------------------------------------------------------------------

def stream_intervals(stream: DataFrame, spec: SeriesSpec, alarm: str, gap: int, idle_ms: int | None = None, late: str | None = None) -> DataFrame:
    """Alarm intervals with gaps of at most ``gap`` rows filled, each emitted once it can no longer grow.

    State per series is the open interval and a row counter.  With ``idle_ms`` (needs a watermark) an open interval is also emitted
    when event time has moved on that far without a new row; this and ``late`` exclude each other.
    """
    if idle_ms is not None and late is not None:
        raise ValueError("an idle series' rows may still wait: give idle_ms or late")
    key_fields = [f for f in stream.schema.fields if f.name in spec.keys]
    schema = T.StructType([*key_fields, *[T.StructField(n, T.LongType()) for n in ("start_idx", "end_idx", "n")]])
    saved = T.StructType([T.StructField("seen", T.LongType()), T.StructField("start", T.LongType()), T.StructField("last", T.LongType())])
    names = [f.name for f in schema.fields]

    def advance(key, state, rows: pd.DataFrame):
        seen, start, last = state
        closed = []
        for at in (np.flatnonzero(rows[alarm].to_numpy() == 1) + seen).tolist():
            if start >= 0 and at - last - 1 > gap:
                closed.append((*key, start, last, last - start + 1))
                start = -1
            start, last = (at if start < 0 else start), at
        seen += len(rows)
        if start >= 0 and seen - 1 - last > gap:
            closed.append((*key, start, last, last - start + 1))
            start, last = -1, -1
        return (seen, start, last), pd.DataFrame(closed, columns=names)

    if idle_ms is None:
        return _keyed(stream, spec, schema, saved, (0, -1, -1), advance, late)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        held = state.get if state.exists else (0, -1, -1)
        if state.hasTimedOut:
            seen, start, last = held
            state.update((seen, -1, -1))
            yield pd.DataFrame([(*key, start, last, last - start + 1)] if start >= 0 else [], columns=names)
            return
        after, rows = held, None
        for rows in _in_order(batches, spec):
            after, out = advance(key, after, rows)
            yield out
        if rows is None:
            return
        state.update(after)
        if after[1] >= 0:
            newest = int(pd.Timestamp(rows[spec.ts].iloc[-1]).timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))

    return _sorted(stream, spec).groupBy(*spec.keys).applyInPandasWithState(step, schema, saved, "append", GroupStateTimeout.EventTimeTimeout)


# ---- event time -----------------------------------------------------------------------------------------------

def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Event time as an instant, which watermarks need, without going through the session time zone."""
    return df.withColumn(ts, F.timestamp_micros(micros(df, ts)))


def window_stats(stream: DataFrame, spec: SeriesSpec, size: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Count, mean and extremes per sliding event-time window; rows later than ``late`` are dropped."""
    w = F.window(spec.ts, size, slide)
    return stream.withWatermark(spec.ts, late).groupBy(*spec.keys, w).agg(F.count(F.lit(1)).alias("n"), F.avg(spec.value).alias("mean"), F.min(spec.value).alias("lo"), F.max(spec.value).alias("hi"))


def alarm_sessions(stream: DataFrame, spec: SeriesSpec, alarm: Column, gap: str, late: str = "10 minutes") -> DataFrame:
    """Alarms merged while they are less than ``gap`` of event time apart."""
    return stream.filter(alarm).withWatermark(spec.ts, late).groupBy(*spec.keys, F.session_window(spec.ts, gap)).agg(F.count(F.lit(1)).alias("n"), F.max(spec.value).alias("peak"))


# ---- running ----------------------------------------------------------------------------------------------------

CHECKED = "spark.sql.streaming.unsupportedOperationCheck"


def fresh_run(spark: SparkSession, name: str) -> str:
    """Folder for a run that starts with empty state: a reset is a new checkpoint, the old one stays readable."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, name: str, mode: str = "append", run: str | None = None) -> DataFrame:
    """Processes what the source holds now, into a table in the checkpoint folder, and returns that table.

    Passing the folder of an earlier run continues it.
    """
    return run_counted(stream, name, mode, run)[0]


def run_counted(stream: DataFrame, name: str, mode: str = "append", run: str | None = None) -> tuple[DataFrame, int]:
    """The same, and the number of rows dropped because they came behind the watermark."""
    spark = stream.sparkSession
    run = run or fresh_run(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True)
    before = spark.conf.get(CHECKED)
    spark.conf.set(CHECKED, "false")  # read at the start only, which would refuse the sort of a micro-batch's rows
    try:
        if mode == "append":
            query = writer.format("parquet").start(f"{run}/table")
        else:
            query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{run}/table")).start()
    finally:
        spark.conf.set(CHECKED, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{run}/table"), late_rows(query)
