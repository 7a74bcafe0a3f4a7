"""Series layout: how ordered rows are cut up so that no task ever holds a whole long series.

A *series* is the set of rows sharing ``SeriesSpec.keys``, ordered by ``(ts, *tie)``.  Row-count windows
need neighbours, so a naive ``Window.partitionBy(keys)`` sends one series to one task.  ``lay_out`` first
measures the largest series (one aggregate row comes back to the driver) and then picks

* **whole**   - every series fits in ``chunk_rows`` rows: plain keyed windows, one shuffle;
* **chunked** - otherwise, and always when there are no keys: rows are counted per short time *cell*,
  a prefix sum of those counts gives each cell its row offset, cells are packed into chunks of about
  ``chunk_rows`` rows, and the cells within ``back``/``fwd`` rows of a chunk are sent to it as well (the
  *halo*).  Every bounded frame is then exact inside ``(keys, chunk)`` and halo rows are dropped at the end.

A burst is a cell with far more rows than a cell should have. Rows of such cells are sorted across the cluster by ``(ts, *tie)`` and cut
into sub-cells of the wanted size, at one instant and for equal ties too (those in any, but one, order). The rows are then stored once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut_lineage

CHUNK, HOME, START, SUB, IDX = "_chunk", "_home", "_start", "_sub", "idx"
SENT_CELLS = 100_000  # a table of cells up to this size is sent to every task
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


@dataclass(frozen=True)
class SeriesSpec:
    """Names the columns of a series and bounds the rows one task may hold."""

    keys: tuple[str, ...] = ()
    ts: str = "ts"
    tie: tuple[str, ...] = ()
    value: str = "value"
    label: str | None = None
    chunk_rows: int = 250_000
    cell_rows: int = 4096
    mode: str = "auto"  # auto | whole | chunked

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.tie]

    def chunked(self, chunk_rows: int, cell_rows: int | None = None) -> "SeriesSpec":
        return replace(self, mode="chunked", chunk_rows=chunk_rows,
                       cell_rows=cell_rows or max(1, chunk_rows // 20))


def micros(df: DataFrame, name: str) -> Column:
    """Position of a time (or numeric) column on an integer axis, independent of the session time zone for NTZ."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{name}`)")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(dtype, T.DateType):
        return F.unix_date(F.col(name)).cast("long") * F.lit(86_400_000_000)
    return F.col(name).cast("long")


def seconds_between(df: DataFrame, later: Column, earlier: Column, like: str) -> Column:
    """``later - earlier`` in seconds as DOUBLE, for columns typed like ``like``."""
    tmp = df.schema[like].dataType
    if isinstance(tmp, T.TimestampNTZType):
        epoch = F.expr(EPOCH)
        return (F.timestamp_diff("MICROSECOND", epoch, later) - F.timestamp_diff("MICROSECOND", epoch, earlier)) / 1e6
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def prefix_sum(table: DataFrame, keys: Sequence[str], by: str, amount: str, out: str, block: int = 1024) -> DataFrame:
    """Exclusive running sum of ``amount`` along integer column ``by``, in two levels.

    Blocks of ``block`` consecutive ``by`` values are summed first, the short block table is scanned per key,
    and each block is scanned on its own, so no task sees more than one block or one key's block table.
    """
    keys = list(keys)
    blocked = table.withColumn("_block", F.floor(F.col(by) / block))
    inner = Window.partitionBy(*keys, "_block").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = (blocked.groupBy(*keys, "_block").agg(F.sum(amount).alias("_sum"))
              .withColumn("_base", F.coalesce(F.sum("_sum").over(outer), F.lit(0))).drop("_sum"))
    local = blocked.withColumn("_local", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    joined = null_safe_join(local, totals, [*keys, "_block"])
    return joined.withColumn(out, F.col("_base") + F.col("_local")).drop("_base", "_local", "_block")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that treats NULL keys as equal and keeps one copy of the key columns."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    on_expr = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on]
    return left.join(right, on_expr, how).drop(*[f"_right_{c}" for c in on])


@dataclass
class Laid:
    """A frame whose rows are ready for windows; ``part`` is the physical partition key of every window."""

    df: DataFrame
    spec: SeriesSpec
    is_chunked: bool
    back: int = 0
    fwd: int = 0
    part: list[str] = field(default_factory=list)

    @property
    def order(self) -> list[str]:
        """Rows equal in ``(ts, *tie)`` may lie in several sub-cells of a burst; their cells' offsets keep these in order."""
        return [*self.spec.order, START] if self.is_chunked else self.spec.order

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def reverse(self) -> WindowSpec:
        """The same rows from the end of the series to its start."""
        return Window.partitionBy(*self.part).orderBy(*[F.col(c).desc_nulls_last() for c in self.order])

    def rows(self, lo: int, hi: int) -> WindowSpec:
        return self.ordered().rowsBetween(lo, hi)

    def with_df(self, df: DataFrame) -> "Laid":
        return replace(self, df=df)

    @property
    def own(self) -> Column:
        return F.col(CHUNK) == F.col(HOME) if self.is_chunked else F.lit(True)

    def with_index(self) -> "Laid":
        """Adds the dense 0-based row position of each row in its series."""
        if IDX in self.df.columns:
            return self
        number = F.row_number().over(self.ordered()).cast("long") - 1
        if self.is_chunked:
            number = number + F.first(START).over(self.rows(Window.unboundedPreceding, 0))
        return self.with_df(self.df.withColumn(IDX, number))

    def done(self, keep_sub: bool = False) -> DataFrame:
        df = self.df.filter(self.own) if self.is_chunked else self.df
        return df.drop(CHUNK, HOME, START, *([] if keep_sub else [SUB]))


def measure(df: DataFrame, spec: SeriesSpec) -> tuple[int, float]:
    """(rows of the largest series, rows per microsecond of the densest one); one row reaches the driver."""
    t = micros(df, spec.ts)
    per = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"), (F.max(t) - F.min(t) + 1).alias("span"))
    row = per.agg(F.max("n").alias("n"), F.max(F.col("n") / F.col("span")).alias("rate")).first()
    return int(row["n"] or 0), float(row["rate"] or 1.0)


def chunk_rate(df: DataFrame, spec: SeriesSpec, size: int | None = None) -> float | None:
    """None if every series is kept whole, else the rate that sets the width of a cell; ``size`` rows are the most of a whole series."""
    if spec.mode == "whole" and spec.keys:
        return None
    longest, rate = measure(df, spec)
    return None if spec.mode == "auto" and spec.keys and longest <= (size or spec.chunk_rows) else rate


@dataclass(frozen=True)
class Cut:
    """Where the series of a frame are cut: nothing for whole series, else the rate and a table of the cells with their row offsets.

    It depends on keys, times and ties only, so all layouts of the same rows share it, whatever was computed on them since.
    """

    rate: float | None = None
    cells: DataFrame | None = None
    few: bool = False


def cut_up(df: DataFrame, spec: SeriesSpec, size: int | None = None) -> tuple[DataFrame, Cut]:
    """The frame, rows of bursts marked with their sub-cell, and its cut."""
    rate = chunk_rate(df, spec, size)
    if rate is None:
        return df, Cut()
    df = split_bursts(df, spec, rate)
    cells = cut_lineage(_offsets(df, spec, rate))
    return df, Cut(rate, cells, cells.count() <= SENT_CELLS)


def _cells(df: DataFrame, spec: SeriesSpec, rate: float) -> DataFrame:
    return df.withColumn("_cell", F.floor(micros(df, spec.ts) / max(1, int(spec.cell_rows / rate))))


def split_bursts(df: DataFrame, spec: SeriesSpec, rate: float | None) -> DataFrame:
    """The frame with a number ``_sub`` for each row of cells with more than twice their rows (0 for others); as it is if there are none."""
    if rate is None or SUB in df.columns:
        return df
    keys, most = list(spec.keys), max(1, min(2 * spec.cell_rows, spec.chunk_rows))
    rows = _cells(df, spec, rate)
    crowded = rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    crowded = cut_lineage(crowded)  # at most one in ``most`` of the rows
    n = crowded.agg(F.sum("_n")).first()[0]
    if not n:
        return df
    marked = null_safe_join(rows, crowded, [*keys, "_cell"])
    dealt = marked.filter("_n is not null").repartitionByRange(max(1, -(-n // spec.cell_rows)), *keys, "_cell", *spec.order, F.monotonically_increasing_id())
    calm = marked.filter("_n is null").withColumn(SUB, F.lit(0))
    return cut_lineage(calm.unionByName(dealt.withColumn(SUB, F.spark_partition_id())).drop("_cell", "_n"))


def lay_out(df: DataFrame, spec: SeriesSpec, back: int = 0, fwd: int = 0) -> Laid:
    """Chooses whole or chunked layout (see module docstring) with the given halo."""
    df, cut = cut_up(df, spec)
    return lay_out_at(df, spec, cut, back, fwd)


def lay_out_at(df: DataFrame, spec: SeriesSpec, cut: Cut, back: int = 0, fwd: int = 0, size: int | None = None) -> Laid:
    """The layout for a cut that is already known, in chunks of ``size`` rows; stages that keep the rows share one cut."""
    if cut.rate is None:
        return Laid(df, spec, False, back, fwd, list(spec.keys))
    return _chunk(df, spec, cut, back, fwd, size or spec.chunk_rows)


def _offsets(df: DataFrame, spec: SeriesSpec, rate: float) -> DataFrame:
    """One row per cell (and sub-cell): its rows and the rows of the series before it."""
    keys = list(spec.keys)
    rows = _cells(df, spec, rate)
    if SUB not in df.columns:
        return prefix_sum(cut_lineage(rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))), keys, "_cell", "_n", START)
    cells = cut_lineage(rows.groupBy(*keys, "_cell", SUB).agg(F.count(F.lit(1)).alias("_n")))
    inside = Window.partitionBy(*keys, "_cell").orderBy(SUB)  # sub-cells of one cell, a row for each
    sums = prefix_sum(cells.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_n")), keys, "_cell", "_n", START).drop("_n")
    cells = cells.withColumn("_before", F.sum("_n").over(inside) - F.col("_n"))
    return null_safe_join(cells, sums, [*keys, "_cell"]).withColumn(START, F.col(START) + F.col("_before")).drop("_before")


def _chunk(df: DataFrame, spec: SeriesSpec, cut: Cut, back: int, fwd: int, size: int) -> Laid:
    keys, cells = list(spec.keys), cut.cells
    rows, at = _cells(df, spec, cut.rate), ["_cell", *([SUB] if SUB in df.columns else [])]
    end = F.col(START) + F.col("_n")
    home = F.floor(F.col(START) / size)
    last = F.floor((end + back - 1) / size)
    first = home
    if fwd:
        widest = F.col("_widest")
        cells = null_safe_join(cells, cells.groupBy(*keys).agg(F.max("_n").alias("_widest")), keys) if keys else \
            cells.crossJoin(F.broadcast(cells.agg(F.max("_n").alias("_widest"))))
        first = F.floor(F.greatest(F.lit(0), F.col(START) - fwd - widest) / size)
    targets = cells.select(*keys, *at, F.col(START), home.alias(HOME),
                           F.explode(F.sequence(first, last)).alias(CHUNK))
    laid = null_safe_join(rows, F.broadcast(targets) if cut.few else targets, [*keys, *at], "inner").drop("_cell")
    return Laid(laid, spec, True, back, fwd, [*keys, CHUNK])


def index_rows(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """SRC-9: dense 0-based position of every row in its series, column ``idx``."""
    return lay_out(df, spec).with_index().done()
