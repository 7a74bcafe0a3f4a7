"""Declarative feature sets over series.

A ``Feature`` says which columns it reads and how many rows before/after the current one it needs.
``with_features`` orders features into levels by their inputs, adds up the halo along the longest path, lays
the series out once, and evaluates each level in one projection; all windows share one shuffle and sort.
Where a long series is cut into chunks, features with a carried state and values carried over missing ones come first, in a layout of
their own: they are right on a chunk's own rows, and what reads them is laid out after them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut_lineage
from .series import CHUNK, HOME, IDX, START, SUB, Cut, Laid, SeriesSpec, cut_up, lay_out_at, null_safe_join

ARROW_VALUES = 2 ** 19  # values (rows times columns) of a chunk that goes through Python


@dataclass(frozen=True)
class Feature:
    """``kind``: native (``build(laid) -> Column``), pandas (``build(pdf) -> array``), frame (``build.all(laid, builds) -> Laid``, for
    all of a level at once, their builds by name), a scan of the expression ``build`` gives: sum, last, next, or staged: ``build(laid)`` gives dicts of
    intermediate columns, each reading those before it, and at last the feature's expression. Intermediates of equal names are shared.

    ``carry`` (pandas) is the same computation with a state that passes from chunk to chunk (``functions.recursive``); ``fill``
    (pandas) says that ``build`` replaces missing values of its only input by the last known one, however far back."""

    build: Callable
    inputs: tuple[str, ...] = ()
    back: int = 0
    fwd: int = 0
    kind: str = "native"
    non_causal: bool = False
    dtype: str = "double"
    carry: object | None = None
    fill: bool = False

    @property
    def causal(self) -> bool:
        return self.fwd == 0 and not self.non_causal


def scalar(expr: Column | Callable[[], Column], *inputs: str, non_causal: bool = False) -> Feature:
    """Row-wise expression over already available columns."""
    return Feature(lambda laid: expr() if callable(expr) and not isinstance(expr, Column) else expr, inputs,
                   non_causal=non_causal)


def running_sum(expr: Column, *inputs: str) -> Feature:
    """Sum from the start of the series to this row (two-level scan when chunked)."""
    return Feature(lambda laid: expr, inputs, kind="sum")


def carry_last(expr: Column, *inputs: str) -> Feature:
    """Last non-NULL value up to this row, however far back (two-level scan when chunked)."""
    return Feature(lambda laid: expr, inputs, kind="last")


def carry_next(expr: Column, *inputs: str) -> Feature:
    """First non-NULL value from this row on, however far ahead (two-level scan when chunked)."""
    return Feature(lambda laid: expr, inputs, kind="next", non_causal=True)


def causal_only(features: Mapping[str, Feature]) -> dict[str, Feature]:
    """Drops features that look ahead, and those fed by one."""
    kept: dict[str, Feature] = {}
    dropped: set[str] = set()
    for name, f in features.items():
        if f.causal and not any(i in dropped for i in f.inputs):
            kept[name] = f
        else:
            dropped.add(name)
    return kept


def _plan(features: Mapping[str, Feature]) -> tuple[list[list[str]], int, int]:
    level: dict[str, int] = {}
    edge_only: set[str] = set()  # carried values are right on own rows only, so no window may read them
    reach: dict[str, tuple[int, int]] = {}
    for name, f in features.items():
        ins = [i for i in f.inputs if i in features and i != name]
        missing = [i for i in ins if i not in level]
        if missing:
            raise ValueError(f"{name} is declared before its inputs {missing}")
        if f.kind in ("last", "next", "frame") or any(i in edge_only for i in ins):
            edge_only.add(name)
        if f.back + f.fwd and any(i in edge_only for i in ins):
            raise ValueError(f"{name} looks at other rows of a carried column; lay the result out again first")
        level[name] = 1 + max((level[i] for i in ins), default=-1)
        reach[name] = (f.back + max((reach[i][0] for i in ins), default=0),
                       f.fwd + max((reach[i][1] for i in ins), default=0))
    return _levels_of(features, level), max((r[0] for r in reach.values()), default=0), max((r[1] for r in reach.values()), default=0)


def _levels_of(features: Mapping[str, Feature], level: Mapping[str, int]) -> list[list[str]]:
    """Before each pass through Python stands all that doesn't wait for it, so that passes are few and scans don't repeat them."""
    passes: dict[str, int] = {}
    for name, f in features.items():
        passes[name] = max((passes[i] + (features[i].kind in IN_PYTHON) for i in f.inputs if i in features and i != name), default=0)
    place = {name: (passes[name], features[name].kind in IN_PYTHON, 0 if features[name].kind in IN_PYTHON else level[name]) for name in features}
    return [[n for n in features if place[n] == p] for p in sorted(set(place.values()))]


def chunk_size(df: DataFrame, spec: SeriesSpec, features: Mapping[str, Feature]) -> int:
    """Rows of a chunk: fewer where many columns go through Python, but some cells and several times the halo."""
    if not any(f.kind in IN_PYTHON for f in features.values()):
        return spec.chunk_rows
    _, back, fwd = _plan(features)
    return min(spec.chunk_rows, max(5 * spec.cell_rows, 8 * (back + fwd), ARROW_VALUES // (len(df.columns) + len(features))))


def with_features(df: DataFrame, spec: SeriesSpec, features: Mapping[str, Feature], *, index: bool = False, cut: Cut | None = None) -> DataFrame:
    """Adds every feature as a column; names starting with ``_`` are intermediates and are dropped.

    ``cut`` is that of the same rows (``cut_up``), so that what was computed on them since isn't computed again to find it.
    """
    return _evaluate(df, spec, features, index, cut).drop(*[n for n in features if n.startswith("_")])


def _evaluate(df: DataFrame, spec: SeriesSpec, features: Mapping[str, Feature], index: bool, cut: Cut | None) -> DataFrame:
    _plan(features)  # a wrong declaration is refused in every layout
    size, rest, given, kept = chunk_size(df, spec, features), dict(features), df.columns, SUB in df.columns
    if cut is None:
        df, cut = cut_up(df, spec, size)
    if cut.rate is not None:
        rest = _with_filled_inputs(rest)
        while stage := _first_stage(rest):
            df = cut_lineage(_carried(df, spec, {n: rest[n] for n in stage}, cut, size))
            rest = {n: f for n, f in rest.items() if n not in stage}
    laid = _levels(df, spec, rest, cut, size, index)
    filled = [n for n in laid.df.columns if n.startswith(FILLED) and n not in given]
    out = laid.done(kept).drop(*filled)
    return out if index or IDX in given else out.drop(IDX)


def _levels(df: DataFrame, spec: SeriesSpec, features: Mapping[str, Feature], cut: Cut, size: int, index: bool = False) -> Laid:
    levels, back, fwd = _plan(features)
    laid, costly = lay_out_at(df, spec, cut, back, fwd, size), False
    if index or any(IDX in f.inputs or f.kind == "staged" for f in features.values()) or \
            (laid.is_chunked and any(f.kind in ("last", "next") for f in features.values())):
        laid = laid.with_index()
    for names in levels:
        if costly and laid.is_chunked and any(features[n].kind in ("sum", "last", "next", "frame") for n in names):
            laid, costly = laid.with_df(cut_lineage(laid.df.repartition(*laid.part))), False  # these read the rows more than once
        native = {n: features[n].build(laid) for n in names if features[n].kind == "native"}
        if native:
            laid = laid.with_df(laid.df.withColumns(native))
        staged = {n: features[n].build(laid) for n in names if features[n].kind == "staged"}
        if staged:
            laid = _staged(laid, staged)
        scans = {n: features[n] for n in names if features[n].kind in ("sum", "last", "next")}
        if scans:
            laid = _scan(laid, scans)
        frames = {n: features[n].build for n in names if features[n].kind == "frame"}
        if frames:
            laid = next(iter(frames.values())).all(laid, frames)
        batch = {n: features[n] for n in names if features[n].kind == "pandas"}
        if batch:
            laid = laid.with_df(_pandas_level(laid, batch))
        costly = costly or bool(frames or batch)
    return laid


def _staged(laid: Laid, staged: Mapping[str, list]) -> Laid:
    """All features' first intermediates in one projection, then all second ones, and so on."""
    steps: list[dict[str, Column]] = []
    for *before, _ in staged.values():
        for i, columns in enumerate(before):
            steps += [{}] * (i + 1 - len(steps))
            steps[i] = {**steps[i], **columns}
    df = laid.df
    for columns in steps:
        df = df.withColumns(columns)
    df = df.withColumns({n: parts[-1] for n, parts in staged.items()})
    return laid.with_df(df.drop(*[c for columns in steps for c in columns]))


FILLED = "_filled_"
IN_PYTHON = ("pandas", "frame")


def _with_filled_inputs(features: Mapping[str, Feature]) -> dict[str, Feature]:
    """Features that fill missing values read a column in which the last known value is carried, as no halo covers every gap."""
    out: dict[str, Feature] = {}
    for n, f in features.items():
        if f.fill:
            col, = f.inputs
            number = F.col(col).cast("double")
            out.setdefault(FILLED + col, carry_last(F.when(~F.isnan(number), number), col))
            f = replace(f, build=lambda pdf, build=f.build, col=col: build(pdf.assign(**{col: pdf[FILLED + col]})), inputs=(FILLED + col,), fill=False)
        out[n] = f
    return out


def _first_stage(features: Mapping[str, Feature]) -> set[str]:
    """Carried features that wait for no other carried feature, with all they read."""
    def above(name: str) -> set[str]:
        ins = {i for i in features[name].inputs if i in features and i != name}
        return ins.union(*map(above, ins))

    carried = {n for n, f in features.items() if f.carry is not None or n.startswith(FILLED)}
    ready = {n for n in carried if not above(n) & carried}
    return ready.union(*map(above, ready))


def _carried(df: DataFrame, spec: SeriesSpec, stage: Mapping[str, Feature], cut: Cut, size: int) -> DataFrame:
    """A chunked stage: plain features first, then chunks run from the states that the chunks before them leave.

    The summaries, one short row per chunk, are folded in one group per series.
    """
    states = {n: f for n, f in stage.items() if f.carry is not None}
    plain = {n: f for n, f in stage.items() if n not in states}
    laid = _levels(df, spec, plain, cut, size)
    own = laid.df.filter(laid.own)
    if not states:
        return own.drop(CHUNK, HOME, START)
    keys, order, part = list(spec.keys), laid.order, list(laid.part)
    inputs = {n: f.inputs[0] for n, f in states.items()}
    carry = {n: f.carry for n, f in states.items()}
    kept = [f for f in own.schema.fields if f.name in part]
    lists = T.StructType(kept + [T.StructField(f"_state_{n}", T.ArrayType(T.DoubleType())) for n in states])

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        row = pdf[part].iloc[:1].reset_index(drop=True)
        return row.assign(**{f"_state_{n}": [c.summary(pdf[inputs[n]].to_numpy(dtype=float, na_value=float("nan")))] for n, c in carry.items()})

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK).reset_index(drop=True)
        return pdf.assign(**{f"_state_{n}": c.enter([list(s) for s in pdf[f"_state_{n}"]]) for n, c in carry.items()})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        done = {n: c.run(pdf[inputs[n]].to_numpy(dtype=float, na_value=float("nan")), list(pdf[f"_state_{n}"].iloc[0])) for n, c in carry.items()}
        return pdf.drop(columns=[f"_state_{n}" for n in carry]).assign(**done)

    narrow = own.select(*dict.fromkeys([*part, *order, *inputs.values()]))
    entered = narrow.groupBy(*part).applyInPandas(summarise, lists).groupBy(*keys).applyInPandas(enter, lists)
    schema = T.StructType(own.schema.fields + [T.StructField(n, T.DoubleType()) for n in states])
    return null_safe_join(own, entered, part).groupBy(*part).applyInPandas(run, schema).drop(CHUNK, HOME, START)


def _pandas_level(laid: Laid, batch: Mapping[str, Feature]) -> DataFrame:
    """One Arrow pass per (keys, chunk); the group is bounded by ``chunk_rows`` plus its halo."""
    order = laid.order
    part = list(laid.part)
    schema = T.StructType(laid.df.schema.fields
                          + [T.StructField(n, T._parse_datatype_string(f.dtype)) for n, f in batch.items()])
    fns = {n: f.build for n, f in batch.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return pdf.assign(**{n: fn(pdf) for n, fn in fns.items()})

    return laid.df.groupBy(*part).applyInPandas(run, schema)


def _scan(laid: Laid, scans: Mapping[str, Feature]) -> Laid:
    """Unbounded running features of one level.

    Chunked, every chunk is scanned on its own; one table with a row per chunk carries the totals and edge values of all
    features across chunks and is joined back on the partition key the rows already have.
    """
    # looking ahead is done by looking back in reverse order: a frame that is open at its far end is re-read for every row
    upto = laid.rows(Window.unboundedPreceding, 0)
    onward = laid.reverse().rowsBetween(Window.unboundedPreceding, 0)
    exprs = {n: f.build(laid) for n, f in scans.items()}
    local = {}
    for n, f in scans.items():
        if f.kind == "sum":
            local[n] = F.sum(exprs[n]).over(upto)
        elif f.kind == "last":
            local[n] = F.last(exprs[n], ignorenulls=True).over(upto)
        else:
            local[n] = F.last(exprs[n], ignorenulls=True).over(onward)
    if not laid.is_chunked:
        return laid.with_df(laid.df.withColumns(local))

    keys, whole = list(laid.spec.keys), Window.partitionBy(*laid.part)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    edges, carried, final = [], [], {}
    for n, f in scans.items():
        at = F.when(exprs[n].isNotNull(), F.col(IDX)) if f.kind != "sum" else None
        if f.kind == "sum":
            lead_in = F.coalesce(F.sum(F.when(F.col(HOME) < F.col(CHUNK), exprs[n])).over(whole), F.lit(0))
            local[n] = local[n] - lead_in
            edges.append(F.sum(exprs[n]).alias(f"_edge_{n}"))
            carried.append(F.coalesce(F.sum(f"_edge_{n}").over(before), F.lit(0)).alias(f"_carry_{n}"))
            final[n] = F.col(n) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))
        elif f.kind == "last":
            edges.append(F.max_by(exprs[n], at).alias(f"_edge_{n}"))
            carried.append(F.last(f"_edge_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}"))
            final[n] = F.coalesce(F.col(n), F.col(f"_carry_{n}"))
        else:
            edges.append(F.min_by(exprs[n], at).alias(f"_edge_{n}"))
            carried.append(F.last(f"_edge_{n}", ignorenulls=True).over(after).alias(f"_carry_{n}"))
            final[n] = F.coalesce(F.col(n), F.col(f"_carry_{n}"))
    table = laid.df.filter(laid.own).groupBy(*keys, CHUNK).agg(*edges).select(*keys, CHUNK, *carried)
    df = null_safe_join(laid.df.withColumns(local), table, [*keys, CHUNK])
    return laid.with_df(df.withColumns(final).drop(*[f"_carry_{n}" for n in scans]))
