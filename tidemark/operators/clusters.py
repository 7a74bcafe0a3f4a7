"""Density clusters on a grid, exact, without pairing up the points of a crowded neighbourhood.

A cell's diagonal is just below ``eps``, so the points of a cell are all neighbours.  A cell with at least ``least`` rows is crowded and
all its points are core points.  Only points of the other cells, fewer than ``least`` in each, are compared with the points around them;
so a point is compared at most ``least`` times the number of cells in reach.  Two cells with core points are linked if a pair of their
core points is within ``eps``; that is decided on bounding boxes, which are split further only where the boxes leave it open.
Linked cells form clusters by large-star and small-star rounds.  The number of cells in reach is 5 to the power of the number of
features, which suits up to four of them; values are expected to stay below ``2**40 * eps``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage
from ..plans.stats import attach_group_stats

PIECE = 20_000  # points of one cell that meet in one join key
SPLITS, STEP = 20, 2  # halvings after which open boxes are settled point by point, and halvings a round


def _square(cols: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for c in cols:
        total = total + c * c
    return total


def _distance(d: int, left: str = "v", right: str = "w") -> Column:
    return _square([F.col(f"_{left}{i}") - F.col(f"_{right}{i}") for i in range(d)])


def _renamed(df: DataFrame, d: int, **names: str) -> DataFrame:
    return df.withColumnsRenamed({f"_v{i}": f"_w{i}" for i in range(d)} | names)


def _around(reach: int, d: int, half: bool = False) -> Column:
    """Cells in reach of ``_cell``; ``half`` takes each pair of cells once."""
    steps = [o for o in itertools.product(range(-reach, reach + 1), repeat=d) if not half or o > (0,) * d]
    return F.explode(F.array(*[F.array(*[F.col("_cell")[i] + F.lit(o[i]) for i in range(d)]) for o in steps]))


def _near(some: DataFrame, points: DataFrame, cells: DataFrame, d: int, reach: int, eps: float) -> DataFrame:
    """Pairs within ``eps`` of a few points per cell and all points around them; a cell's points are dealt into pieces."""
    pieces = cells.select("_cell", F.ceil(F.col("_m") / PIECE).alias("_pieces"))
    dealt = _renamed(points.join(pieces, "_cell").withColumn("_piece", F.pmod(F.xxhash64("_p"), "_pieces")).drop("_pieces"), d, _p="_q", _n="_k")
    asked = some.select("_p", *[f"_v{i}" for i in range(d)], _around(reach, d).alias("_cell"))
    asked = asked.join(pieces, "_cell").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    return asked.join(dealt, ["_cell", "_piece"]).filter(_distance(d) <= eps * eps)


def _links(core: DataFrame, d: int, reach: int, eps: float, side: float) -> DataFrame:
    """Pairs ``(_a, _b)`` of cells that hold core points within ``eps`` of each other."""
    def boxes(level: int) -> DataFrame:
        sub = F.array(*[F.floor(F.col(f"_v{i}") / side * 2.0 ** level).cast("long") for i in range(d)])
        ends = [f(f"_v{i}").alias(f"_{n}{i}") for i in range(d) for n, f in (("lo", F.min), ("hi", F.max))]
        return core.select("_cell", sub.alias("_sub"), *[f"_v{i}" for i in range(d)]).groupBy("_cell", "_sub").agg(*ends)

    def side_of(table: DataFrame, n: str, level: int, step: int) -> DataFrame:
        up = F.transform("_sub", lambda c: F.shiftright(c, step)).alias(f"_s{n}")
        ends = [F.col(f"_{e}{i}").alias(f"_{e}{n}{i}") for i in range(d) for e in ("lo", "hi")]
        return table.select(F.col("_cell").alias(f"_{n}"), up, F.col("_sub").alias(f"_t{n}"), *ends)

    cells = core.select("_cell").distinct()
    open_ = cells.select(F.col("_cell").alias("_a"), _around(reach, d, half=True).alias("_b")).join(cells.withColumnRenamed("_cell", "_b"), "_b")
    open_ = open_.select("_a", "_b", F.col("_a").alias("_sa"), F.col("_b").alias("_sb"))
    found, level, step = None, 0, 0
    c = lambda n, i: F.col(f"_{n}{i}")
    least = _square([F.greatest(F.lit(0.0), c("loa", i) - c("hib", i), c("lob", i) - c("hia", i)) for i in range(d)])
    most = _square([F.greatest(c("hia", i) - c("lob", i), c("hib", i) - c("loa", i)) for i in range(d)])
    while True:
        table = boxes(level)
        split = open_.join(side_of(table, "a", level, step), ["_a", "_sa"]).join(side_of(table, "b", level, step), ["_b", "_sb"])
        split = cut_lineage(split.select("_a", "_b", F.col("_ta").alias("_sa"), F.col("_tb").alias("_sb"), (most <= eps * eps).alias("_yes"), least.alias("_d")).filter(F.col("_d") <= eps * eps))
        linked = split.filter("_yes").select("_a", "_b").distinct()
        found = linked if found is None else found.union(linked)
        open_ = split.filter("not _yes").drop("_yes", "_d").join(linked, ["_a", "_b"], "left_anti")
        if open_.isEmpty():
            return found
        if level >= SPLITS:
            at = core.select("_cell", F.array(*[F.floor(F.col(f"_v{i}") / side * 2.0 ** level).cast("long") for i in range(d)]).alias("_sub"), *[f"_v{i}" for i in range(d)])
            pairs = open_.join(at.withColumnsRenamed({"_cell": "_a", "_sub": "_sa"}), ["_a", "_sa"]).join(_renamed(at, d, _cell="_b", _sub="_sb"), ["_b", "_sb"])
            return found.union(pairs.filter(_distance(d) <= eps * eps).select("_a", "_b").distinct())
        level, step = level + STEP, STEP


def components(edges: DataFrame) -> DataFrame:
    """``(_u, _root)`` for every node of edges ``(_u, _v)`` of numbers but the smallest of each component."""
    def to_smallest(table: DataFrame) -> DataFrame:
        return table.join(table.groupBy("_u").agg(F.min("_v").alias("_least")), "_u")

    edges, before = edges.select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")).filter("_u > _v").distinct(), None
    while True:
        both = edges.union(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        large = to_smallest(both).filter("_v > _u").select(F.col("_v").alias("_u"), F.least("_u", "_least").alias("_v")).distinct()
        small = to_smallest(large)
        edges = cut_lineage(small.select("_u", F.col("_least").alias("_v")).union(small.filter("_v > _least").select("_v", "_least")).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("_u", "_v"))).first())
        if now == before:
            return edges.select("_u", F.col("_v").alias("_root"))
        before = now


def density_clusters(df: DataFrame, features: Sequence[str], key: str, eps: float, least: int = 5) -> DataFrame:
    """Adds ``core`` (at least ``least`` rows within ``eps``, itself included) and ``cluster``: the smallest key of the core rows of the
    row's cluster, -1 for noise.  A row that is no core row goes to the smallest cluster with a core row within ``eps``.

    ``key`` is an integer.  Equal rows are one point with a weight.  A row with a missing or infinite feature has neither (NULL).
    """
    d = len(features)
    side = eps / math.sqrt(d) * (1 - 1e-9)
    reach = int(eps / side) + 1
    v = [f"_v{i}" for i in range(d)]
    finite = F.lit(True)
    for c in v:
        finite = finite & F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    rows = df.withColumns({c: F.col(f).cast("double") for c, f in zip(v, features)})
    points = rows.filter(finite).groupBy(*v).agg(F.count(F.lit(1)).alias("_n"), F.min(key).cast("long").alias("_p"))
    points = cut_lineage(points.withColumn("_cell", F.array(*[F.floor(F.col(c) / side).cast("long") for c in v])))
    cells = cut_lineage(points.groupBy("_cell").agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_m")))
    few = points.join(cells.filter(F.col("_rows") < least).select("_cell"), "_cell", "left_semi")
    counts = _near(few, points, cells, d, reach, eps).groupBy("_p").agg(F.sum("_k").alias("_within"))
    judged = points.join(cells.select("_cell", (F.col("_rows") >= least).alias("_full")), "_cell").join(counts, "_p", "left")
    judged = cut_lineage(judged.withColumn("core", F.col("_full") | F.coalesce(F.col("_within") >= least, F.lit(False))).drop("_full", "_within"))
    core = judged.filter("core")
    names = core.groupBy("_cell").agg(F.min("_p").alias("_name"))
    edges = _links(core, d, reach, eps, side).join(names.withColumnsRenamed({"_cell": "_a", "_name": "_u"}), "_a").join(names.withColumnsRenamed({"_cell": "_b", "_name": "_v"}), "_b")
    roots = components(edges.select("_u", "_v"))
    labels = cut_lineage(names.join(roots, F.col("_name") == F.col("_u"), "left").select("_cell", F.coalesce("_root", "_name").alias("cluster")))
    inner = core.join(labels, "_cell")
    edge = _near(judged.filter("not core"), inner, cells, d, reach, eps).groupBy("_p").agg(F.min("cluster").alias("cluster"))
    outer = judged.filter("not core").join(edge, "_p", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long")))
    known = inner.select(*v, "core", "cluster").union(outer.select(*v, "core", "cluster"))
    return rows.join(known, v, "left").select(*[F.col(c) for c in df.columns], "core", "cluster")


def cluster_scores(df: DataFrame, features: Sequence[str], out: str = "cluster_score") -> DataFrame:
    """1 for noise, else the distance to the mean of the row's cluster over the largest one in it; 0 where all rows are equal."""
    means = attach_group_stats(df, ["cluster"], [F.avg(F.col(f).cast("double")).alias(f"_mean{i}") for i, f in enumerate(features)])
    far = means.withColumn("_far", F.sqrt(_square([F.col(f).cast("double") - F.col(f"_mean{i}") for i, f in enumerate(features)])))
    far = attach_group_stats(far, ["cluster"], [F.max("_far").alias("_most")])
    score = F.when(F.col("cluster") == -1, 1.0).when(F.col("cluster").isNotNull(), F.coalesce(F.try_divide("_far", "_most"), F.lit(0.0)))
    return far.withColumn(out, score).select(*df.columns, out)
