"""Density clusters against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clusters as C


def brute_force(x, ids, eps, least):
    near = sum((x[:, None, i] - x[None, :, i]) ** 2 for i in range(x.shape[1])) <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, ids, np.iinfo(np.int64).max)
    while True:
        new = np.where(core, np.where(near & core[None, :], label[None, :], np.iinfo(np.int64).max).min(1), label)
        if (new == label).all():
            break
        label = new
    reached = np.where(near & core[None, :], label[None, :], np.iinfo(np.int64).max).min(1)
    return core, np.where(core, label, np.where(reached < np.iinfo(np.int64).max, reached, -1))


def data(d):
    rng = np.random.default_rng(d)
    blobs = [rng.normal(c, .3, (90, d)) for c in (0., 1.6, 5.)]
    lattice = np.stack(np.meshgrid(*[np.arange(4.) * .5 + 10] * d), -1).reshape(-1, d)  # neighbours exactly eps apart
    x = np.concatenate([*blobs, lattice, rng.uniform(-3, 12, (120, d)), np.full((60, d), 5.1), np.full((7, d), -7.)])
    return x, rng.permutation(len(x)).astype(np.int64)


@pytest.mark.parametrize("d, eps, least", [(1, .05, 6), (2, .5, 5), (3, .5, 4)])
def test_density_clusters(spark, d, eps, least, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 20)
    x, ids = data(d)
    names = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(ids, x)], "id bigint, " + ", ".join(f"{n} double" for n in names))
    core, label = brute_force(x, ids, eps, least)
    got = {r.id: (r.core, r.cluster) for r in C.density_clusters(df, names, "id", eps, least).collect()}
    assert len(got) == len(ids) and len(set(label.tolist())) > 3
    for i, c, n in zip(ids.tolist(), core.tolist(), label.tolist()):
        assert got[i] == (c, n), i


def test_boxes_left_open_are_settled_point_by_point(spark, monkeypatch):
    monkeypatch.setattr(C, "SPLITS", 0)
    x, ids = data(2)
    df = spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(ids, x)], "id bigint, a double, b double")
    got = {r.id: r.cluster for r in C.density_clusters(df, ["a", "b"], "id", .5, 5).collect()}
    assert [got[i] for i in ids.tolist()] == brute_force(x, ids, .5, 5)[1].tolist()


def test_missing_values_scores_and_empty_tables(spark):
    rows = [(i, 0.0, 0.0) for i in range(6)] + [(6, 0.2, 0.0), (7, None, 1.0), (8, float("inf"), 1.0), (9, 50.0, 50.0), (10, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    out = C.cluster_scores(C.density_clusters(df, ["a", "b"], "id", 1.0, 4), ["a", "b"])
    got = {r.id: (r.core, r.cluster, r.cluster_score) for r in out.collect()}
    assert got[7] == got[8] == got[10] == (None, None, None) and got[9] == (False, -1, 1.0) and got[6] == (True, 0, 1.0)
    assert len(got) == 11 and got[0][:2] == (True, 0) and 0 < got[0][2] < 1
    assert C.density_clusters(df.filter(F.lit(False)), ["a", "b"], "id", 1.0).count() == 0
