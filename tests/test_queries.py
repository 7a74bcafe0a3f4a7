"""Every registered query runs and, where it has SQL, equals what DuckDB computes from the same tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# trained models and forests have their own tests; at this size they only cost time here
SLOW = ("ml_05", "ml_06", "ml_07", "ml_17", "preset_enhanced", "preset_residual", "preset_spectral", "preset_robust", "preset_causal", "preset_baseline")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    pdf = pdf.where(pdf.notna(), None)
    return sorted((tuple(r) for r in pdf.itertuples(index=False)), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return abs(a - b) <= 2e-5 * max(1.0, abs(b))
    return a == b


@pytest.mark.parametrize("name", [n for n in contract.queries() if not n.startswith(SLOW)])
def test_query(spark, db, name):
    df = contract.queries()[name](spark, SF)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    cur = db.execute(sql)
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    bad = [(a, b) for a, b in zip(rows(got), rows(want)) if not all(same(x, y) for x, y in zip(a, b))]
    assert not bad, bad[:3]


def test_entry(spark):
    assert contract.entry(spark).count() > 0
