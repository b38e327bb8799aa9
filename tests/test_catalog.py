"""Every query with SQL gives the same rows, names and types as DuckDB over the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from braidgraph import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if isinstance(x, float) and not pd.isna(x):
            return f"{x:.9g}"
        return "-" if x is None or x is pd.NA or isinstance(x, float) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    ours, theirs = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


def test_every_query_runs(spark, sf_dir):
    for name in set(catalog.QUERIES) - set(catalog.ORACLES):
        assert catalog.QUERIES[name](spark, sf_dir).columns


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 1


def test_filters_reach_the_scan(spark, sf_dir):
    plan = catalog.QUERIES["imported_by_count"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(type" in plan
    assert "metadata" not in plan  # pruned
