"""Every registered query that has SQL gives the SQL's rows; the others give rows."""

import glob
import math
import os

import duckdb
import pytest

from tonewake.plans import catalog


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v) + 0.0:.6g}"
    return str(v)[:10] if hasattr(v, "year") else str(v)


#: Queries over complete cases of the analysis table, of which the smallest tables have too few.
LARGER = {"analysis_ready", "bonferroni_pools", "overview", "regression_models", "robustness", "sector_in_range", "signal_correlations"}


@pytest.fixture(scope="module")
def duck():
    made = {}

    def connect(sf):
        if sf not in made:
            made[sf] = duckdb.connect()
            for f in glob.glob(f"{sf}/*.parquet"):
                made[sf].sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        return made[sf]

    return connect


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    if name in LARGER:
        sf = sf.replace("sf0.001", "sf0.01")
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    assert got or name not in LARGER
    made = duck(sf).sql(catalog.ORACLES[name])
    at = [made.columns.index(c) for c in columns]
    assert sorted(made.columns) == columns
    assert got == sorted(tuple(value(r[i]) for i in at) for r in made.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
