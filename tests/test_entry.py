"""Every query with SQL equals it at the smallest scale, where the tables are at hand."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


def rows(frame):
    def value(v):
        if isinstance(v, (list, np.ndarray)):
            return tuple(map(float, v))
        if pd.isna(v):
            return None
        if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)):
            return round(float(v), 5) + 0.0
        return str(v)

    return sorted(repr(tuple(value(v) for v in row)) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None))


def test_names():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    ours, theirs = entry.queries()[name](spark, FOLDER).toPandas(), con.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
