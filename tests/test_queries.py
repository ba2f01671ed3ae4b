"""Each query without the llm subpackage over the smallest tables, against its SQL."""

import glob
import math
import os

import duckdb
import pytest

from ledgermesh.plans import queries as Q

from .conftest import SF

NAMES = sorted(Q.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    frame = Q.queries()[name](spark, SF)
    names = sorted(frame.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    if name not in Q.oracle_sql():
        assert rows
        return
    result = duck.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall()) == rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "rank", "name"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
