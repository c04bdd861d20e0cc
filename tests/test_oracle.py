"""Every registered query against its SQL on the smallest tables; queries without SQL must run."""

import glob
import os

import pytest

from assayer import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def canon(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in plans.oracle_sql():
        return
    out = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = sorted((tuple(canon(r[names.index(c)]) for c in cols) for r in out.fetchall()), key=repr)
    assert got == want


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(plans.queries()) <= set(entry.queries())
