"""Each core query against its SQL, on the smallest data, and without rows."""

import glob
import os

import duckdb
import pytest

from lexloom.plans import registry


def _normal(rows):
    show = lambda v: "%.6g" % v if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = _normal(tuple(r) for r in df.select(*cols).collect())
    if name in registry.ORACLES:
        want = _normal(duck.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({registry.ORACLES[name]})").fetchall())
        assert got == want
    else:
        assert got


@pytest.fixture(scope="session")
def empty(spark, data, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for f in glob.glob(f"{data}/*.parquet"):
        spark.read.parquet(f).limit(0).write.parquet(f"{at}/{os.path.basename(f)}")
    return str(at)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_on_empty_tables(spark, empty, name):
    registry.QUERIES[name](spark, empty).collect()
