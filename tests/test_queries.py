"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from pipeweave.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(v[i], 6) if isinstance(v[i], float) else v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", ["f35_depth_factor", "f39_piece_cost", "f49_depth_cost"])
def test_rounding_over_more_rows(spark, name):
    """Halves that fall between two whole numbers are rare: the larger tables hold some."""
    con, large = duckdb.connect(), DATA.replace("0.001", "0.01")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{large}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, large)
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name not in catalog.ORACLES:
        assert got
        return
    found = oracle.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(found.fetchall(), names)
