"""Every registered query of the engine against its SQL twin, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from loomdex.plans import catalogue, catalogue_more  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in sorted(Path(DATA).glob("*.parquet")):
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def test_every_query_has_a_twin():
    assert set(catalogue.ORACLES) == set(catalogue.QUERIES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    got = sorted((tuple(clean(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(clean(r[i]) for i in at) for r in want.fetchall()), key=repr)
