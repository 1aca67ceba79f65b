"""Every registered base query against its SQL on DuckDB."""

import duckdb
import pytest

from tesserine.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def cell(v):
    if v is None or str(v) in ("<NA>", "nan", "NaT"):
        return "-"
    return float(v) if hasattr(v, "__float__") and not isinstance(v, (bool, str)) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(map(cell, r))) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalogue.queries()[name](spark, sf_dir).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    assert rows(got) == rows(duck.execute(sql).df())
