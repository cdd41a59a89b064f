"""Registered queries against their oracle SQL on the smallest test tables."""

import duckdb
import pytest

import __spark_entry__ as E
from scripts.oracle_check import TABLES, norm
from tests.conftest import SF001

SKIP = {n for n in E.queries() if n.startswith("ml_") and n not in E.oracle_sql()} | {"t_generate"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF001)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    srows = [tuple(r) for r in sdf.collect()]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _canon(srows, sdf.columns) == _canon(drows, dcols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["bill_id", "bill_type", "originchamber", "createdate", "updatedate",
                          "introduceddate", "no_days", "party", "state", "ac_count", "status"]
