"""Every registered query against its DuckDB oracle on the smallest scale."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from queuelens import catalog
from tools.compare import close, duck, rows_of

ORACLE = catalog.ORACLE
QUERIES = {k: fn for k, fn in entry.queries().items() if k in catalog.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(ORACLE[name])
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    a, b = rows_of(srows, sdf.columns), rows_of(drows, rel.columns)
    assert len(a) == len(b)
    assert all(close(x, y) for x, y in zip(a, b))


def test_every_query_has_oracle_or_is_model():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only <= {"gbt_metrics", "feature_importance"}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["split", "rows", "avg_queue_delay"]
    assert sum(r.rows for r in rows) > 0
