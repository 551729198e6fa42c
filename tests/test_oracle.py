"""Registered queries against their DuckDB oracle on the sf0.001 tables."""

import pytest

from support import SF001
from nearmark.plans import oracle, queries
from oracle_compare import compare, duck

ALL = sorted(oracle.SQL)


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", ALL)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    srows = [tuple(r[c] for c in cols) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    ok, msg = compare(srows, [tuple(r[i] for i in idx) for r in res.fetchall()])
    assert ok, msg


def test_every_query_has_oracle_or_is_iterative():
    assert set(queries.registered()) - set(oracle.SQL) == {"train_model"}
