"""Every registered query of the reference's operators against its SQL, or for rows where SQL can't express it."""

import pytest

from quadrille.plans import queries as plans

from .compare import duck, same

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def own(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, own, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert same(df, own, SQL[name]) is None
    else:
        assert df.columns and df.count() > 0


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)
