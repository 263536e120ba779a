"""Every query with SQL gives the SQL's rows; the others run."""

import pytest

from tests.oracle import assert_same, duck
from tidelake.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, db, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        assert_same(df, db, SQL[name])
    else:
        assert df.count() >= 0 and df.columns


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_a_panel_of_one_symbol(spark, data):
    from tidelake.plans import dashboards

    whole = dashboards.panel("panel_close_price")(spark, data).collect()
    symbol = whole[0]["symbol"]
    one = dashboards.panel("panel_close_price", symbol)(spark, data).collect()
    assert one == [r for r in whole if r["symbol"] == symbol] and 0 < len(one) < len(whole)
    assert [r["h"] for r in one] == sorted(r["h"] for r in one)


def test_queries_without_sql_are_few():
    assert set(QUERIES) - set(SQL) == set()
