"""The llm queries run over the test tables, and agree with their SQL where they have it."""

import datetime as dt

import pytest

from tests.oracle import assert_same, duck
from tidelake.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        assert_same(df, duck(data), SQL[name])
    else:
        assert df.count() > 0


def test_fills_meet_symbols_of_other_spellings(spark, tmp_path):
    at = lambda s: dt.datetime(2016, 1, 5, 10, 0, s, tzinfo=dt.timezone.utc)
    spellings = ["DELQ-USQ", "delq/usq", " Delq_Usq ", "DELQUSQ", "D.E.L.Q USQ", "TANQ/USQ", "-/", None]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(f"o{i}", s, at(10), at(20)) for i, s in enumerate(spellings)], "order_id string, symbol string, filled_at timestamp, updated_at timestamp", "processed_orders")
    write([("DELQUSQ", at(11), 1), ("TANQ-USQ", at(9), 2), ("/", at(10), 3), (None, at(10), 4)], "symbol string, trade_time timestamp, trade_id bigint", "processed_trades")
    write([("delq usq", "1m", at(0)), ("DELQUSQX", "1m", at(10))], "symbol string, interval string, open_time timestamp", "processed_klines")
    want = {(f"o{i}", "processed_trades", 1) for i in range(5)} | {(f"o{i}", "processed_klines", int(at(0).timestamp() * 1000)) for i in range(5)} | {("o5", "processed_trades", 2)}
    out = [tuple(r) for r in QUERIES["p7_found"](spark, str(tmp_path)).collect()]
    assert set(out) == want and len(out) == len(want)
    assert {tuple(r)[:3] for r in QUERIES["p7_nearest"](spark, str(tmp_path)).collect()} == want


def test_registered_only_if_there():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and "p1_found" in entry.queries()
