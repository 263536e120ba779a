"""Merge, store, dedup, quality, gaps, parsing, streams, pipeline."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelake.operators import dedup, gaps, lifecycle, merge, parse, quality
from tidelake.plans import pipeline
from tidelake.schemas import TABLES, TableSpec
from tidelake.sources import readers
from tidelake.store import Table, maintain
from tidelake.streaming import ingest


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def ts(s):
    return dt.datetime.fromisoformat(s)


@pytest.mark.parametrize(("off", "close"), [(6, 2), (5, 2), (4, 1)])
def test_guard_lets_equal_and_newer_through(spark, off, close):
    target = spark.createDataFrame([("k", 5, 1), (None, 1, 7)], "key string, off int, close int")
    source = spark.createDataFrame([("k", off, 2), ("n", 1, 3), (None, 9, 8)], "key string, off int, close int")
    out = got(merge.upsert(target, source, ["key"], guard=merge.not_older("off")).fillna("null", ["key"]), "key", "close")
    assert out == [("k", close), ("n", 3), ("null", 7), ("null", 8)]


def test_merge_refuses_two_source_rows_for_a_key(spark):
    target = spark.createDataFrame([("k", 1)], "key string, v int")
    source = spark.createDataFrame([("k", 2), ("k", 3)], "key string, v int")
    with pytest.raises(Exception, match="more than one source row"):
        merge.upsert(target, source, ["key"]).collect()


def test_merge_into_and_from_nothing(spark):
    rows = spark.createDataFrame([("k", 1)], "key string, v int")
    assert got(merge.upsert(rows.limit(0), rows, ["key"]), "key", "v") == got(merge.upsert(rows, rows.limit(0), ["key"]), "key", "v") == [("k", 1)]


def test_latest_by_ties_nulls_and_clashing_names(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), (None, 1, "q"), ("b", 1, "m"), ("b", 1, "n")]
    df = spark.createDataFrame(rows, "k0 string, o int, r string")
    one = got(dedup.latest_by(df, ["k0"], [F.col("o")]).fillna("null"), "k0", "r")
    assert one == got(dedup.latest_by(df.repartition(3), ["k0"], [F.col("o")]).fillna("null"), "k0", "r")
    assert one[0] == ("a", "y") and one[2] == ("null", "q") and len(one) == 3


def test_ingest_window_is_half_open_and_prunes_dates(spark, tmp_path):
    times = ["2016-01-03 23:59:59.999999", "2016-01-04 00:00:00", "2016-01-04T23:59:59.999999Z", "2016-01-05 09:00:00+09:00", "2016-01-05 00:00:00.5"]
    df = spark.createDataFrame([(i, t, t[:10]) for i, t in enumerate(times)], "i int, ingest_time string, ingest_date string")
    df.write.partitionBy("ingest_date").parquet(str(tmp_path / "raw"))
    out = readers.raw_window(spark, str(tmp_path / "raw"), "2016-01-04 00:00:00", "2016-01-05 00:00:00")
    assert [r["i"] for r in out.orderBy("i").collect()] == [1, 2]
    assert "PartitionFilters: [isnotnull(ingest_date" in out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


SPEC = TableSpec("id bigint, day timestamp, v bigint", ("id",), "upsert", "v", "day")


def test_store_rewrites_only_touched_days_and_travels_in_time(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", SPEC)
    rows = lambda *x: spark.createDataFrame([(i, d and ts(d), v) for i, d, v in x], "id bigint, day timestamp, v bigint")
    assert t.read().count() == 0 and t.files().count() == 0
    t.append(rows((1, "2024-01-01", 1), (2, "2024-01-02", 1), (3, None, 1)))
    before = {p.day: p.path for p in t.parts()}
    t.merge(rows((1, "2024-01-03", 2), (4, "2024-01-03", 1), (2, "2024-01-02", 0)))  # 1 moves to another day; 2 is older than the table's
    after = {p.day: p.path for p in t.parts()}
    assert got(t.read(), "id", "v") == [(1, 2), (2, 1), (3, 1), (4, 1)]
    assert after["none"] == before["none"] and "2024-01-01" not in after
    assert got(t.read(snapshot=1), "id", "v") == [(1, 1), (2, 1), (3, 1)]
    t.update(F.col("id") == 4, {"v": F.lit(9)})
    t.delete(F.col("v") == 1)
    assert got(t.read(), "id", "v") == [(1, 2), (4, 9)]
    t.compact()
    assert got(t.read(), "id", "v") == [(1, 2), (4, 9)]
    assert [r["operation"] for r in t.snapshots().orderBy("snapshot_id").collect()] == ["append", "merge", "update", "delete", "compact"]
    assert t.expire(2**60, keep_last=2) == 3 and t.snapshots().count() == 2 and t.read().count() == 2
    h = t.health().first()
    assert h["record_count"] == 2 and h["snapshot_count"] == 2
    assert maintain({"t": t, "broken": Table(spark, f"file://{tmp_path}/none", SPEC)}, 0)[0] == ("t", "compact", "ok")


def test_store_token_and_added_column(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", TableSpec("id bigint, v bigint"))
    df = spark.createDataFrame([(1, 2)], "id bigint, v bigint")
    t.append(df, token="a")
    t.append(df, token="a")
    t.append(df.limit(0), token="b")
    assert t.read().count() == 1 and t.snapshots().count() == 1
    wider = Table(spark, t.path, TableSpec("id bigint, extra string, v bigint"))
    wider.append(spark.createDataFrame([(2, "x", 3)], "id bigint, extra string, v bigint"))
    assert [(r["id"], r["extra"]) for r in wider.read().orderBy("id").collect()] == [(1, None), (2, "x")]


def test_store_deletes_by_position_and_folds_them(spark, tmp_path):
    from tidelake.store import watched

    t = Table(spark, f"file://{tmp_path}/t", SPEC)
    rows = lambda *x: spark.createDataFrame([(i, d and ts(d), v) for i, d, v in x], "id bigint, day timestamp, v bigint")
    t.append(rows(*[(i, f"2024-01-0{1 + i % 3}", i) for i in range(30)]))
    t.append(rows((100, "2024-01-01", 1), (101, None, 1)))
    paths = {p.path for p in t.parts()}
    t.delete(F.col("id") < 4)
    t.update(F.col("v") == 7, {"v": F.lit(70)})
    t.delete(F.col("id") == 999)  # nothing to delete, nothing committed
    assert paths < {p.path for p in t.parts()} and t.snapshots().count() == 4
    want = sorted([(i, 70 if i == 7 else i) for i in range(4, 30)] + [(100, 1), (101, 1)])
    assert got(t.read(), "id", "v") == want and got(t.read(snapshot=2), "id")[0] == (0,)
    h = t.health().first()
    assert h["position_delete_file_count"] >= 2 and h["delete_to_data_file_ratio"] == h["position_delete_file_count"] / h["data_file_count"] and h["manifest_count"] == 4
    t.merge(rows((5, "2024-01-03", 500), (1, "2024-01-02", 10)))
    want = sorted({**dict(want), 5: 500, 1: 10}.items())
    assert got(t.read(), "id", "v") == want
    assert t.manifests().agg(F.sum("delete_parts").alias("n")).first()["n"] == 2
    lab = {r["stage"]: r for r in watched(t, {"fold": Table.fold_deletes, "manifests": Table.rewrite_manifests, "compact": lambda x: x.compact()}, lambda df: df.groupBy("day").count()).collect()}
    assert lab["before"]["delete_files"] > 0 and lab["fold"]["delete_files"] == 0 and lab["manifests"]["manifests"] == 1 and lab["compact"]["data_files"] <= lab["before"]["data_files"]
    assert got(t.read(), "id", "v") == want and t.compact() == 0
    assert t.history(3).first()["operation"] in ("compact", "manifests")


def test_store_compacts_by_size_and_keeps_tokens(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", TableSpec("id bigint, day timestamp", days="day"))
    for k in range(4):
        t.append(spark.range(2000).select("id", F.lit(ts("2024-01-01") if k else ts("2024-01-02")).alias("day")).repartition(3), token=f"stream/{k}")
    t.append(spark.range(1).select("id", F.lit(ts("2024-01-03")).alias("day")), token="whole")
    untouched = {p.path for p in t.parts() if p.day == "2024-01-03"}
    size = sum(f["file_size_in_bytes"] for f in t.files().collect() if "2024-01-01" in f["file_path"])
    t.compact(size // 2)
    files = [f["file_path"] for f in t.files().collect()]
    assert t.read().count() == 8001 and 2 <= sum("2024-01-01" in f for f in files) <= 3 and untouched <= {p.path for p in t.parts()}
    assert t.expire(2**60, keep_last=1) == 5
    for token in ("stream/0", "stream/3", "whole"):
        t.append(spark.range(5).select("id", F.lit(None).cast("timestamp").alias("day")), token=token)
    assert t.read().count() == 8001
    t.append(spark.range(5).select("id", F.lit(None).cast("timestamp").alias("day")), token="stream/4")
    assert t.read().count() == 8006
    t.delete(F.col("id") == 0)  # an append table: the folders with such rows are rewritten
    assert t.read().count() == 8006 - 6 and t.health().first()["position_delete_file_count"] == 0


def test_catalog_and_health_summary(spark, tmp_path):
    from tidelake.store import Catalog, health_summary

    c = Catalog(spark, f"file://{tmp_path}/lake")
    assert c.namespaces() == []
    c.create_namespace("gold")
    c.create_namespace("gold")
    t = c.table("gold.orders", TABLES["processed_orders"])
    assert c.namespaces() == ["gold"] and c.tables("gold") == ["orders"]
    assert dict(got(c.properties("gold.orders"), "key", "value"))["mode"] == "upsert"
    broken = Table(spark, f"file://{tmp_path}/b", SPEC)
    broken._put("log/000000000001.json", {"id": 1, "manifests": ["gone.json"]})
    failed = []
    out = health_summary({"orders": t, "broken": broken}, "r1", lambda name, _: failed.append(name))
    assert failed == ["broken"] and got(out, "table_name", "data_file_count", "delete_to_data_file_ratio") == [("orders", 0, 0.0)]
    assert set(out.columns) == {f.name for f in TABLES["table_health_summary"].schema.fields}
    assert c.drop("gold.orders") and c.tables("gold") == []


def test_lifecycle_ties_late_events_and_policies(spark):
    ev = lambda *x: spark.createDataFrame([(o, s, ts(t), n, c) for o, s, t, n, c in x], "order_id string, order_status string, event_time timestamp, source_offset bigint, client_id string")
    rows = ev(("a", "FILLED", "2024-01-01 02:00", 1, "c"), ("a", "NEW", "2024-01-01 01:00", 2, "c"), ("b", "PARTIALLY_FILLED", "2024-01-01 03:00", 9, "c"), ("b", "FILLED", "2024-01-01 03:00", 1, "c"), ("c", "PARTIALLY_FILLED", "2024-01-01 01:00", 1, "c"), ("c", "CANCELED", "2024-01-01 02:00", 2, "c"))
    out = {r["order_id"]: r for r in lifecycle.fold(rows, ["client_id"]).collect()}
    assert (out["a"]["order_status"], out["a"]["created_at"].hour, out["a"]["filled_at"].hour) == ("FILLED", 1, 2)
    assert out["b"]["order_status"] == "FILLED" and out["c"]["canceled_at"].hour == 2
    target = lifecycle.fold(rows.filter("order_id = 'a'"), ["client_id"])
    late = lifecycle.fold(ev(("a", "CANCELED", "2024-01-01 05:00", 5, "d")), ["client_id"])
    kept = lifecycle.carry_forward(target, late).first()
    assert (kept["order_status"], kept["filled_at"].hour, kept["created_at"].hour) == ("CANCELED", 2, 1)
    assert lifecycle.rebuild(target, late).first()["filled_at"] is None


# quality


def test_lag_percentiles_are_exact(spark):
    # more values than any sketch keeps: 3 million distinct lags in one group, ranks by hand
    n = 3_000_001
    many = spark.range(n).select(F.lit("hot").alias("symbol"), (F.col("id") * 7 % n - 1000).alias("lag_ms"))
    few = spark.createDataFrame([("a", 5), ("a", 5), ("a", -3), ("a", None), (None, 4), ("b", None)], "symbol string, lag_ms bigint")
    out = {r["symbol"]: tuple(r)[1:] for r in quality.lag_percentiles(many.unionByName(few), ["symbol"]).collect()}
    rank = lambda p: (p * n + 99) // 100 - 1 - 1000
    assert out == {"hot": (n, rank(50), rank(95), rank(99), -1000, n - 1001), "a": (3, 5, 5, 5, -3, 5), None: (1, 4, 4, 4, 4, 4), "b": (0, None, None, None, None, None)}


def lags(spark, p95, worst):
    return spark.createDataFrame([("d", p95, worst)], "label string, p95 bigint, worst bigint")


@pytest.mark.parametrize(("p95", "worst", "want"), [(26000, 27000, [("CRITICAL", 26000.0)]), (12000, 16000, [("WARN", 16000.0)]), (9000, 13000, []), (15000, 15000, []), (None, None, [])])
def test_freshness(spark, p95, worst, want):
    assert got(quality.freshness(lags(spark, p95, worst), "label", "p95", "worst", 15000), "severity", "observed") == want


@pytest.mark.parametrize(("ids", "step", "want"), [([1, 2, 3, 7, 8], 1, [(3, 7, 3)]), ([0, 60000, 180000], 60000, [(60000, 180000, 1)]), ([3, 1, 2, 3], 1, []), ([], 1, [])])
def test_gap_segments(spark, ids, step, want):
    df = spark.createDataFrame([("d", i) for i in ids] + [("d", None), (None, 4)], "dim string, id bigint")
    assert got(quality.gap_segments(df, "dim", "id", step, block=2), "before", "after", "missing") == want


def test_gap_threshold_and_bad_step(spark):
    df = spark.createDataFrame([("d", i) for i in (1, 2, 6)], "dim string, id bigint")
    assert [quality.gaps(df, "dim", "id", 1, n).count() for n in (3, 2)] == [0, 1]
    with pytest.raises(ValueError):
        quality.gap_segments(df, "dim", "id", 0)


@pytest.mark.parametrize(("values", "want"), [([1, 2, 5, 3, 6], [(1, 5, 3)]), ([1, 2, 2, 3], []), ([3, 2, 1], [(2, 3, 2)])])
def test_reversals(spark, values, want):
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate(values)], "dim string, ord bigint, v bigint")
    counted = quality.reversal_counts(df, "dim", "ord", "v", block=2).filter("reversals > 0")
    assert got(counted, "reversals", "first_before", "first_after") == want
    assert quality.reversals(df, "dim", "ord", "v").count() == len(want)


def test_null_or_zero_drift_and_alert(spark):
    df = spark.createDataFrame([(None, "0"), (Decimal(1), "x"), (None, "2")], "price decimal(20,8), qty string")
    out = quality.null_or_zero(df, "t", ["price", "qty"]).collect()
    assert sorted((r["dimension"], r["observed"]) for r in out) == [("t.price", 2.0), ("t.qty", 2.0)]
    drift = quality.schema_drift(df.withColumn("new", F.lit(1)), "t", {"price": "double", "qty": "string", "gone": "bigint"})
    assert sorted((r["dimension"], r["severity"]) for r in drift.collect()) == [("t.gone", "CRITICAL"), ("t.new", "WARN"), ("t.price", "CRITICAL")]
    assert quality.schema_drift(df, "t", {"price": "decimal(20,8)", "qty": "string"}).count() == 0
    stamped = quality.stamp(drift, "r", "t")
    assert stamped.columns == [f.name for f in TABLES["quality_events"].schema.fields]
    rows = [r.asDict() for r in drift.collect()]
    assert quality.alert_text([]) and quality.send_alert([])["reason"] == "no_anomalies" and quality.send_alert(rows)["reason"] == "no_webhook_configured"
    assert "and 6 more" in quality.alert_text([rows[0]] * 16) and quality.send_alert(rows, lambda _: None)["sent"]
    assert not quality.send_alert(rows, lambda _: 1 / 0)["sent"]


def test_table_check(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "k string, v int")
    r = quality.table_check(df, "t", ["k"], ["k"]).first()
    assert (r["row_count"], r["null_count"], r["duplicate_count"], r["check_status"]) == (3, 1, 2, "FAIL")
    assert quality.table_check(df.limit(0), "t", ["k"], ["k"]).first()["check_status"] == "PASS"


def test_hour_gaps_and_backfill(spark):
    df = spark.createDataFrame([("x", ts("2024-01-01 00:10")), ("x", ts("2024-01-01 03:00")), ("y", ts("2024-01-01 01:00")), ("x", None)], "s string, h timestamp")
    miss = gaps.missing_hours(df, "s", "h")
    assert [r["missing_hour"].hour for r in miss.orderBy("missing_hour").collect()] == [1, 2]
    assert gaps.backfill_day(miss) == ("2024-01-01 00:00:00", "2024-01-02 00:00:00") and gaps.backfill_day(miss.limit(0)) is None
    assert got(gaps.coverage(df, "s", "h"), "symbol", "missing") == [("x", 2), ("y", 0)]


# sources


def test_frames(spark):
    agg = {"stream": "x", "data": {"e": "aggTrade", "E": 5, "s": "BTCUSDT", "a": 7, "p": "20000.00", "q": "0.005", "T": 4, "m": True, "M": True}}
    bar = {"e": "kline", "E": 5, "k": {"t": 1, "T": 2, "s": "BTCUSDT", "i": "1m", "o": "1", "c": "2", "h": "3", "l": "1", "v": "5.0", "n": 100, "x": False, "q": "9", "V": "1", "Q": "2", "B": "0"}}
    bad = ["not json", "{}", '{"result": null, "id": 1}', '{"e": "depthUpdate"}', None]
    out = [r.asDict() for r in parse.exchange_frames(spark.createDataFrame([(json.dumps(agg),), (json.dumps(bar),), *[(b,) for b in bad]], "value string")).collect()]
    assert [r["message_key"] for r in out] == ["BTCUSDT", "BTCUSDT_1m"]
    trade, kline = (json.loads(r["message_value"]) for r in out)
    assert float(trade["quote_qty"]) == 100.0 and trade["is_buyer_maker"] == "True" and trade["trade_id"] == "7"
    assert kline["is_closed"] is False and kline["open_time"] == "1"


def test_csv_arity_and_anchor(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,2,3,4,5,True,True\n1,2,3\n9,2,3,4,5,True,True,extra\n")
    assert readers.strict_csv(spark, str(tmp_path / "t.csv"), readers.TRADE_CSV).count() == 1
    (tmp_path / "a.csv").write_text("open_time_ms,close,volume\n1704067200000,42000.0,10.0\n1704067260000,42100.0,5.0\n1704067320000,41900.0,20.0\n1704067330000,0,20.0\n")
    assert [r["close"] for r in readers.anchor_frame(spark, str(tmp_path / "a.csv"), 1704067260000, 1704067380000).collect()] == [42100.0, 41900.0]
    assert readers.existing(spark, [str(tmp_path / "t.csv"), str(tmp_path / "no.csv")]) == [str(tmp_path / "t.csv")]


def test_stream_url():
    assert readers.stream_url("wss://h", ["aggTrade"], ["BTCUSDT"]).endswith("btcusdt@aggTrade")
    for streams, symbols in ((["aggTrade"], []), (["depth"], ["a"]), (["aggTrade"], [f"s{i}" for i in range(1025)])):
        with pytest.raises(ValueError):
            readers.stream_url("wss://h", streams, symbols)


def test_dirty_payloads_become_null(spark):
    rows = [("k", '{"trade_id": "1", "price": "abc", "qty": "1e400", "time": "zz", "symbol": "btc", "is_buyer_maker": "True"}'), ("key", '{"trade_id": 2}'), (None, '{"trade_id": 3}'), ("k", "broken")]
    raw = spark.createDataFrame([("t", 0, i, 0, k, m, "x") for i, (k, m) in enumerate(rows)], TABLES["raw_trades"].schema)
    out = [(r["trade_id"], r["symbol"], r["price"], r["qty"], r["trade_time"], r["is_buyer_maker"]) for r in parse.trades(raw).orderBy("trade_id").collect()]
    assert out == [(1, "BTC", None, None, None, True), (2, "KEY", None, None, None, None)]


# streams


def test_raw_log_and_lag_stream(spark, tmp_path):
    rows = [("trades", 0, i, ts("2024-01-01"), b"k", b'{"a":1}') for i in range(4)]
    for k in (0, 2):
        spark.createDataFrame(rows[k : k + 2], readers.KAFKA_SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = readers.file_stream(spark, str(tmp_path / "in"), readers.KAFKA_SHAPE, max_files=1)
    ingest.raw_log(stream, str(tmp_path / "raw"), str(tmp_path / "c1"), {"availableNow": True}).awaitTermination()
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert raw.count() == 4 and raw.first()["kafka_timestamp"] == 1704067200
    raw.limit(1).write.mode("append").partitionBy("ingest_date").parquet(str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 5

    trades, samples = (Table(spark, f"file://{tmp_path}/{n}", s) for n, s in (("trades", TableSpec("produce_ts bigint, trade_id string, run_id string")), ("lags", TABLES["lag_samples"])))
    spark.createDataFrame([(1000, "1"), (None, "2"), (2000, "3")], "produce_ts bigint, trade_id string").write.parquet(str(tmp_path / "p"))
    src = readers.file_stream(spark, str(tmp_path / "p"), "produce_ts bigint, trade_id string")
    for _ in range(2):
        ingest.measured(src, trades, samples, str(tmp_path / "c2"), run_id="r", label="base", trigger={"availableNow": True}).awaitTermination()
    assert trades.read().count() == samples.read().count() == 2
    report = ingest.lag_report(samples.read()).collect()
    assert len(report) == 1 and report[0]["samples"] == 2


def test_stream_upsert_equals_batch(spark, tmp_path):
    spec = TableSpec("id bigint, v bigint", ("id",), "upsert", "v")
    rows = [(i % 7, i) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k::4], "id bigint, v bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = Table(spark, f"file://{tmp_path}/t", spec)
    src = readers.file_stream(spark, str(tmp_path / "in"), "id bigint, v bigint", max_files=1)
    ingest.merged(src, t, str(tmp_path / "c"), lambda b: dedup.latest_by(b, ["id"], [F.col("v")])).awaitTermination()
    want = {}
    for i, v in rows:
        want[i] = max(v, want.get(i, -1))
    assert dict(got(t.read(), "id", "v")) == want


# pipeline


def test_order_log_and_sql(spark, tmp_path):
    order = pipeline.in_order()
    assert order.index("market_hourly_summary") < order.index("order_execution_summary") < order.index("table_health")
    with pytest.raises(ValueError):
        pipeline.in_order({"a": ["b"], "b": ["a"]})
    runs = Table(spark, f"file://{tmp_path}/runs", TABLES["pipeline_run_summary"])
    done = []
    with pytest.raises(ZeroDivisionError):
        pipeline.run_all({"processed_trades": lambda: done.append(1), "market_hourly_summary": lambda: 1 / 0, "order_execution_summary": lambda: done.append(2)}, runs, "r1")
    assert done == [1] and got(runs.read(), "task_name", "status") == [("market_hourly_summary", "FAILED"), ("processed_trades", "SUCCESS")]
    pipeline.run_sql(spark, "create temp view one as select ';' as x; -- a ; comment\ncreate temp view two as select * from one;")
    assert spark.table("two").first()["x"] == ";"


def test_period_stream_closes_diverts_and_replays(spark, tmp_path):
    from tidelake.operators.late_periods import Periods
    from tidelake.streaming.late_periods import PeriodStream

    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    at = lambda s: dt.datetime.fromtimestamp(base + s, dt.timezone.utc)
    batches = [
        [("x", at(10), at(20), "a", 1.0), ("x", at(30), at(25), "b", 2.0), ("y", at(70), at(80), "a", 1.0), ("x", None, at(81), "a", 1.0)],
        [("x", at(50), at(121), "b", 4.0), ("x", at(5), at(300), "a", 9.0)],  # the second: its own source is past the bound
        [("x", at(110), at(301), "b", 1.0), ("y", at(119), at(119), "c", 1.0)],  # c is behind, and idle
        [("x", at(15), at(118), "b", 8.0), ("z", at(400), at(900), "a", 1.0)],  # arrives in bound, but the period is closed
    ]
    p = PeriodStream(spark, f"file://{tmp_path}/s", Periods(60, 120, 121), key="k", event_time="t", arrival="a", source="s", value="v")
    frames = [spark.createDataFrame(b, "k string, t timestamp, a timestamp, s string, v double") for b in batches]
    for n, f in enumerate(frames):
        f.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        p.batch(f, f"b/{n}")
        p.batch(f, f"b/{n}")  # replayed
        if n == 1:
            assert p.final.read().count() == 0  # b has not passed the first minute yet
    out = got(p.final.read(), "item", "n", "total", "period_epoch")
    assert [(i, n, t, e - base) for i, n, t, e in out] == [("x", 3, 7.0, 0), ("y", 2, 2.0, 60)]
    assert got(p.diverted.read(), "item", "reason") == [("x", "passed by its source"), ("x", "passed by its source"), ("x", "period closed"), ("z", "passed by its source")]
    p.upkeep(keep_last=1)
    p.batch(frames[0], "b/0")  # replayed after its snapshots expired
    assert got(p.final.read(), "item", "n") == [("x", 3), ("y", 2)] and p.marks.read().count() == 3 and p.partials.read().count() == 0
    again = PeriodStream(spark, f"file://{tmp_path}/s2", Periods(60, 120, 121), key="k", event_time="t", arrival="a", source="s", value="v")
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 4).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    again.start(stream, str(tmp_path / "c")).awaitTermination()
    total = again.final.read().agg(F.sum("n").alias("n")).first()["n"] + again.diverted.read().count()
    assert total >= 6


def test_scratch_is_in_the_shared_folder_and_cleared(spark, tmp_path):
    from tidelake import session

    path = session.scratch(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    spark.range(3).write.parquet(path)
    assert session.clear_scratch(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_weighted_draws(spark):
    from tidelake.operators.sample import weighted_draws

    items = spark.createDataFrame([("big", 1000.0), ("small", 1.0), ("mid", 250.0), ("none", 0.0), ("null", None), ("neg", -5.0)], "k string, w double")
    out = weighted_draws(items, "k", "w", 4000, seed=7)
    counts = {r["key"]: r["count"] for r in out.groupBy("key").count().collect()}
    assert abs(counts["big"] / 4000 - 1000 / 1251) < 0.03 and abs(counts["mid"] / 4000 - 250 / 1251) < 0.03
    assert set(counts) <= {"big", "small", "mid"} and sum(counts.values()) >= 3999
    again = weighted_draws(items.repartition(3), "k", "w", 4000, seed=7)
    assert got(out, "draw", "key") == got(again, "draw", "key") and got(out, "key") != got(weighted_draws(items, "k", "w", 4000, seed=8), "key")
    assert weighted_draws(items.filter("w <= 0"), "k", "w", 10, seed=1).count() == 0


def test_sinks(spark, tmp_path):
    from tidelake.sources import writers

    df = spark.createDataFrame([("b", 2, "2024-01-01"), ("a|x", None, "2024-01-02")], "k string, v int, ingest_date string")
    assert got(writers.as_messages(df, F.col("k"), ["k", "v"]), "key", "value") == [("a|x", '{"k":"a|x"}'), ("b", '{"k":"b","v":2}')]
    writers.one_csv(df, str(tmp_path / "csv"), ["k"])
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 1
    many = spark.createDataFrame([(k % 7, k) for k in range(100)], "k int, v int")
    assert writers.one_csv(many, str(tmp_path / "csv2"), ["k"], most_rows=30) == 4
    files = sorted((tmp_path / "csv2").glob("*.csv"))
    assert [int(x.split(",")[0]) for f in files for x in f.read_text().splitlines()[1:]] == sorted(k % 7 for k in range(100)) and len(files) > 1
    writers.append_log(df, str(tmp_path / "log"))
    writers.external_table(spark, "log_table", "k string, v int", str(tmp_path / "log"), "ingest_date")
    assert spark.table("log_table").filter("ingest_date = '2024-01-01'").first()["k"] == "b"
    spark.sql("drop table log_table")
    writers.register({"some_rows": df})
    assert spark.table("some_rows").count() == 2
    assert "| a\\|x |  |" in writers.markdown(df)
    hours = spark.createDataFrame([("x", ts("2024-01-01 00:00")), ("x", ts("2024-01-01 03:00"))], "s string, h timestamp")
    report = writers.gap_report(gaps.coverage(hours, "s", "h"), gaps.missing_hours(hours, "s", "h"), str(tmp_path / "g.json"))
    assert report == {"gap_count": 2, "symbols_with_gaps": 1, "earliest_gap": "2024-01-01 01:00:00", "by_symbol": {"x": 2}}


# scan, synthetic feed, replay


def test_scan_runs_its_rules_and_persists(spark, tmp_path):
    from tidelake.operators import scan

    rows = [("x", 1, 10, "5", "1", "r1"), ("x", 2, 20, "0", "1", "r1"), ("x", 9, 15, None, "1", "r1"), ("y", 4, 1, "5", "1", "r2")]
    df = spark.createDataFrame(rows, "symbol string, trade_id bigint, produce_ts bigint, price string, qty string, run_id string")
    lags = spark.createDataFrame([("a", 20_000, "r1"), ("b", 1, "r1"), ("a", 1, "r2")], "config_label string, lag_ms bigint, run_id string")
    found = scan.scan(df, "t", scan.STREAM, lags, "r1")
    assert got(found, "check_name", "severity", "dimension", "observed") == [
        ("FRESHNESS_SLA", "CRITICAL", "a", 20000.0), ("GAP", "CRITICAL", "x", 6.0), ("NULL_OR_ZERO", "CRITICAL", "t.price", 2.0), ("ORDER_REVERSAL", "WARN", "x", 1.0), ("SCHEMA_DRIFT", "CRITICAL", "t.trade_id", 1.0),
    ]
    assert scan.of_run(df.drop("run_id"), "r1").count() == 4 and scan.of_run(df, None).count() == 4 and scan.of_run(df, "r2").count() == 1
    target = Table(spark, f"file://{tmp_path}/events", TABLES["quality_events"])
    assert scan.run(df, "t", scan.STREAM, target, "r1", lags=lags) == 5 and scan.run(df, "t", scan.STREAM, target, "r1", lags=lags) == 0
    clean = scan.ScanConfig(freshness="", fields=("qty",), order="produce_ts")
    assert scan.run(df.filter("symbol = 'y'"), "t", clean, target, "r2") == 0 and target.read().count() == 5 and target.snapshots().count() == 1
    at = dt.datetime(2024, 1, 1, 1, tzinfo=dt.timezone.utc)
    times = spark.createDataFrame([("x", ts("2024-01-01 00:10:00")), ("x", ts("2024-01-01 00:50:00")), ("y", None)], "s string, t timestamp")
    assert got(scan.ages(times, "s", "t", F.lit(at)).fillna(-1), "dimension", "age_ms") == [("x", 600_000), ("y", -1)]


def test_checks_by_day(spark):
    df = spark.createDataFrame([("a", ts("2024-01-01 03:00")), ("a", ts("2024-01-01 04:00")), (None, ts("2024-01-02")), ("b", None)], "k string, t timestamp")
    out = [(r["run_id"], r["row_count"], r["null_count"], r["duplicate_count"], r["check_status"]) for r in quality.checks_by_day(df, "t", ["k"], ["k"], "t").orderBy("run_id").collect()]
    assert out == [("daily-2024-01-01", 2, 0, 1, "FAIL"), ("daily-2024-01-02", 1, 1, 1, "FAIL")]
    assert quality.checks_by_day(df.limit(0), "t", ["k"], ["k"], "t").count() == 0


def test_webhook_posts_json():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    heard = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            heard.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.handle_request, daemon=True).start()
    event = {"severity": "WARN", "check_name": "GAP", "dimension": "x", "detail": "d"}
    assert quality.send_alert([event], quality.webhook(f"http://127.0.0.1:{server.server_port}"))["sent"]
    assert "GAP" in heard[0]["text"]
    assert not quality.send_alert([event], quality.webhook("http://127.0.0.1:1", 0.2))["sent"]


def test_synthetic_feed(spark):
    from tidelake.operators import simulate

    feed = simulate.Feed(seed=3)
    with pytest.raises(ValueError):
        simulate.in_window(spark, 5, 0, 15_000, feed, 100.0)
    orders = simulate.in_window(spark, 2000, 1_000_000, 2_000_000, feed, 100.0)
    out = simulate.events(orders, " btcusdt ", feed)
    rows = [r.asDict() for r in out.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, (r.asDict() for r in simulate.events(orders.repartition(7), "BTCUSDT", feed).collect())))
    by = {}
    for r in rows:
        by.setdefault(r["order_id"], []).append(r)
    assert len(by) == 2000 and min(by) == "OS00000000" and {r["symbol"] for r in rows} == {"BTCUSDT"}
    for es in by.values():
        es.sort(key=lambda r: (r["event_time"], {"NEW": 0, "PARTIALLY_FILLED": 1}.get(r["order_status"], 2)))
        first, last = es[0], es[-1]
        assert first["order_status"] == "NEW" and first["filled_qty"] == 0 and first["avg_fill_price"] is None and last["order_status"] in ("FILLED", "CANCELED")
        assert 3000 <= (last["event_time"] - first["event_time"]).total_seconds() * 1000 <= 15000 and 99.69 < float(first["order_price"]) < 100.31
        part = [e["filled_qty"] for e in es if e["order_status"] == "PARTIALLY_FILLED"]
        assert last["filled_qty"] == (first["order_qty"] if last["order_status"] == "FILLED" else part[0] if part else 0)
    shares = [sum(e["order_status"] == s for e in rows) / 2000 for s in ("PARTIALLY_FILLED", "CANCELED")]
    assert abs(shares[0] - 0.45) < 0.05 and abs(shares[1] - 0.25) < 0.05
    anchors = spark.createDataFrame([(0, 50.0, 1.0), (60_000, 60.0, 99.0), (120_000, 0.0, 5.0), (180_000, 9.0, None)], "open_time_ms bigint, close double, volume double")
    drawn = simulate.anchored(anchors, 500, feed).collect()
    assert sum(r["reference"] == 60.0 for r in drawn) > 470 and all(0 <= r["base_ms"] < 120_000 for r in drawn)
    linked = spark.range(1).select(simulate.linked(0.5, F.lit(4.0), True).alias("a"), simulate.linked(0.5, F.lit(4.0), False).alias("b"), simulate.linked(0.5, F.lit(None).cast("double"), True).alias("c"), simulate.linked(0.5, F.lit(0.0), False).alias("d")).first()
    assert tuple(linked) == (1.0, 0.125, 0.5, 1.0)


def test_replay_and_reconnecting(spark):
    from tidelake.streaming import replay

    df = spark.createDataFrame([(str(k), (k * 37) % 101) for k in range(101)] + [(None, None)], "id string, t bigint")
    assert replay.replay_records(df, ["id", "t"], F.lit(5)).count() == 101
    assert json.loads(replay.replay_records(df, ["id", "t"], F.lit(5)).first()["value"])["source"] == "replay"
    placed = replay.schedule(df.dropna(), [F.col("t")], rate=200.0, blocks=8).orderBy("t").collect()
    assert [r["no"] for r in placed] == list(range(101)) and placed[100]["due_ms"] == 500 and placed[11]["slice"] == 1
    with pytest.raises(ValueError):
        replay.schedule(df, [F.col("t")], rate=0)
    now, sent = [0.0], []

    def sleep(s):
        now[0] += s

    def send(k):
        sent.append((k, round(now[0], 3)))
        now[0] += 2.0 if k == 2 else 0.01

    assert replay.pace(iter(range(5)), send, 50, clock=lambda: now[0], sleep=sleep) == 1
    assert sent == [(0, 0.0), (1, 0.05), (2, 0.1), (3, 2.1), (4, 2.15)]
    tries, waits = [], []

    def connect():
        tries.append(1)
        yield f"m{len(tries)}"
        if len(tries) < 3:
            raise OSError("gone")

    assert list(replay.reconnecting(connect, waits.append, rand=lambda: 0.0)) == ["m1", "m2", "m3"] and waits == [1.0, 1.0]
    assert [replay.backoff(n, rand=lambda: 1.0) for n in (0, 3, 20)] == [1.25, 10.0, 75.0]

    def never():
        raise OSError("no")
        yield

    with pytest.raises(OSError):
        list(replay.reconnecting(never, waits.append, most_attempts=3))


def test_more_sources(spark, tmp_path):
    for m in ("2024-01", "2024-03"):
        (tmp_path / f"t-{m}.csv").write_text("1,2,3,4,5,True,True\n1,2\n")
    months = readers.monthly(spark, f"{tmp_path}/t-{{month}}.csv", "2023-12", "2024-03", readers.TRADE_CSV)
    assert months.count() == 2 and readers.monthly(spark, f"{tmp_path}/u-{{month}}.csv", "2023-12", "2024-03", readers.TRADE_CSV) is None
    path = str(tmp_path / "t-2024-01.csv")
    assert readers.first_rows(spark, path, readers.TRADE_CSV, 0).count() == 0 and readers.first_rows(spark, path, readers.TRADE_CSV, None).count() == 1
    import hashlib

    assert readers.digest(spark, path).first()["sha256"] == hashlib.sha256((tmp_path / "t-2024-01.csv").read_bytes()).hexdigest()
    bars = spark.createDataFrame([("x", "1m", ts(f"2024-01-01 00:0{k}"), 1.0, None if k == 3 else 1.0) for k in range(5)] + [("y", "1m", ts("2024-01-01 00:01"), 1.0, 1.0)], "symbol string, interval string, open_time timestamp, close double, volume double")
    assert readers.bars_of(bars, "x", "1m").count() == 4 and readers.bars_of(bars, "x", "1m", "2024-01-01 00:01", "2024-01-01 00:04").count() == 2
    config = {"symbols": ["btcusdt ", "ETHUSDT", "", "adausdt"], "shards": 2}
    assert sorted(readers.symbols_of(config, 0) + readers.symbols_of(config, 1)) == readers.symbols_of(config) == ["ADAUSDT", "BTCUSDT", "ETHUSDT"]
    assert readers.only(bars, ["y"]).count() == 1
    for bad in (({"symbols": []}, None), ({"symbols": ["a"], "shards": 1}, 1)):
        with pytest.raises(ValueError):
            readers.symbols_of(*bad)


def test_timed_stream(spark, tmp_path):
    from tidelake.streaming import replay

    spark.range(3).write.parquet(str(tmp_path / "in"))
    start = lambda trigger, name: spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")).writeStream.foreachBatch(lambda b, n: None).option("checkpointLocation", str(tmp_path / name)).trigger(**trigger).start()
    assert replay.timed(start({"availableNow": True}, "a"), 60)
    running = start({"processingTime": "1 second"}, "b")
    assert not replay.timed(running, 1.5) and not running.isActive


def test_daily_jobs_run_again_change_nothing(spark, data, tmp_path):
    from tidelake.plans.daily import CHECKED, Daily
    from tidelake.session import table
    from tidelake.store import Catalog

    catalog = Catalog(spark, f"file://{tmp_path}/lake")
    make = lambda run: Daily(spark, catalog, table(spark, data, "raw_trades").limit(300), table(spark, data, "raw_klines").limit(200), table(spark, data, "staging_orders").limit(100), ("2016-01-01 00:00:00", "2017-01-01 00:00:00"), run)
    make("a").run()
    counts = lambda: {n: catalog.table(f"lake.{n}", TABLES[n]).read().count() for n in CHECKED}
    first = counts()
    assert all(first.values())
    again = make("b")
    for name in ("processed_trades", "staging_klines", "processed_klines", "market_hourly_summary"):
        again.jobs()[name]()
    assert counts() == first
    broken = Daily(spark, catalog, table(spark, data, "raw_trades").drop("message_value"), again.raw_klines, again.orders, again.window, "c")
    with pytest.raises(Exception, match="message_value"):
        broken.run()
    log = catalog.table("lake.pipeline_run_summary", TABLES["pipeline_run_summary"]).read()
    assert got(log.filter("run_id = 'c'"), "task_name", "status") == [("processed_trades", "FAILED")]


def test_frames_from_a_socket_through_a_spool(spark, tmp_path):
    import base64
    import hashlib
    import socket
    import threading

    from tidelake.sources import frames
    from tidelake.streaming import replay

    trade = json.dumps({"e": "aggTrade", "E": 5, "s": "BTCUSDT", "a": 7, "p": "2.5", "q": "2", "T": 4, "m": True, "M": True})
    long = json.dumps({"stream": "x" * 300, "data": json.loads(trade) | {"a": 8}})
    heard = []
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        for k in range(2):
            c, _ = server.accept()
            f = c.makefile("rb")
            lines = [x.decode().strip() for x in iter(f.readline, b"\r\n")]
            key = next(x.split(": ")[1] for x in lines if x.startswith("Sec-WebSocket-Key"))
            answer = base64.b64encode(hashlib.sha1((key + frames.ANSWER).encode()).digest()).decode()
            c.sendall(f"HTTP/1.1 101 Switching Protocols\r\nSec-WebSocket-Accept: {answer}\r\n\r\n".encode())
            text = trade.encode()
            c.sendall(bytes([0x01, 10]) + text[:10] + bytes([0x89, 2]) + b"hi" + bytes([0x80, len(text) - 10]) + text[10:])  # in two parts, a ping between
            head = f.read(2)
            mask = f.read(4)
            heard.append((head[0] & 15, bytes(b ^ mask[i] for i, b in enumerate(f.read(head[1] & 127)))))
            if k:
                body = long.encode()
                c.sendall(bytes([0x81, 126]) + len(body).to_bytes(2, "big") + body + bytes([0x88, 0]))
            c.close()

    threading.Thread(target=serve, daemon=True).start()
    url = f"ws://127.0.0.1:{server.getsockname()[1]}/stream?streams=btcusdt@aggTrade"
    got_frames = replay.reconnecting(lambda: frames.messages(url, 5), lambda _: None, most_attempts=3)
    assert frames.spool(spark, got_frames, f"file://{tmp_path}/spool", most=2) == 2
    assert heard == [(frames.PONG, b"hi")] * 2
    out = parse.exchange_frames(frames.frame_stream(spark, f"file://{tmp_path}/spool", 1))
    out.writeStream.format("memory").queryName("heard_frames").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(json.loads(r["message_value"])["trade_id"] for r in spark.table("heard_frames").collect()) == ["7", "7", "8"]
    with pytest.raises(ValueError):
        next(frames.messages("http://x"))
