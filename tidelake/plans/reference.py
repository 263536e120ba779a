"""Queries of the core operators over the test tables, with SQL for DuckDB. Times come out as epoch seconds or milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.parsing import order_status, symbol_letters, utc_timestamp
from tidelake.operators import dedup, gaps, lifecycle, merge, parse, quality, scan, serving
from tidelake.plans.problem_oracles import _ingest
from tidelake.plans.problems import p3_bars
from tidelake.session import scratch, table

#: The ingest window of the windowed queries.
WINDOW = ("2016-01-04 21:00:00", "2016-01-05 00:00:00")
_SQL_WINDOW = f"{_ingest()} >= '2016-01-04 21:00:00+00'::timestamptz and {_ingest()} < '2016-01-05 00:00:00+00'::timestamptz"


def _sec(c: str):
    return F.unix_seconds(F.col(c).cast("timestamp")).alias(c)


def _num(*columns: str):
    return [F.col(c).cast("double").alias(c) for c in columns]


def minute_bars(spark: SparkSession, d: str) -> DataFrame:
    """The valid version of each 1m bar."""
    bars = table(spark, d, "processed_klines").filter("interval = '1m' and symbol is not null and open_time is not null")
    return dedup.latest_by(bars, ["symbol", "open_time"], [F.col("source_offset"), F.col("updated_at"), F.col("close"), F.col("open"), F.col("high"), F.col("low"), F.col("volume"), F.col("quote_volume"), F.col("number_of_trades")])


_BARS = """bars as (select * exclude (rn) from (select *, row_number() over (partition by symbol, open_time order by source_offset desc nulls last, updated_at desc nulls last, "close" desc nulls last, "open" desc nulls last, high desc nulls last, low desc nulls last, volume desc nulls last, quote_volume desc nulls last, number_of_trades desc nulls last) rn
  from processed_klines where "interval" = '1m' and symbol is not null and open_time is not null) where rn = 1)"""
_HOUR = "cast(floor(epoch({}) / 3600) as bigint) * 3600"
_BAR_HOURS = f"""bar_hours as (select symbol, {_HOUR.format('open_time')} summary_hour, arg_min("open", open_time) filter ("open" is not null) open_price, max(high) high_price, min(low) low_price, arg_max("close", open_time) filter ("close" is not null) close_price, sum(volume) kline_volume, sum(quote_volume) kline_quote_volume, cast(sum(number_of_trades) as bigint) kline_number_of_trades from bars group by 1, 2)"""
_TRADE_HOURS = f"""trade_hours as (select symbol, {_HOUR.format('trade_time')} summary_hour, count(*) trade_count, sum(qty) trade_qty, sum(quote_qty) trade_quote_qty, cast(sum(price) as double) / nullif(count(price), 0) avg_trade_price, cast(sum(quote_qty) as double) / nullif(cast(sum(qty) as double), 0) vwap, count(*) filter (is_buyer_maker) maker_trade_count, count(*) filter (not is_buyer_maker) taker_trade_count from processed_trades where symbol is not null and trade_time is not null group by 1, 2)"""
_MARKET_COLUMNS = ["open_price", "high_price", "low_price", "close_price", "kline_volume", "kline_quote_volume", "trade_qty", "trade_quote_qty", "avg_trade_price", "vwap"]
_MARKET_OUT = ", ".join(f"cast(cast({c} as decimal(30,8)) as double) {c}" for c in _MARKET_COLUMNS)
_MARKET_INTS = "kline_number_of_trades, trade_count, maker_trade_count, taker_trade_count"


def _market_out(df: DataFrame) -> DataFrame:
    return df.select("symbol", _sec("summary_hour"), *_num(*_MARKET_COLUMNS), *_MARKET_INTS.split(", "))


def market_hourly_summary(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bar and trade figures side by side, over all hours of either."""
    return _market_out(serving.market_hourly(minute_bars(spark, d), table(spark, d, "processed_trades")))


def market_hourly_affected(spark: SparkSession, d: str) -> DataFrame:
    """The same, only for the hours that an ingest window touched; whole hours are aggregated anew."""
    bars, trades = minute_bars(spark, d), table(spark, d, "processed_trades")
    keys = serving.affected_hours((dedup.in_ingest_window(bars, *WINDOW), "open_time"), (dedup.in_ingest_window(trades, *WINDOW), "trade_time"))
    return _market_out(serving.market_hourly(bars, trades, keys))


def affected_keys_union(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and hours that an ingest window touched, by bars or trades."""
    keys = serving.affected_hours((dedup.in_ingest_window(minute_bars(spark, d), *WINDOW), "open_time"), (dedup.in_ingest_window(table(spark, d, "processed_trades"), *WINDOW), "trade_time"))
    return keys.select("symbol", _sec("summary_hour"))


_KEYS = f"keys as (select distinct symbol, {_HOUR.format('open_time')} summary_hour from bars where {_SQL_WINDOW} union select distinct symbol, {_HOUR.format('trade_time')} from processed_trades where symbol is not null and trade_time is not null and {_SQL_WINDOW})"


def bars_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """Hourly open, high, low, close."""
    df = serving.bars_by_hour(minute_bars(spark, d))
    return df.select("symbol", _sec("summary_hour"), *_num("open_price", "high_price", "low_price", "close_price"), "kline_number_of_trades")


def once_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "processed_orders").filter("order_id is not null")
    return dedup.latest_by(orders, ["order_id"], [F.col("updated_at"), F.col("source_offset")]).withColumn("symbol", symbol_letters(F.col("symbol")))


#: TESTDATA.md: symbols are equal when their letters are, ignoring case.
_ORDERS = "orders_once as (select * exclude (rn, symbol), nullif(upper(regexp_replace(symbol, '[^\\p{L}]', '', 'g')), '') symbol from (select *, row_number() over (partition by order_id order by updated_at desc nulls last, source_offset desc nulls last) rn from processed_orders where order_id is not null) where rn = 1)"
_EXEC = f"""exec as (select symbol, {_HOUR.format('created_at')} summary_hour, count(*) total_orders, count(*) filter (order_status = 'FILLED') filled_orders, count(*) filter (order_status = 'CANCELED') canceled_orders,
  avg(case when order_status = 'FILLED' then floor(epoch(filled_at)) - floor(epoch(created_at)) end) avg_fill_delay_sec, sum(order_qty) total_order_qty, sum(filled_qty) total_filled_qty,
  cast(sum(avg_fill_price * cast(filled_qty as decimal(18,8))) filter (order_status = 'FILLED' and side = 'BUY') as double) / nullif(cast(sum(filled_qty) filter (order_status = 'FILLED' and side = 'BUY' and avg_fill_price is not null) as double), 0) avg_buy_fill_price,
  cast(sum(avg_fill_price * cast(filled_qty as decimal(18,8))) filter (order_status = 'FILLED' and side = 'SELL') as double) / nullif(cast(sum(filled_qty) filter (order_status = 'FILLED' and side = 'SELL' and avg_fill_price is not null) as double), 0) avg_sell_fill_price
  from orders_once where symbol is not null and created_at is not null group by 1, 2)"""


def order_execution_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly order counts, delays, quantities and direction-split fill prices, beside the market's price."""
    df = serving.execution_hourly(once_orders(spark, d), serving.trades_by_hour(table(spark, d, "processed_trades")))
    return df.select("symbol", _sec("summary_hour"), "total_orders", "filled_orders", "canceled_orders", *_num("avg_fill_delay_sec", "total_order_qty", "total_filled_qty", "avg_buy_fill_price", "avg_sell_fill_price"), *_num("benchmark_vwap"))


def execution_vs_market(spark: SparkSession, d: str) -> DataFrame:
    """The serving view of execution beside the published market hours."""
    market = dedup.latest_by(table(spark, d, "market_hourly_summary"), ["symbol", "summary_hour"], [F.col("updated_at"), F.col("trade_count")])
    df = serving.execution_vs_market(serving.execution_hourly(once_orders(spark, d), market), market)
    return df.select("symbol", _sec("summary_hour"), "total_orders", "filled_orders", *_num("market_vwap", "close_price", "kline_volume"), "trade_count")


def parse_trades(spark: SparkSession, d: str) -> DataFrame:
    """Typed trades of the raw log."""
    df = parse.trades(table(spark, d, "raw_trades"))
    return df.select("trade_id", "symbol", *_num("price", "qty", "quote_qty"), F.unix_millis("trade_time").alias("time_ms"), "is_buyer_maker", "is_best_match", "source_partition", "source_offset")


_PARSED = """parsed as (select try_cast(trim(j->>'trade_id') as bigint) trade_id, coalesce(nullif(upper(trim(j->>'symbol')), ''), nullif(upper(trim(message_key)), '')) symbol, try_cast(trim(j->>'price') as decimal(20,8)) price, try_cast(trim(j->>'qty') as decimal(20,8)) qty, try_cast(trim(j->>'quote_qty') as decimal(20,8)) quote_qty,
  try_cast(trim(j->>'time') as bigint) time_ms, lower(trim(j->>'is_buyer_maker')) = 'true' is_buyer_maker, lower(trim(j->>'is_best_match')) = 'true' is_best_match, kafka_partition source_partition, kafka_offset source_offset, ingest_time
  from (select *, cast(message_value as json) j from raw_trades where json_valid(message_value)) where json_type(j) = 'OBJECT')"""


def new_trades_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Trades of the raw log that the typed table did not hold before an ingest window, one row each: the first by offset."""
    before = table(spark, d, "processed_trades").filter(utc_timestamp(F.col("ingest_time")) < utc_timestamp(F.lit(WINDOW[0])))
    once = dedup.latest_by(parse.trades(table(spark, d, "raw_trades")), ["symbol", "trade_id"], [-F.col("source_offset"), -F.col("source_partition")])
    return dedup.not_yet_in(once, before, ["symbol", "trade_id"]).select("symbol", "trade_id", "source_offset")


def raw_window(spark: SparkSession, d: str) -> DataFrame:
    """Messages of an ingest window, by partition, with the folder filter in front."""
    df = dedup.in_ingest_window(table(spark, d, "raw_trades"), *WINDOW, date="ingest_date")
    return df.groupBy("kafka_partition").agg(F.count("*").alias("messages"), F.min("kafka_offset").alias("low"), F.max("kafka_offset").alias("high"))


def staged_bars(spark: SparkSession, d: str) -> DataFrame:
    """One version of each raw bar: closed ones first, then the latest offset and ingest."""
    bars = p3_bars(spark, d).filter("symbol is not null and interval is not null and open_time is not null")
    best = dedup.latest_by(bars, ["symbol", "interval", "open_time"], [F.col("is_closed"), F.col("source_offset"), F.col("ingest_time"), F.col("source_partition")])
    return best.select("symbol", F.col("interval").alias("kline_interval"), _sec("open_time"), "is_closed", "source_offset", *_num("open", "close"))


def kline_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Raw bars merged into the current ones unless the current row has a later offset."""
    bars = p3_bars(spark, d).filter("symbol is not null and interval is not null and open_time is not null")
    source = dedup.latest_by(bars, ["symbol", "interval", "open_time"], [F.col("source_offset"), F.col("updated_at")])
    now = table(spark, d, "processed_klines").filter("symbol is not null and interval is not null and open_time is not null")
    target = dedup.latest_by(now, ["symbol", "interval", "open_time"], [F.col("source_offset"), F.col("updated_at"), F.col("close")])
    df = merge.upsert(target, source, ["symbol", "interval", "open_time"], guard=merge.not_older("source_offset"), check=False)  # one row a key by now
    return df.select("symbol", F.col("interval").alias("kline_interval"), _sec("open_time"), "source_offset")


def order_events_once(spark: SparkSession, d: str) -> DataFrame:
    """One row per order, status and event time."""
    feed = table(spark, d, "staging_orders").withColumn("order_status", order_status(F.col("order_status"), F.col("event_type"))).filter("order_id is not null and order_status is not null and event_time is not null")
    best = dedup.latest_by(feed, ["order_id", "order_status", "event_time"], [utc_timestamp(F.col("ingest_time")), F.col("source_offset")])
    return best.select("order_id", "order_status", F.unix_millis(F.col("event_time").cast("timestamp")).alias("event_ms"), "source_offset")


_FEED = """feed as (select * from (select order_id, event_time, source_offset, ingest_time, client_id, case when s in ('NEW', 'PARTIALLY_FILLED', 'FILLED', 'CANCELED', 'DELETED') then s when e in ('NEW', 'PARTIALLY_FILLED', 'FILLED', 'CANCELED', 'DELETED') then e end order_status from (select *,
  regexp_replace(regexp_replace(upper(trim(order_status)), '[\\s-]+', '_', 'g'), '^CANCELLED$', 'CANCELED') s, regexp_replace(regexp_replace(regexp_replace(upper(trim(event_type)), '[\\s-]+', '_', 'g'), '^ORDER_', ''), '^CANCELLED$', 'CANCELED') e from staging_orders))
  where order_id is not null and event_time is not null and order_status is not null)"""


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "staging_orders").withColumn("order_status", order_status(F.col("order_status"), F.col("event_type"))).filter("order_status is not null")


def order_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Each order's last status and the times of its life."""
    df = lifecycle.fold(_feed(spark, d), ["client_id"])
    return df.select("order_id", "order_status", _sec("created_at"), _sec("updated_at"), _sec("filled_at"), _sec("canceled_at"))


def order_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The feed's orders merged into the order table unless that is newer."""
    df = lifecycle.rebuild(once_orders(spark, d), lifecycle.fold(_feed(spark, d), ["client_id"]))
    return df.select("order_id", "order_status", _sec("updated_at"))


def order_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The merge that keeps earlier fill and cancel times."""
    df = lifecycle.carry_forward(once_orders(spark, d), lifecycle.fold(_feed(spark, d), ["client_id"]))
    return df.select("order_id", "order_status", _sec("created_at"), _sec("filled_at"), _sec("canceled_at"))


_FOLD = "fold as (select order_id, arg_max(order_status, rn) order_status, min(event_time) created_at, max(event_time) updated_at, max(event_time) filter (order_status = 'FILLED') filled_at, max(event_time) filter (order_status = 'CANCELED') canceled_at from (select *, row_number() over (partition by order_id order by event_time, case order_status when 'NEW' then 1 when 'PARTIALLY_FILLED' then 2 when 'DELETED' then 4 else 3 end, source_offset nulls first, order_status) rn from feed) group by 1)"
_S = lambda c: f"cast(floor(epoch({c})) as bigint)"


def trade_id_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Missing stretches of the trade numbers of each symbol."""
    return quality.gap_segments(table(spark, d, "processed_trades"), "symbol", "trade_id")


def arrival_reversals(spark: SparkSession, d: str) -> DataFrame:
    """How often a symbol's trade numbers fall along the log."""
    rows = table(spark, d, "processed_trades").withColumn("_at", F.col("source_offset"))
    return quality.reversal_counts(rows, "symbol", "_at", "trade_id").select("symbol", "reversals")


def null_or_zero(spark: SparkSession, d: str) -> DataFrame:
    """Nulls and zeros of the trade columns."""
    return quality.null_or_zero_counts(table(spark, d, "processed_trades"), ["price", "qty", "quote_qty"])


def table_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows, nulls and duplicate keys of the main tables."""
    out = None
    for name, keys in (("processed_trades", ["symbol", "trade_id"]), ("processed_klines", ["symbol", "interval", "open_time"]), ("staging_orders", ["order_id", "order_status"]), ("processed_orders", ["order_id"])):
        df = table(spark, d, name)
        if "open_time" in df.columns:
            df = df.withColumn("open_time", F.unix_micros(F.col("open_time").cast("timestamp")))
        part = quality.table_check(df, name, keys, keys)
        out = part if out is None else out.unionAll(part)
    return out


def _lags(spark: SparkSession, d: str) -> DataFrame:
    """Time from trade to ingest of every row; null where either is missing. Wrong times make wrong lags, and show as such."""
    lag = F.unix_millis(utc_timestamp(F.col("ingest_time"))) - F.unix_millis(F.col("trade_time").cast("timestamp"))
    return table(spark, d, "processed_trades").select("symbol", lag.alias("lag_ms"))


def freshness(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose time from trade to ingest breaks 30 seconds at p95, or at worst."""
    return quality.freshness(quality.lag_percentiles(_lags(spark, d), ["symbol"]), "symbol", "p95", "high", 30_000).select("dimension", "severity", "observed")


def lag_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the time from trade to ingest by symbol."""
    return quality.lag_percentiles(_lags(spark, d), ["symbol"])


_LAG = f"lag as (select symbol, epoch_ms({_ingest()}) - epoch_ms(trade_time) lag_ms from processed_trades)"


def hour_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Published hours absent inside a symbol's range."""
    return gaps.missing_hours(table(spark, d, "market_hourly_summary"), "symbol", "summary_hour").select("symbol", _sec("missing_hour"))


def hour_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Expected, actual and missing published hours by symbol."""
    return gaps.coverage(table(spark, d, "market_hourly_summary"), "symbol", "summary_hour")


def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    """Differences between the change feed's columns and those declared for the order table."""
    from tidelake.schemas import TABLES

    expected = {f.name: f.dataType.simpleString() for f in TABLES["processed_orders"].schema.fields}
    df = table(spark, d, "staging_orders")
    times = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    return quality.schema_drift(df.withColumns(times), "staging_orders", expected).select("severity", "dimension", F.substring_index("detail", " ", 1).alias("kind"))


def table_checks_window(spark: SparkSession, d: str) -> DataFrame:
    """table_checks within a window of business time."""
    out = None
    for name, keys, time in CHECKED:
        part = quality.table_check(_checkable(table(spark, d, name)), name, keys, keys, time, WINDOW)
        out = part if out is None else out.unionAll(part)
    return out


def data_quality_daily(spark: SparkSession, d: str) -> DataFrame:
    """The data quality log of the main tables, day by day of business time."""
    out = None
    for name, keys, time in CHECKED:
        part = quality.checks_by_day(_checkable(table(spark, d, name)), name, keys, keys, time)
        out = part if out is None else out.unionAll(part)
    return out.withColumn("checked_at", F.unix_seconds("checked_at"))


#: Table, key (also what must not be null) and business time of the checked tables.
CHECKED = [("processed_trades", ["symbol", "trade_id"], "trade_time"), ("processed_klines", ["symbol", "interval", "open_us"], "open_time"), ("staging_orders", ["order_id", "order_status"], "event_time"), ("processed_orders", ["order_id"], "updated_at"), ("market_hourly_summary", ["symbol", "hour_us"], "summary_hour")]


def _checkable(df: DataFrame) -> DataFrame:
    """Key times as microseconds, so that their text is the same everywhere."""
    for time, key in (("open_time", "open_us"), ("summary_hour", "hour_us")):
        if time in df.columns:
            df = df.withColumn(key, F.unix_micros(F.col(time).cast("timestamp")))
    return df


_CHECKED_SQL = [("processed_trades", "concat_ws(':', symbol, trade_id)", "symbol is null or trade_id is null", "trade_time"), ("processed_klines", "concat_ws(':', symbol, \"interval\", epoch_us(open_time))", "symbol is null or \"interval\" is null or open_time is null", "open_time"), ("staging_orders", "concat_ws(':', order_id, order_status)", "order_id is null or order_status is null", "event_time"), ("processed_orders", "order_id", "order_id is null", "updated_at"), ("market_hourly_summary", "concat_ws(':', symbol, epoch_us(summary_hour))", "symbol is null or summary_hour is null", "summary_hour")]


def quality_scan(spark: SparkSession, d: str) -> DataFrame:
    """All anomalies of the typed trades: ages at the last ingest, gaps, reversals, nulls and zeros."""
    import datetime as dt

    now = dt.datetime(2016, 1, 7, tzinfo=dt.timezone.utc)
    config = scan.ScanConfig(order="source_offset", freshness="event", event_time="trade_time", sla_ms=3_600_000.0, max_missing=5)
    return scan.scan(table(spark, d, "processed_trades"), "processed_trades", config, now=now).select("check_name", "severity", "dimension", "observed", "threshold")


def quality_scan_lags(spark: SparkSession, d: str) -> DataFrame:
    """The scan of the trades of one partition as a run of a measured stream: lags by symbol, of this run only."""
    rows = table(spark, d, "processed_trades").withColumns({"run_id": F.col("source_partition").cast("string"), "lag_ms": F.unix_millis(utc_timestamp(F.col("ingest_time"))) - F.unix_millis(F.col("trade_time").cast("timestamp"))})
    config = scan.ScanConfig(order="source_offset", lag_label="symbol", sla_ms=30_000.0, max_missing=10)
    return scan.scan(rows, "processed_trades", config, lags=rows, run_id="1").select("check_name", "severity", "dimension", "observed", "threshold")


_SCAN_TAIL = lambda rows, missing: f"""ids as (select distinct symbol, trade_id from {rows} where symbol is not null and trade_id is not null),
  gap as (select symbol, trade_id - lag(trade_id) over (partition by symbol order by trade_id) - 1 m from ids),
  fall as (select symbol, count(*) filter (trade_id < p) n from (select symbol, trade_id, lag(trade_id) over (partition by symbol order by source_offset, trade_id) p from {rows} where source_offset is not null and trade_id is not null and symbol is not null) group by 1)
  select check_name, severity, dimension, cast(observed as double) observed, cast(threshold as double) threshold from (
  select 'GAP' check_name, 'CRITICAL' severity, symbol dimension, m observed, {missing} threshold from gap where m > {missing}
  union all select 'ORDER_REVERSAL', 'WARN', symbol, n, 0 from fall where n > 0
  union all select 'NULL_OR_ZERO', 'CRITICAL', 'processed_trades.' || f, n, 0 from (select 'price' f, count(*) filter (price is null or price = 0) n from {rows} union all select 'qty', count(*) filter (qty is null or qty = 0) from {rows}) where n > 0
  union all select 'FRESHNESS_SLA', severity, symbol, observed, sla from fresh)"""  # noqa: E731


def anchor_export(spark: SparkSession, d: str) -> DataFrame:
    """Minute closes and volumes with positive values, as an anchor for replays."""
    bars = minute_bars(spark, d).filter("close > 0 and volume > 0")
    return bars.select("symbol", F.unix_millis(F.col("open_time").cast("timestamp")).alias("open_time_ms"), *_num("close", "volume"))


def verify_symbols(spark: SparkSession, d: str) -> DataFrame:
    """By symbol, in order: hours, lowest and highest volume-weighted price as published, mean slippage of its executions."""
    market = table(spark, d, "market_hourly_summary").groupBy("symbol").agg(F.count("*").alias("n_hours"), F.round(F.min("vwap").cast("double"), 4).alias("low"), F.round(F.max("vwap").cast("double"), 4).alias("high"))
    latest = dedup.latest_by(table(spark, d, "market_hourly_summary"), ["symbol", "summary_hour"], [F.col("updated_at"), F.col("trade_count")]).withColumn("summary_hour", F.col("summary_hour").cast("timestamp"))
    slips = serving.execution_hourly(once_orders(spark, d), latest).groupBy("symbol").agg(*[F.round(F.avg(f"{s}_slippage_bps") + 1e-9, 3).alias(f"{s}_bps") for s in ("buy", "sell")])
    return market.join(slips, "symbol", "left").orderBy("symbol")


def volume_count_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Pearson correlation of an hour's volume and its orders, over all symbols and hours with both."""
    bars = serving.bars_by_hour(minute_bars(spark, d))
    both = serving.orders_by_hour(once_orders(spark, d)).join(bars, serving.KEYS)
    return both.agg(F.count("*").alias("n_hours"), F.round(F.corr(F.col("total_orders").cast("double"), F.col("kline_number_of_trades").cast("double")), 6).alias("r"))


def orders_store(spark: SparkSession, d: str) -> DataFrame:
    """The order table kept in the snapshot store: appended, merged with the feed, updated, deleted from, compacted, read back."""
    from tidelake.schemas import TABLES
    from tidelake.store import Table

    store = Table(spark, scratch(spark, "orders-store"), TABLES["processed_orders"])
    store.append(once_orders(spark, d))
    store.merge(lifecycle.fold(_feed(spark, d), ["client_id"]))
    store.update(F.col("order_status") == "CANCELED", {"filled_qty": F.lit(0)})
    store.delete(F.col("order_status") == "DELETED")
    store.compact()
    return store.read().groupBy("order_status").agg(F.count("*").alias("orders"), F.round(F.sum("filled_qty").cast("double"), 4).alias("filled"))


ORACLES = {
    "market_hourly_summary": f"with {_BARS}, {_BAR_HOURS}, {_TRADE_HOURS} select coalesce(b.symbol, t.symbol) symbol, coalesce(b.summary_hour, t.summary_hour) summary_hour, {_MARKET_OUT}, {_MARKET_INTS} from bar_hours b full join trade_hours t on b.symbol = t.symbol and b.summary_hour = t.summary_hour",
    "market_hourly_affected": f"with {_BARS}, {_BAR_HOURS}, {_TRADE_HOURS}, {_KEYS} select k.symbol, k.summary_hour, {_MARKET_OUT}, {_MARKET_INTS} from keys k left join bar_hours b on b.symbol = k.symbol and b.summary_hour = k.summary_hour left join trade_hours t on k.symbol = t.symbol and k.summary_hour = t.summary_hour",
    "affected_keys_union": f"with {_BARS}, {_KEYS} select * from keys",
    "bars_by_hour": f"with {_BARS}, {_BAR_HOURS} select symbol, summary_hour, cast(open_price as double) open_price, cast(high_price as double) high_price, cast(low_price as double) low_price, cast(close_price as double) close_price, kline_number_of_trades from bar_hours",
    "order_execution_hourly": f"with {_ORDERS}, {_EXEC}, {_TRADE_HOURS} select e.symbol, e.summary_hour, total_orders, filled_orders, canceled_orders, avg_fill_delay_sec, cast(total_order_qty as double) total_order_qty, cast(total_filled_qty as double) total_filled_qty, cast(cast(avg_buy_fill_price as decimal(20,8)) as double) avg_buy_fill_price, cast(cast(avg_sell_fill_price as decimal(20,8)) as double) avg_sell_fill_price, cast(cast(vwap as decimal(20,8)) as double) benchmark_vwap from exec e left join trade_hours t on e.symbol = t.symbol and e.summary_hour = t.summary_hour",
    "execution_vs_market": f"with {_ORDERS}, {_EXEC}, pub as (select * from (select *, {_HOUR.format('summary_hour')} h, row_number() over (partition by symbol, summary_hour order by updated_at desc, trade_count desc nulls last) rn from market_hourly_summary) where rn = 1) select e.symbol, e.summary_hour, total_orders, filled_orders, cast(vwap as double) market_vwap, cast(close_price as double) close_price, cast(kline_volume as double) kline_volume, trade_count from exec e left join pub p on e.symbol = p.symbol and e.summary_hour = p.h",
    "parse_trades": f"with {_PARSED} select trade_id, symbol, cast(price as double) price, cast(qty as double) qty, cast(quote_qty as double) quote_qty, time_ms, is_buyer_maker, is_best_match, source_partition, source_offset from parsed where trade_id is not null and symbol is not null",
    "new_trades_anti_join": f"with {_PARSED} select symbol, trade_id, min(source_offset) source_offset from parsed p where trade_id is not null and symbol is not null and not exists (select 1 from processed_trades t where t.symbol = p.symbol and t.trade_id = p.trade_id and {_ingest('t.ingest_time')} < '{WINDOW[0]}+00'::timestamptz) group by 1, 2",
    "raw_window": f"select kafka_partition, count(*) messages, min(kafka_offset) low, max(kafka_offset) high from raw_trades where ingest_date between '2016-01-04' and '2016-01-05' and {_SQL_WINDOW} group by 1",
    "order_events_once": f"with {_FEED} select order_id, order_status, epoch_ms(event_time) event_ms, source_offset from (select *, row_number() over (partition by order_id, order_status, event_time order by {_ingest()} desc nulls last, source_offset desc nulls last) rn from feed) where rn = 1",
    "order_lifecycle": f"with {_FEED}, {_FOLD} select order_id, order_status, {_S('created_at')} created_at, {_S('updated_at')} updated_at, {_S('filled_at')} filled_at, {_S('canceled_at')} canceled_at from fold",
    "order_upsert": f"with {_FEED}, {_FOLD}, {_ORDERS} select coalesce(t.order_id, s.order_id) order_id, case when t.order_id is null then s.order_status when s.order_id is null then t.order_status when s.updated_at >= t.updated_at then s.order_status else t.order_status end order_status, {_S('case when t.order_id is null then s.updated_at when s.order_id is null then t.updated_at when s.updated_at >= t.updated_at then s.updated_at else t.updated_at end')} updated_at from orders_once t full join fold s on t.order_id = s.order_id",
    "order_carry_forward": f"with {_FEED}, {_FOLD}, {_ORDERS} select coalesce(t.order_id, s.order_id) order_id, case when t.order_id is null then s.order_status when s.order_id is null then t.order_status when s.updated_at >= t.updated_at then s.order_status else t.order_status end order_status, {_S('case when t.order_id is null then s.created_at when s.updated_at >= t.updated_at then least(s.created_at, t.created_at) else t.created_at end')} created_at, {_S('case when t.order_id is null then s.filled_at when s.updated_at >= t.updated_at then coalesce(s.filled_at, t.filled_at) else t.filled_at end')} filled_at, {_S('case when t.order_id is null then s.canceled_at when s.updated_at >= t.updated_at then coalesce(s.canceled_at, t.canceled_at) else t.canceled_at end')} canceled_at from orders_once t full join fold s on t.order_id = s.order_id",
    "trade_id_gaps": "select symbol, p \"before\", trade_id \"after\", trade_id - p - 1 missing from (select symbol, trade_id, lag(trade_id) over (partition by symbol order by trade_id) p from (select distinct symbol, trade_id from processed_trades where symbol is not null and trade_id is not null)) where trade_id - p > 1",
    "arrival_reversals": "select symbol, count(*) filter (trade_id < p) reversals from (select symbol, trade_id, lag(trade_id) over (partition by symbol order by source_offset, trade_id) p from processed_trades where source_offset is not null) group by 1",
    "null_or_zero": "select 'price' field, count(*) - count(price) nulls, count(*) filter (price = 0) zeros, count(*) total from processed_trades union all select 'qty', count(*) - count(qty), count(*) filter (qty = 0), count(*) from processed_trades union all select 'quote_qty', count(*) - count(quote_qty), count(*) filter (quote_qty = 0), count(*) from processed_trades",
    "table_checks": """with c as (select 'processed_trades' table_name, count(*) row_count, count(*) filter (symbol is null or trade_id is null) null_count, count(distinct concat_ws(':', symbol, trade_id)) k from processed_trades
      union all select 'processed_klines', count(*), count(*) filter (symbol is null or "interval" is null or open_time is null), count(distinct concat_ws(':', symbol, "interval", epoch_us(open_time))) from processed_klines
      union all select 'staging_orders', count(*), count(*) filter (order_id is null or order_status is null), count(distinct concat_ws(':', order_id, order_status)) from staging_orders
      union all select 'processed_orders', count(*), count(*) filter (order_id is null), count(distinct order_id) from processed_orders)
      select table_name, row_count, null_count, row_count - k duplicate_count, case when null_count > 0 or row_count - k > 0 then 'FAIL' else 'PASS' end check_status from c""",
    "freshness": f"with {_LAG}, q as (select symbol, quantile_disc(lag_ms, 0.95) p95, max(lag_ms) high from lag group by 1) select symbol dimension, case when p95 > 30000 then 'CRITICAL' else 'WARN' end severity, cast(case when p95 > 30000 then p95 else high end as double) observed from q where p95 > 30000 or high > 30000",
    "lag_percentiles": f"with {_LAG} select symbol, count(lag_ms) samples, quantile_disc(lag_ms, 0.5) p50, quantile_disc(lag_ms, 0.95) p95, quantile_disc(lag_ms, 0.99) p99, min(lag_ms) low, max(lag_ms) high from lag group by 1",
    "hour_gaps": f"with h as (select distinct symbol, {_HOUR.format('summary_hour')} h from market_hourly_summary where symbol is not null and summary_hour is not null), g as (select *, lead(h) over (partition by symbol order by h) n from h) select symbol, unnest(generate_series(h + 3600, n - 3600, 3600)) missing_hour from g where n - h > 3600",
    "hour_coverage": f"with h as (select distinct symbol, {_HOUR.format('summary_hour')} h from market_hourly_summary where symbol is not null and summary_hour is not null) select symbol, (max(h) - min(h)) // 3600 + 1 expected, count(*) actual, (max(h) - min(h)) // 3600 + 1 - count(*) missing from h group by 1",
    "anchor_export": f"with {_BARS} select symbol, epoch_ms(open_time) open_time_ms, cast(\"close\" as double) \"close\", cast(volume as double) volume from bars where \"close\" > 0 and volume > 0",
    "verify_symbols": f"""with {_ORDERS}, {_EXEC}, pub as (select * from (select *, {_HOUR.format('summary_hour')} h, row_number() over (partition by symbol, summary_hour order by updated_at desc, trade_count desc nulls last) rn from market_hourly_summary) where rn = 1),
      slip as (select e.symbol, round(avg((cast(cast(avg_buy_fill_price as decimal(20,8)) as double) - v) / nullif(v, 0) * 10000) + 1e-9, 3) buy_bps, round(avg((v - cast(cast(avg_sell_fill_price as decimal(20,8)) as double)) / nullif(v, 0) * 10000) + 1e-9, 3) sell_bps from exec e left join (select symbol, h, cast(vwap as double) v from pub) p on e.symbol = p.symbol and e.summary_hour = p.h group by 1)
      select m.*, buy_bps, sell_bps from (select symbol, count(*) n_hours, round(cast(min(vwap) as double), 4) low, round(cast(max(vwap) as double), 4) high from market_hourly_summary group by 1) m left join slip on m.symbol = slip.symbol order by symbol""",
    "schema_drift": """with have as (select column_name c from information_schema.columns where table_name = 'staging_orders'), want as (select column_name c from information_schema.columns where table_name = 'processed_orders')
      select 'CRITICAL' severity, 'staging_orders.' || c dimension, 'missing,' kind from want where c not in (select c from have) union all select 'WARN', 'staging_orders.' || c, 'extra' from have where c not in (select c from want)""",
    "table_checks_window": "with " + ", ".join(f"c{i} as (select '{n}' table_name, count(*) row_count, count(*) filter ({absent}) null_count, count(*) - count(distinct {key}) duplicate_count from {n} where {time} >= '{WINDOW[0]}' and {time} < '{WINDOW[1]}')" for i, (n, key, absent, time) in enumerate(_CHECKED_SQL)) + " " + " union all ".join(f"select *, case when null_count > 0 or duplicate_count > 0 then 'FAIL' else 'PASS' end check_status from c{i}" for i in range(len(_CHECKED_SQL))),
    "data_quality_daily": "with " + ", ".join(f"c{i} as (select '{n}' table_name, '{time}' col, cast(floor(epoch({time}) / 86400) as bigint) * 86400 d, count(*) row_count, count(*) filter ({absent}) null_count, count(*) - count(distinct {key}) duplicate_count from {n} where {time} is not null group by 3)" for i, (n, key, absent, time) in enumerate(_CHECKED_SQL)) + ", every as (" + " union all ".join(f"select * from c{i}" for i in range(len(_CHECKED_SQL))) + """)
      select 'daily-' || strftime(make_timestamp(d * 1000000), '%Y-%m-%d') run_id, d + 86400 checked_at, table_name, 'rows_nulls_duplicates' check_name, case when null_count > 0 or duplicate_count > 0 then 'FAIL' else 'PASS' end check_status, row_count, null_count, duplicate_count,
      col || ' in [' || strftime(make_timestamp(d * 1000000), '%Y-%m-%d') || ', ' || strftime(make_timestamp((d + 86400) * 1000000), '%Y-%m-%d') || ')' warning_message from every""",
    "quality_scan": f"with age as (select symbol, 1452124800000 - max(epoch_ms(trade_time)) a from processed_trades group by 1), fresh as (select 'CRITICAL' severity, symbol, a observed, 3600000 sla from age where a > 3600000), {_SCAN_TAIL('processed_trades', 5)}",
    "quality_scan_lags": f"with rows_ as (select *, epoch_ms({_ingest()}) - epoch_ms(trade_time) lag_ms from processed_trades where source_partition = 1), q as (select symbol, quantile_disc(lag_ms, 0.95) p95, max(lag_ms) high from rows_ group by 1), fresh as (select case when p95 > 30000 then 'CRITICAL' else 'WARN' end severity, symbol, case when p95 > 30000 then p95 else high end observed, 30000 sla from q where p95 > 30000 or high > 30000), {_SCAN_TAIL('rows_', 10)}",
    "orders_store": f"""with {_FEED}, {_FOLD}, {_ORDERS}, merged as (select coalesce(t.order_id, s.order_id) order_id, case when t.order_id is null or s.updated_at >= t.updated_at then s.order_status else t.order_status end order_status, t.filled_qty from orders_once t full join fold s on t.order_id = s.order_id)
      select order_status, count(*) orders, round(cast(sum(case when order_status = 'CANCELED' then 0 else filled_qty end) as double), 4) filled from merged where order_status is distinct from 'DELETED' group by 1""",
    "volume_count_correlation": f"with {_BARS}, {_BAR_HOURS}, {_ORDERS}, {_EXEC} select count(*) n_hours, round(corr(cast(total_orders as double), cast(kline_number_of_trades as double)), 6) r from exec e join bar_hours b on e.symbol = b.symbol and e.summary_hour = b.summary_hour",
}


def queries() -> dict:
    named = (market_hourly_summary, market_hourly_affected, affected_keys_union, bars_by_hour, order_execution_hourly, execution_vs_market, parse_trades, new_trades_anti_join, raw_window, staged_bars, kline_upsert, order_events_once, order_lifecycle, order_upsert, order_carry_forward, trade_id_gaps, arrival_reversals, null_or_zero, table_checks, freshness, lag_percentiles, hour_gaps, hour_coverage, schema_drift, table_checks_window, data_quality_daily, quality_scan, quality_scan_lags, anchor_export, verify_symbols, volume_count_correlation, orders_store)
    return {f.__name__: f for f in named}
