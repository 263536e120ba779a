"""The MERGE family and its affected keys over the test tables, with SQL for DuckDB.

A target is a table as it stood before an ingest window; a source is what the window brought, or all of it. Whole rows
come out: times in epoch milliseconds, decimals as doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.parsing import order_status, utc_timestamp
from tidelake.operators import dedup, lifecycle, merge, serving
from tidelake.plans import reference
from tidelake.plans.problem_oracles import _BAR_VALUES, _ingest
from tidelake.plans.problems import p3_bars
from tidelake.plans.reference import WINDOW, minute_bars, once_orders
from tidelake.session import table

BAR_KEY = ["symbol", "interval", "open_time"]
BAR_NUMBERS = ["open", "high", "low", "close", "volume", "quote_volume"]
ORDER_NUMBERS = ["order_price", "order_qty", "filled_qty", "avg_fill_price"]
CARRIED = ["client_id", "symbol", "side", "order_type", *ORDER_NUMBERS, "event_type", "simulated_parameters", "source_topic", "source_partition", "ingest_time"]


def _before(df: DataFrame) -> DataFrame:
    return df.filter(utc_timestamp(F.col("ingest_time")) < utc_timestamp(F.lit(WINDOW[0])))


def _inside(df: DataFrame) -> DataFrame:
    return dedup.in_ingest_window(df, *WINDOW)


def _plain(df: DataFrame, times: list[str], numbers: list[str]) -> DataFrame:
    out = {c: F.unix_millis(F.col(c).cast("timestamp")) for c in times} | {c: F.col(c).cast("double") for c in numbers}
    return df.withColumns({c: v for c, v in out.items() if c in df.columns}).withColumnsRenamed({"interval": "kline_interval"})


def _bars_out(df: DataFrame) -> DataFrame:
    return _plain(df, ["open_time", "close_time"], BAR_NUMBERS).drop("updated_at")


def raw_bars(spark: SparkSession, d: str) -> DataFrame:
    return p3_bars(spark, d).dropna(subset=BAR_KEY)


def _staged(bars: DataFrame) -> DataFrame:
    """One version of each bar of a batch: closed first, then by offset and ingest."""
    return dedup.latest_by(bars, BAR_KEY, [F.col("is_closed"), F.col("source_offset"), F.col("ingest_time"), F.col("source_partition")])


def staging_klines_merge(spark: SparkSession, d: str) -> DataFrame:
    """A window's bars merged into the staged ones: matched rows are overwritten, the others added."""
    bars = raw_bars(spark, d)
    return _bars_out(merge.upsert(_staged(_before(bars)), _staged(_inside(bars)), BAR_KEY, check=False))


def klines_affected(spark: SparkSession, d: str) -> DataFrame:
    """Every version, from all time, of the bars that the window touched."""
    bars = raw_bars(spark, d)
    return _bars_out(dedup.touched(bars, _inside(bars), BAR_KEY))


def _latest_bars(bars: DataFrame) -> DataFrame:
    return dedup.latest_by(bars, BAR_KEY, [F.col("source_offset"), F.col("updated_at"), F.col("source_partition"), F.col("ingest_time")])


def _current_bars(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "processed_klines").dropna(subset=BAR_KEY)
    return dedup.latest_by(now, BAR_KEY, [F.col("source_offset"), F.col("updated_at"), F.col("close"), *[F.col(c) for c in ("open", "high", "low", "volume", "quote_volume", "number_of_trades", "is_closed", "close_time", "ingest_time")]])


def klines_window_merge(spark: SparkSession, d: str) -> DataFrame:
    """The touched bars' latest versions merged into the current table unless that has a later offset."""
    bars = raw_bars(spark, d)
    source = _latest_bars(dedup.touched(bars, _inside(bars), BAR_KEY))
    return _bars_out(merge.upsert(_current_bars(spark, d), source, BAR_KEY, guard=merge.not_older("source_offset"), check=False))


def klines_full_merge(spark: SparkSession, d: str) -> DataFrame:
    """The same over all bars; ingest_time is neither overwritten nor inserted."""
    source = _latest_bars(raw_bars(spark, d)).drop("ingest_time")
    return _bars_out(merge.upsert(_current_bars(spark, d), source, BAR_KEY, guard=merge.not_older("source_offset"), check=False))


ORDER_KEY = ["order_id", "order_status", "event_time"]


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "staging_orders").withColumn("order_status", order_status(F.col("order_status"), F.col("event_type"))).dropna(subset=ORDER_KEY)


def _staged_orders(feed: DataFrame) -> DataFrame:
    return dedup.latest_by(feed, ORDER_KEY, [utc_timestamp(F.col("ingest_time")), F.col("source_offset"), F.col("source_partition")])


def _orders_out(df: DataFrame) -> DataFrame:
    return _plain(df, ["event_time", "created_at", "updated_at", "filled_at", "canceled_at"], ORDER_NUMBERS)


def staging_orders_merge(spark: SparkSession, d: str) -> DataFrame:
    """A window's order events merged into the staged ones."""
    feed = _feed(spark, d)
    return _orders_out(merge.upsert(_staged_orders(_before(feed)), _staged_orders(_inside(feed)), ORDER_KEY, check=False)).drop("updated_at")


def orders_affected(spark: SparkSession, d: str) -> DataFrame:
    """Every event, from all time, of the orders that the window touched."""
    feed = _feed(spark, d)
    return _orders_out(dedup.touched(feed, _inside(feed), ["order_id"])).select("order_id", "order_status", "event_time", "source_partition", "source_offset")


def orders_window_merge(spark: SparkSession, d: str) -> DataFrame:
    """The touched orders folded from all their events and merged into the order table unless that is newer."""
    feed = _feed(spark, d)
    folded = lifecycle.fold(dedup.touched(feed, _inside(feed), ["order_id"]), CARRIED)
    return _orders_out(lifecycle.rebuild(once_orders(spark, d), folded))


def orders_full_merge(spark: SparkSession, d: str) -> DataFrame:
    """All orders folded and merged; earlier fill and cancel times are kept."""
    return _orders_out(lifecycle.carry_forward(once_orders(spark, d), lifecycle.fold(_feed(spark, d), CARRIED)))


def _published(spark: SparkSession, d: str) -> DataFrame:
    return dedup.latest_by(table(spark, d, "market_hourly_summary").dropna(subset=["symbol", "summary_hour"]), ["symbol", "summary_hour"], [F.col("updated_at"), F.col("trade_count")]).withColumn("summary_hour", F.col("summary_hour").cast("timestamp"))


#: Added to quotients before they are rounded, so that two engines round a tie alike.
OFF_TIES = 1e-9
MARKET_NUMBERS = ["open_price", "high_price", "low_price", "close_price", "kline_volume", "kline_quote_volume", "trade_qty", "trade_quote_qty", "avg_trade_price", "vwap"]


def _market_out(df: DataFrame) -> DataFrame:
    means = {c: F.round(F.col(c).cast("double") + OFF_TIES, 6) for c in ("avg_trade_price", "vwap")}
    return _plain(df.withColumns(means), ["summary_hour"], MARKET_NUMBERS).drop("updated_at")


def market_window_merge(spark: SparkSession, d: str) -> DataFrame:
    """The hours that the window touched, aggregated anew and merged into the published ones."""
    bars, trades = minute_bars(spark, d), table(spark, d, "processed_trades")
    keys = serving.affected_hours((_inside(bars), "open_time"), (_inside(trades), "trade_time"))
    return _market_out(merge.upsert(_published(spark, d), serving.market_hourly(bars, trades, keys), serving.KEYS, check=False))


def market_full_merge(spark: SparkSession, d: str) -> DataFrame:
    """All hours aggregated anew and merged into the published ones."""
    return _market_out(merge.upsert(_published(spark, d), serving.market_hourly(minute_bars(spark, d), table(spark, d, "processed_trades")), serving.KEYS, check=False))


EXECUTION = ["symbol", "summary_hour", "total_orders", "filled_orders", "canceled_orders", "fill_rate", "cancel_rate", "avg_fill_delay_sec", "avg_order_qty", "avg_filled_qty", "total_order_qty", "total_filled_qty", "benchmark_vwap", "avg_buy_fill_price", "avg_sell_fill_price", "buy_slippage_bps", "sell_slippage_bps", "slippage_cost_quote"]


def _execution_out(df: DataFrame) -> DataFrame:
    rounded = {c: F.round(F.col(c).cast("double") + OFF_TIES, 6) for c in ("fill_rate", "cancel_rate", "avg_fill_delay_sec", "avg_order_qty", "avg_filled_qty", "avg_buy_fill_price", "avg_sell_fill_price", "buy_slippage_bps", "sell_slippage_bps", "slippage_cost_quote")}
    return _plain(df, ["summary_hour"], [c for c in EXECUTION if c.startswith(("total_order_", "total_filled_", "bench"))]).withColumns(rounded)


def _execution(orders: DataFrame, market: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return serving.execution_hourly(orders, market, keys).select(*EXECUTION)


def execution_window_merge(spark: SparkSession, d: str) -> DataFrame:
    """The hours whose orders the window touched, aggregated anew from all orders and merged into those as they stood before."""
    orders, market = once_orders(spark, d), _published(spark, d)
    keys = serving.affected_hours((_inside(orders), "created_at"))
    return _execution_out(merge.upsert(_execution(_before(orders), market), _execution(orders, market, keys), serving.KEYS, check=False))


def execution_full_merge(spark: SparkSession, d: str) -> DataFrame:
    """All hours aggregated anew and merged into those as they stood before."""
    orders, market = once_orders(spark, d), _published(spark, d)
    return _execution_out(merge.upsert(_execution(_before(orders), market), _execution(orders, market), serving.KEYS, check=False))


# SQL

_IN = lambda c="ingest_time": f"({_ingest(c)} >= '{WINDOW[0]}+00'::timestamptz and {_ingest(c)} < '{WINDOW[1]}+00'::timestamptz)"
_PRE = lambda c="ingest_time": f"({_ingest(c)} < '{WINDOW[0]}+00'::timestamptz)"


def _overwrite(target: str, source: str, keys: list[str]) -> str:
    """A MERGE without guard that sets every column: the source, and what of the target it does not match."""
    same = " and ".join(f's."{k}" = t."{k}"' for k in keys)
    return f"select * from {source} union all by name select * from {target} t where not exists (select 1 from {source} s where {same})"


def _guarded(target: str, source: str, keys: list[str], columns: list[str], allowed: str, special: dict[str, str] | None = None) -> str:
    """A MERGE under a guard: the columns (null in inserted rows where the source has none)."""
    special = special or {}
    same = " and ".join(f's."{k}" = t."{k}"' for k in keys)
    out = []
    for c in columns:
        fresh, changed = special.get(c, (f's."{c}"', f's."{c}"'))
        out.append(f'case when t._t is null then {fresh} when s._s is null then t."{c}" when {allowed} then {changed} else t."{c}" end "{c}"')
    return f"select {', '.join(out)} from (select *, 1 _t from {target}) t full join (select *, 1 _s from {source}) s on {same}"


_BAR_COLUMNS = ["symbol", "kline_interval", "open_time", "close_time", *BAR_NUMBERS, "number_of_trades", "is_closed", "source_topic", "source_partition", "source_offset", "ingest_time"]
_BARS = f"bars as (select * from ({_BAR_VALUES}) where symbol is not null and kline_interval is not null and open_time is not null)"
_PICK = lambda name, rows, part, order: f"{name} as (select * exclude (rn) from (select *, row_number() over (partition by {part} order by {order}) rn from {rows}) where rn = 1)"
_BAR_PART = "symbol, kline_interval, open_time"
_STAGE = "is_closed desc nulls last, source_offset desc nulls last, ingest_time desc nulls last, source_partition desc nulls last"
_LAST = f"source_offset desc nulls last, {_ingest()} desc nulls last, source_partition desc nulls last, ingest_time desc nulls last"
_TOUCHED = f"touched as (select b.* from bars b where exists (select 1 from bars w where {_IN('w.ingest_time')} and w.symbol = b.symbol and w.kline_interval = b.kline_interval and w.open_time = b.open_time))"
_CURRENT = """current_rows as (select symbol, "interval" kline_interval, epoch_ms(open_time) open_time, epoch_ms(close_time) close_time, cast("open" as double) "open", cast(high as double) high, cast(low as double) low, cast("close" as double) "close", cast(volume as double) volume, cast(quote_volume as double) quote_volume,
  number_of_trades, is_closed, source_topic, source_partition, source_offset, ingest_time from (select *, row_number() over (partition by symbol, "interval", open_time order by source_offset desc nulls last, updated_at desc nulls last, "close" desc nulls last, "open" desc nulls last, high desc nulls last, low desc nulls last, volume desc nulls last, quote_volume desc nulls last, number_of_trades desc nulls last, is_closed desc nulls last, close_time desc nulls last, ingest_time desc nulls last) rn
  from processed_klines where symbol is not null and "interval" is not null and open_time is not null) where rn = 1)"""
_BK = ["symbol", "kline_interval", "open_time"]
_STATUS = "case when s in ('NEW', 'PARTIALLY_FILLED', 'FILLED', 'CANCELED', 'DELETED') then s when e in ('NEW', 'PARTIALLY_FILLED', 'FILLED', 'CANCELED', 'DELETED') then e end"
_FEED = f"""feed as (select * from (select * exclude (order_status, s, e), {_STATUS} order_status from (select *, regexp_replace(regexp_replace(regexp_replace(upper(trim(order_status)), '[\\s-]+', '_', 'g'), '^ORDER_', ''), '^CANCELLED$', 'CANCELED') s,
  regexp_replace(regexp_replace(regexp_replace(upper(trim(event_type)), '[\\s-]+', '_', 'g'), '^ORDER_', ''), '^CANCELLED$', 'CANCELED') e from staging_orders)) where order_id is not null and order_status is not null and event_time is not null)"""
_EVENT_OUT = f"order_id, order_status, epoch_ms(event_time) event_time, client_id, symbol, side, order_type, {', '.join(f'cast({c} as double) {c}' for c in ORDER_NUMBERS)}, event_type, simulated_parameters, source_topic, source_partition, source_offset, ingest_time"
_STAGE_ORDERS = f"{_ingest()} desc nulls last, source_offset desc nulls last, source_partition desc nulls last"
_LINE = "row_number() over (partition by order_id order by event_time, case order_status when 'NEW' then 1 when 'PARTIALLY_FILLED' then 2 when 'DELETED' then 4 else 3 end, source_offset nulls first, order_status)"
_FOLD = lambda rows: f"""line as (select *, {_LINE} rn from {rows}), life as (select order_id, max(rn) last_rn, min(event_time) c, max(event_time) u, max(event_time) filter (order_status = 'FILLED') f, max(event_time) filter (order_status = 'CANCELED') x from line group by 1),
  folded as (select l.* exclude (rn, event_time, updated_at), c created_at, u updated_at, f filled_at, x canceled_at from line l join life g on l.order_id = g.order_id and l.rn = g.last_rn)"""  # noqa: E731
_ORDER_COLUMNS = ["order_id", "client_id", "symbol", "side", "order_type", *ORDER_NUMBERS, "event_type", "order_status", "created_at", "updated_at", "filled_at", "canceled_at", "simulated_parameters", "source_topic", "source_partition", "source_offset", "ingest_time"]
_ORDER_OUT = ", ".join(f"epoch_ms({c}) {c}" if c.endswith("_at") else f"cast({c} as double) {c}" if c in ORDER_NUMBERS else c for c in _ORDER_COLUMNS)
_NEWER = "s.updated_at >= t.updated_at"
_KEPT = {"created_at": ("s.created_at", "least(s.created_at, t.created_at)"), "filled_at": ("s.filled_at", "coalesce(s.filled_at, t.filled_at)"), "canceled_at": ("s.canceled_at", "coalesce(s.canceled_at, t.canceled_at)")}

_MARKET_COLUMNS = ["symbol", "summary_hour", *MARKET_NUMBERS, "kline_number_of_trades", "trade_count", "maker_trade_count", "taker_trade_count"]
_MS = lambda c: f"{c} * 1000"
_PUBLISHED = f"""published as (select symbol, epoch_ms(summary_hour) summary_hour, {', '.join(f'cast({c} as double) {c}' for c in MARKET_NUMBERS)}, kline_number_of_trades, trade_count, maker_trade_count, taker_trade_count
  from (select *, row_number() over (partition by symbol, summary_hour order by updated_at desc nulls last, trade_count desc nulls last) rn from market_hourly_summary where symbol is not null and summary_hour is not null) where rn = 1)"""
_SUMS = f"with {reference._BARS}, {reference._BAR_HOURS}, {reference._TRADE_HOURS}"
_ANEW = "select {k}.symbol, {k}.summary_hour * 1000 summary_hour, " + ", ".join(f"cast(cast({c} as decimal(20,8)) as double) {c}" if c in ("avg_trade_price", "vwap") else f"cast(cast({c} as decimal(30,8)) as double) {c}" for c in MARKET_NUMBERS) + ", kline_number_of_trades, trade_count, maker_trade_count, taker_trade_count"

_SIDE = lambda side: f"cast(cast(cast(sum(avg_fill_price * cast(filled_qty as decimal(18,8))) filter (order_status = 'FILLED' and side = '{side}') as double) / nullif(cast(sum(filled_qty) filter (order_status = 'FILLED' and side = '{side}' and avg_fill_price is not null) as double), 0) as decimal(20,8)) as double)"
_HOURS_OF = lambda rows: f"""select symbol, {reference._HOUR.format('created_at')} * 1000 summary_hour, count(*) total_orders, count(*) filter (order_status = 'FILLED') filled_orders, count(*) filter (order_status = 'CANCELED') canceled_orders,
  round(count(*) filter (order_status = 'FILLED') / count(*)::double + 1e-9, 6) fill_rate, round(count(*) filter (order_status = 'CANCELED') / count(*)::double + 1e-9, 6) cancel_rate,
  round(avg(case when order_status = 'FILLED' then floor(epoch(filled_at)) - floor(epoch(created_at)) end) + 1e-9, 6) avg_fill_delay_sec,
  cast(cast(cast(sum(order_qty) as double) / nullif(count(order_qty), 0) as decimal(20,8)) as double) avg_order_qty, cast(cast(cast(sum(filled_qty) as double) / nullif(count(filled_qty), 0) as decimal(20,8)) as double) avg_filled_qty,
  cast(sum(order_qty) as double) total_order_qty, cast(sum(filled_qty) as double) total_filled_qty, {_SIDE('BUY')} avg_buy_fill_price, {_SIDE('SELL')} avg_sell_fill_price,
  coalesce(cast(sum(filled_qty) filter (order_status = 'FILLED' and side = 'BUY') as double), 0) bq, coalesce(cast(sum(filled_qty) filter (order_status = 'FILLED' and side = 'SELL') as double), 0) sq
  from {rows} where symbol is not null and created_at is not null group by 1, 2"""  # noqa: E731
_BESIDE = """select h.* exclude (bq, sq) replace (round(avg_order_qty + 1e-9, 6) as avg_order_qty, round(avg_filled_qty + 1e-9, 6) as avg_filled_qty, round(avg_buy_fill_price + 1e-9, 6) as avg_buy_fill_price, round(avg_sell_fill_price + 1e-9, 6) as avg_sell_fill_price), vwap benchmark_vwap, round((avg_buy_fill_price - vwap) / nullif(vwap, 0) * 10000 + 1e-9, 6) buy_slippage_bps, round((vwap - avg_sell_fill_price) / nullif(vwap, 0) * 10000 + 1e-9, 6) sell_slippage_bps,
  round(cast(cast(coalesce((avg_buy_fill_price - vwap) * bq, 0) + coalesce((vwap - avg_sell_fill_price) * sq, 0) as decimal(30,8)) as double) + 1e-9, 6) slippage_cost_quote from {hours} h left join published p on h.symbol = p.symbol and h.summary_hour = p.summary_hour"""
_EXEC = lambda source: f"""with {reference._ORDERS}, {_PUBLISHED}, was_hours as ({_HOURS_OF(f"(select * from orders_once where {_PRE()})")}), all_hours as ({_HOURS_OF('orders_once')}), was as ({_BESIDE.format(hours='was_hours')}), anew as ({_BESIDE.format(hours='all_hours')}), source as ({source}) {_overwrite('was', 'source', ['symbol', 'summary_hour'])}"""

ORACLES = {
    "staging_klines_merge": f"with {_BARS}, {_PICK('was', f'(select * from bars where {_PRE()})', _BAR_PART, _STAGE)}, {_PICK('fresh', f'(select * from bars where {_IN()})', _BAR_PART, _STAGE)} {_overwrite('was', 'fresh', _BK)}",
    "staged_bars": f"with {_BARS}, {_PICK('best', 'bars', _BAR_PART, _STAGE)} select symbol, kline_interval, open_time // 1000 open_time, is_closed, source_offset, \"open\", \"close\" from best",
    "kline_upsert": f"with {_BARS}, {_PICK('source', 'bars', _BAR_PART, _LAST)}, {_CURRENT}, merged as ({_guarded('current_rows', 'source', _BK, _BAR_COLUMNS, 's.source_offset >= t.source_offset')}) select symbol, kline_interval, cast(floor(open_time / 1000.0) as bigint) open_time, source_offset from merged",
    "klines_affected": f"with {_BARS}, {_TOUCHED} select * from touched",
    "klines_window_merge": f"with {_BARS}, {_TOUCHED}, {_PICK('source', 'touched', _BAR_PART, _LAST)}, {_CURRENT} {_guarded('current_rows', 'source', _BK, _BAR_COLUMNS, 's.source_offset >= t.source_offset')}",
    "klines_full_merge": f"with {_BARS}, {_PICK('source', 'bars', _BAR_PART, _LAST)}, {_CURRENT} {_guarded('current_rows', 'source', _BK, _BAR_COLUMNS, 's.source_offset >= t.source_offset', {'ingest_time': ('null', 't.ingest_time')})}",
    "staging_orders_merge": f"with {_FEED}, {_PICK('was', f'(select * from feed where {_PRE()})', 'order_id, order_status, event_time', _STAGE_ORDERS)}, {_PICK('fresh', f'(select * from feed where {_IN()})', 'order_id, order_status, event_time', _STAGE_ORDERS)} select {_EVENT_OUT} from ({_overwrite('was', 'fresh', ['order_id', 'order_status', 'event_time'])})",
    "orders_affected": f"with {_FEED} select order_id, order_status, epoch_ms(event_time) event_time, source_partition, source_offset from feed f where exists (select 1 from feed w where w.order_id = f.order_id and {_IN('w.ingest_time')})",
    "orders_window_merge": f"with {_FEED}, part as (select * from feed f where exists (select 1 from feed w where w.order_id = f.order_id and {_IN('w.ingest_time')})), {_FOLD('part')}, {reference._ORDERS} select {_ORDER_OUT} from ({_guarded('orders_once', 'folded', ['order_id'], _ORDER_COLUMNS, _NEWER)})",
    "orders_full_merge": f"with {_FEED}, {_FOLD('feed')}, {reference._ORDERS} select {_ORDER_OUT} from ({_guarded('orders_once', 'folded', ['order_id'], _ORDER_COLUMNS, _NEWER, _KEPT)})",
    "market_window_merge": f"{_SUMS}, {reference._KEYS}, {_PUBLISHED}, anew as ({_ANEW.format(k='k')} from keys k left join bar_hours b on b.symbol = k.symbol and b.summary_hour = k.summary_hour left join trade_hours t on k.symbol = t.symbol and k.summary_hour = t.summary_hour) select * replace (round(vwap + 1e-9, 6) as vwap, round(avg_trade_price + 1e-9, 6) as avg_trade_price) from ({_overwrite('published', 'anew', ['symbol', 'summary_hour'])})",
    "market_full_merge": f"{_SUMS}, {_PUBLISHED}, keys as (select symbol, summary_hour from bar_hours union select symbol, summary_hour from trade_hours), anew as ({_ANEW.format(k='k')} from keys k left join bar_hours b on b.symbol = k.symbol and b.summary_hour = k.summary_hour left join trade_hours t on k.symbol = t.symbol and k.summary_hour = t.summary_hour) select * replace (round(vwap + 1e-9, 6) as vwap, round(avg_trade_price + 1e-9, 6) as avg_trade_price) from ({_overwrite('published', 'anew', ['symbol', 'summary_hour'])})",
    "execution_window_merge": _EXEC(f"select * from anew a where exists (select 1 from orders_once o where {_IN('o.ingest_time')} and o.symbol = a.symbol and {reference._HOUR.format('o.created_at')} * 1000 = a.summary_hour)"),
    "execution_full_merge": _EXEC("select * from anew"),
}


def queries() -> dict:
    named = (staging_klines_merge, klines_affected, klines_window_merge, klines_full_merge, staging_orders_merge, orders_affected, orders_window_merge, orders_full_merge, market_window_merge, market_full_merge, execution_window_merge, execution_full_merge)
    return {f.__name__: f for f in named}
