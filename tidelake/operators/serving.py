"""Hourly aggregates served to dashboards. Sums are exact decimals; ratios divide two exact sums as doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["symbol", "summary_hour"]


def hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts.cast("timestamp"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null when b is null or 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def weighted_mean(value: Column, weight: Column, where: Column | None = None) -> Column:
    """sum(value x weight) / sum(weight) over rows where both are there."""
    ok = value.isNotNull() & weight.isNotNull() if where is None else where & value.isNotNull() & weight.isNotNull()
    return ratio(F.sum(F.when(ok, value.cast("decimal(20,8)") * weight.cast("decimal(18,8)"))), F.sum(F.when(ok, weight)))


def bars_by_hour(bars: DataFrame) -> DataFrame:
    """Open, high, low, close and sums per symbol and hour. Open and close are those of the first and last open_time (ties: the smallest value)."""
    rows = bars.filter("symbol is not null and open_time is not null").withColumn("summary_hour", hour(F.col("open_time")))
    return rows.groupBy(*KEYS).agg(
        F.min(F.when(F.col("open").isNotNull(), F.struct("open_time", "open")))["open"].alias("open_price"),
        F.max("high").alias("high_price"),
        F.min("low").alias("low_price"),
        F.max(F.when(F.col("close").isNotNull(), F.struct("open_time", (-F.col("close")).alias("c"), "close")))["close"].alias("close_price"),
        F.sum("volume").cast("decimal(30,8)").alias("kline_volume"),
        F.sum("quote_volume").cast("decimal(30,8)").alias("kline_quote_volume"),
        F.sum("number_of_trades").alias("kline_number_of_trades"),
    )


def trades_by_hour(trades: DataFrame) -> DataFrame:
    """Counts, sums, mean price, volume-weighted price, maker and taker counts per symbol and hour. A null maker flag counts in neither."""
    rows = trades.filter("symbol is not null and trade_time is not null").withColumn("summary_hour", hour(F.col("trade_time")))
    return rows.groupBy(*KEYS).agg(
        F.count("*").alias("trade_count"),
        F.sum("qty").cast("decimal(30,8)").alias("trade_qty"),
        F.sum("quote_qty").cast("decimal(30,8)").alias("trade_quote_qty"),
        ratio(F.sum("price"), F.count("price")).cast("decimal(20,8)").alias("avg_trade_price"),
        ratio(F.sum("quote_qty"), F.sum("qty")).cast("decimal(20,8)").alias("vwap"),
        F.count_if(F.col("is_buyer_maker")).alias("maker_trade_count"),
        F.count_if(~F.col("is_buyer_maker")).alias("taker_trade_count"),
    )


def market_hourly(bars: DataFrame, trades: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Bars and trades of an hour side by side (full outer), or only for given keys (left joins from them)."""
    b, t = bars_by_hour(bars), trades_by_hour(trades)
    if keys is None:
        return b.join(t, KEYS, "full_outer")
    return keys.join(b, KEYS, "left").join(t, KEYS, "left")


def affected_hours(*touched: tuple[DataFrame, str]) -> DataFrame:
    """Distinct symbols and hours of several tables' rows; each with its time column."""
    out = None
    for df, time in touched:
        part = df.select("symbol", hour(F.col(time)).alias("summary_hour")).dropna()
        out = part if out is None else out.unionAll(part)
    return out.distinct()


def orders_by_hour(orders: DataFrame) -> DataFrame:
    """Counts, rates, delays, quantities and direction-split fill prices per symbol and hour of creation."""
    rows = orders.filter("symbol is not null and created_at is not null").withColumn("summary_hour", hour(F.col("created_at")))
    filled = F.col("order_status") == "FILLED"
    delay = F.unix_seconds(F.col("filled_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    side = lambda s: filled & (F.col("side") == s)
    return rows.groupBy(*KEYS).agg(
        F.count("*").alias("total_orders"),
        F.count_if(filled).alias("filled_orders"),
        F.count_if(F.col("order_status") == "CANCELED").alias("canceled_orders"),
        ratio(F.count_if(filled), F.count("*")).alias("fill_rate"),
        ratio(F.count_if(F.col("order_status") == "CANCELED"), F.count("*")).alias("cancel_rate"),
        F.avg(F.when(filled, delay)).alias("avg_fill_delay_sec"),
        ratio(F.sum("order_qty"), F.count("order_qty")).cast("decimal(20,8)").alias("avg_order_qty"),
        ratio(F.sum("filled_qty"), F.count("filled_qty")).cast("decimal(20,8)").alias("avg_filled_qty"),
        F.sum("order_qty").cast("decimal(30,8)").alias("total_order_qty"),
        F.sum("filled_qty").cast("decimal(30,8)").alias("total_filled_qty"),
        weighted_mean(F.col("avg_fill_price"), F.col("filled_qty"), side("BUY")).cast("decimal(20,8)").alias("avg_buy_fill_price"),
        weighted_mean(F.col("avg_fill_price"), F.col("filled_qty"), side("SELL")).cast("decimal(20,8)").alias("avg_sell_fill_price"),
        F.coalesce(F.sum(F.when(side("BUY"), F.col("filled_qty"))), F.lit(0)).cast("decimal(30,8)").alias("buy_filled_qty"),
        F.coalesce(F.sum(F.when(side("SELL"), F.col("filled_qty"))), F.lit(0)).cast("decimal(30,8)").alias("sell_filled_qty"),
    )


def execution_hourly(orders: DataFrame, market: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """orders_by_hour beside the market's volume-weighted price of the hour, with the distance to it in basis points by side; with keys only for these hours, each in a row."""
    hours = orders_by_hour(orders)
    if keys is not None:
        hours = keys.join(hours, KEYS, "left")
    joined = hours.join(market.select(*KEYS, F.col("vwap").alias("benchmark_vwap")), KEYS, "left")
    v, buy, sell = (F.col(c).cast("double") for c in ("benchmark_vwap", "avg_buy_fill_price", "avg_sell_fill_price"))
    cost = F.coalesce((buy - v) * F.col("buy_filled_qty").cast("double"), F.lit(0.0)) + F.coalesce((v - sell) * F.col("sell_filled_qty").cast("double"), F.lit(0.0))
    return joined.withColumns({
        "buy_slippage_bps": (buy - v) / F.nullif(v, F.lit(0.0)) * 10000,
        "sell_slippage_bps": (v - sell) / F.nullif(v, F.lit(0.0)) * 10000,
        "slippage_cost_quote": cost.cast("decimal(30,8)"),
    })


def execution_vs_market(execution: DataFrame, market: DataFrame) -> DataFrame:
    """The serving view: execution figures with the market's beside them."""
    m = market.select(*KEYS, "close_price", "trade_count", "kline_volume")
    return execution.withColumnRenamed("benchmark_vwap", "market_vwap").join(m, KEYS, "left")
