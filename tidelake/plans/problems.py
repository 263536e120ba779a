"""The queries of the general problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.functions.parsing import floor_to, interval_seconds, json_fields, order_status, status_rank, symbol_key, utc_timestamp
from tidelake.operators import change_log, column_profile, late_periods, quotient_dedup, regular_grid, schema_lifespan
from tidelake.session import scratch, table

PERIODS = late_periods.Periods(period_s=3600, lateness_s=6 * 3600, idle_timeout_s=3600)


def corrected_hours(spark: SparkSession, d: str) -> DataFrame:
    """Trades of each symbol and hour, counted or diverted by their source's watermark. The tables are whole: at their end every source has passed every hour."""
    trades = table(spark, d, "processed_trades")
    arrival, source = utc_timestamp(F.col("ingest_time")), F.concat_ws("-", "source_topic", "source_partition")
    once = late_periods.first_arrivals(trades, {"symbol": F.col("symbol"), "trade_id": F.col("trade_id")}, F.col("trade_time"), arrival, source)
    stamps = trades.select("source_topic", "source_partition", "ingest_time").distinct()  # a stamp is read once, not once a row
    return late_periods.corrected(stamps, once, PERIODS, ["symbol"], arrival, source, scratch(spark, "late-periods"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Hours whose published trade count differs from the trades that arrived up to the cut-off."""
    counted = corrected_hours(spark, d).select("symbol", F.col("period_epoch").alias("hour_epoch"), "counted", F.lit(None).cast("bigint").alias("published"))
    hours = table(spark, d, "market_hourly_summary").select("symbol", F.unix_seconds(F.col("summary_hour").cast("timestamp")).alias("hour_epoch"), F.struct("updated_at", "trade_count").alias("version"))
    valid = hours.groupBy("symbol", "hour_epoch").agg(F.max("version").alias("version")).select("symbol", "hour_epoch", F.lit(None).cast("bigint").alias("counted"), F.col("version.trade_count").alias("published"))
    both = counted.unionByName(valid).groupBy("symbol", "hour_epoch").agg(F.coalesce(F.max("counted"), F.lit(0)).alias("counted"), F.coalesce(F.max("published"), F.lit(0)).alias("published"))
    return both.filter("counted <> published").select("symbol", "hour_epoch")


def p1_corrected_hours(spark: SparkSession, d: str) -> DataFrame:
    """Counted and diverted trades of each symbol and hour of event time."""
    return corrected_hours(spark, d).select("symbol", F.col("period_epoch").alias("hour_epoch"), "counted", "diverted")


def p1_closings(spark: SparkSession, d: str) -> DataFrame:
    """When each hour closed, and how many sources were waited for and excused."""
    trades = table(spark, d, "processed_trades")
    out = late_periods.closings(trades, PERIODS, F.col("trade_time"), utc_timestamp(F.col("ingest_time")), F.concat_ws("-", "source_topic", "source_partition"))
    return out.select(F.col("period_epoch").alias("hour_epoch"), F.unix_micros("closed_at").alias("closed_us"), "sources_passed", "sources_excused", "last_source")


def raw_trade_ids(spark: SparkSession, d: str) -> DataFrame:
    """raw_trades with symbol and trade_id read from the payload; both null in a message that is no JSON object."""
    raw = table(spark, d, "raw_trades")
    value = raw.withColumn("_value", json_fields(F.col("message_value"), ["symbol", "trade_id"]))
    symbol = F.coalesce(symbol_key(F.col("_value.symbol")), symbol_key(F.col("message_key")))
    trade_id = F.trim("_value.trade_id").try_cast("bigint")
    return value.withColumns({"_symbol": symbol, "_trade_id": trade_id}).drop("_value")


def parallelism(spark: SparkSession) -> int:
    """How many shards or buckets to store for a session: as many as it shuffles into."""
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Trades with more than one row, in the raw log and in the typed table, as their stored quotient tables have them."""
    out = None
    for name, rows, symbol, trade in (("raw_trades", raw_trade_ids(spark, d), "_symbol", "_trade_id"), ("processed_trades", table(spark, d, "processed_trades"), "symbol", "trade_id")):
        index = quotient_dedup.QuotientIndex(spark, scratch(spark, f"ids-{name}"), (parallelism(spark) - 1).bit_length())
        index.count(rows, "all", F.col(symbol), F.col(trade))
        part = index.stored().filter("n > 1").select(F.lit(name).alias("table_name"), F.col("space").alias("symbol"), F.col("identifier").alias("trade_id"))
        out = part if out is None else out.unionByName(part)
    return out


def p2_raw_once(spark: SparkSession, d: str) -> DataFrame:
    """raw_trades with one copy of each trade, the first by arrival; messages without identity stay."""
    rows = raw_trade_ids(spark, d)
    order = [utc_timestamp(F.col("ingest_time")), F.col("kafka_partition"), F.col("kafka_offset"), F.md5("message_value")]
    return quotient_dedup.keep_first(rows, F.col("_symbol"), F.col("_trade_id"), order).drop("_symbol", "_trade_id")


def p2_trades_once(spark: SparkSession, d: str) -> DataFrame:
    """processed_trades with one copy of each trade, the first by arrival. The trade's time is in microseconds, its numbers are doubles."""
    rows = table(spark, d, "processed_trades")
    kept = quotient_dedup.keep_first(rows, F.col("symbol"), F.col("trade_id"), [utc_timestamp(F.col("ingest_time")), *[F.col(c) for c in ("source_partition", "source_offset", "trade_time", "price", "qty", "quote_qty", "is_buyer_maker", "is_best_match")]])
    return kept.withColumns({c: F.col(c).cast("double") for c in ("price", "qty", "quote_qty")}).withColumn("trade_us", F.unix_micros(F.col("trade_time").cast("timestamp"))).drop("trade_time")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of the bar messages' fields along each partition."""
    return schema_lifespan.changes(table(spark, d, "raw_klines"), ["kafka_partition"], "kafka_offset", "message_value")


#: The columns of processed_klines that a message can give.
BAR_COLUMNS = {
    "symbol": "string", "interval": "string", "open_time": "timestamp", "close_time": "timestamp",
    "open": "decimal(20,8)", "high": "decimal(20,8)", "low": "decimal(20,8)", "close": "decimal(20,8)",
    "volume": "decimal(20,8)", "quote_volume": "decimal(24,8)", "number_of_trades": "bigint", "is_closed": "boolean",
}


def unified_bars(raw: DataFrame, aliases: dict = schema_lifespan.BAR_ALIASES) -> DataFrame:
    """Bar messages as one table with the columns of processed_klines, whatever shape a message has."""
    bars = schema_lifespan.unify(raw.withColumn("_key", F.col("message_key")), "message_value", BAR_COLUMNS, aliases)
    return bars.select(
        F.coalesce(symbol_key(F.col("symbol")), symbol_key(F.substring_index("_key", "_", 1))).alias("symbol"),
        F.coalesce("interval", F.when(F.instr("_key", "_") > 0, F.substring_index("_key", "_", -1))).alias("interval"),
        *[c for c in BAR_COLUMNS if c not in ("symbol", "interval")],
        F.col("kafka_topic").alias("source_topic"), F.col("kafka_partition").alias("source_partition"), F.col("kafka_offset").alias("source_offset"), "ingest_time",
        utc_timestamp(F.col("ingest_time")).alias("updated_at"),
    )


def p3_bars(spark: SparkSession, d: str) -> DataFrame:
    """raw_klines as one table."""
    return unified_bars(table(spark, d, "raw_klines"))


def p3_bars_values(spark: SparkSession, d: str) -> DataFrame:
    """p3_bars with times in milliseconds and numbers as doubles."""
    bars = p3_bars(spark, d).withColumnsRenamed({"interval": "kline_interval"}).drop("updated_at")
    times = {c: F.unix_millis(F.col(c)) for c in ("open_time", "close_time")}
    return bars.withColumns(times | {c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume", "quote_volume")})


#: A silence of more than a day ends a series of bars.
SILENCE_S = 24 * 3600


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Every slot of every series of bars: readings, time-weighted close, coverage, and whether it was observed or filled."""
    bars = table(spark, d, "processed_klines")
    held = regular_grid.step_intervals(bars, {"symbol": F.col("symbol"), "kline_interval": F.col("interval")}, F.col("open_time"), interval_seconds(F.col("interval")), F.col("close"), [F.col("source_offset"), F.col("updated_at")])
    return regular_grid.onto_grid(held, ["symbol", "kline_interval"], SILENCE_S)


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    """grid() with its quotients to six digits."""
    return grid(spark, d).withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("mean", "coverage")})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Slots without a bar between two neighbouring slots at most a day apart."""
    return grid(spark, d).filter("marked = 'filled'").select("symbol", "kline_interval", "slot_epoch")


#: The profiled columns of each table.
PROFILED = {"processed_trades": ["price", "qty"], "processed_klines": ["volume"]}


def each_load(spark: SparkSession, d: str, build) -> DataFrame:
    """build(rows, load keys, columns) of each profiled table, side by side, with table and column names. A load is a symbol and UTC hour of ingest."""
    out = None
    for name, columns in PROFILED.items():
        rows = table(spark, d, name)
        if name == "processed_klines":
            rows = rows.filter("interval = '1m'")
        rows = rows.withColumn("_hour", floor_to(F.unix_seconds(utc_timestamp(F.col("ingest_time"))), 3600)).filter("_hour is not null")
        part = column_profile.named(build(rows, {"symbol": F.col("symbol"), "load_epoch": F.col("_hour")}, columns), columns).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _profiles(spark: SparkSession):
    return lambda rows, load, columns: column_profile.profile_loads(rows, load, columns, lambda label: scratch(spark, label))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of each column and load."""
    return each_load(spark, d, _profiles(spark))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Loads that stand out, by column."""
    profiled = _profiles(spark)
    found = each_load(spark, d, lambda *load: column_profile.findings(profiled(*load), ["symbol"], "load_epoch", 3600))
    return found.select("table_name", "column_name", "symbol", "load_epoch", "finding")


def p5_drift(spark: SparkSession, d: str) -> DataFrame:
    """Population stability index and chi-square of each load against the hour before."""
    return each_load(spark, d, lambda *load: column_profile.drift(column_profile.value_counts(*load), ["symbol"], "load_epoch", 3600))


#: What texts of the trades should look like.
PATTERNS = {"symbol": "^[A-Z]+USQ$", "source_topic": "^trades$", "ingest_time": r"^\d{4}-\d\d-\d\d[T ]"}


def p5_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the trades by symbol: nulls, distinct values, ends of their range, and values that break their column's pattern."""
    rows = table(spark, d, "processed_trades").withColumn("_load", F.col("symbol"))
    out = column_profile.profile_loads(rows, {"load": F.col("_load")}, list(PATTERNS), lambda label: scratch(spark, label), PATTERNS)
    return column_profile.named(out, list(PATTERNS)).select("column_name", F.col("load").alias("symbol"), F.col("rows").alias("n_rows"), "nulls", F.col("distinct").alias("n_distinct"), "violations", "low_text", "high_text")


def order_changes(spark: SparkSession, d: str) -> DataFrame:
    """staging_orders with the status read into one spelling, its rank and the kind of change."""
    feed = table(spark, d, "staging_orders")
    status = order_status(F.col("order_status"), F.col("event_type"))
    kind = F.when(F.col("_status") == "NEW", change_log.INSERT).when(F.col("_status") == "DELETED", change_log.DELETE).when(F.col("_status").isNotNull(), change_log.UPDATE)
    return feed.withColumn("_status", status).withColumns({"_rank": status_rank(F.col("_status")), "_kind": kind})


def order_log(spark: SparkSession, path: str) -> change_log.ChangeLog:
    payload = ["_status", "event_time", "client_id", "symbol", "side", "order_type", "order_price", "order_qty", "filled_qty", "avg_fill_price", "source_partition", "source_offset", "ingest_time"]
    return change_log.ChangeLog(spark, path, ["order_id"], [F.col("event_time"), F.col("_rank"), F.col("source_offset")], F.col("_kind"), payload, parallelism(spark))


def p6_orders(spark: SparkSession, d: str) -> DataFrame:
    """The current orders, rebuilt from sorted runs (one a Kafka partition), compacted into one."""
    log = order_log(spark, scratch(spark, "order-runs"))
    log.append(order_changes(spark, d), "run-000001", F.col("source_partition"))
    log.compact("run-000002")
    return log.read().withColumnRenamed("_status", "order_status")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Orders that exist after the whole feed, with status and time of their last change: sorted runs, one a Kafka partition, merged on read."""
    log = order_log(spark, scratch(spark, "order-runs"))
    log.payload = ["_status", "event_time"]
    log.append(order_changes(spark, d), "run-000001", F.col("source_partition"))
    return log.read().withColumnRenamed("_status", "order_status").select("order_id", "order_status", F.unix_millis(F.col("event_time").cast("timestamp")).alias("event_ms"))


def p5_profile_counts(spark: SparkSession, d: str) -> DataFrame:
    """The countable part of the profile."""
    return p5_profile(spark, d).select("table_name", "column_name", "symbol", "load_epoch", F.col("rows").alias("n_rows"), "nulls", "nonpositive", F.col("distinct").alias("n_distinct"), F.col("top").alias("n_top"), F.round("median", 9).alias("median"))


def p6_orders_values(spark: SparkSession, d: str) -> DataFrame:
    """p6_orders with the time in milliseconds and numbers as doubles."""
    numbers = {c: F.col(c).cast("double") for c in ("order_price", "order_qty", "filled_qty", "avg_fill_price")}
    return p6_orders(spark, d).withColumns(numbers).withColumn("event_ms", F.unix_millis(F.col("event_time").cast("timestamp"))).drop("event_time", "ingest_time", "source_partition")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_corrected_hours, p1_closings, p2_found, p2_raw_once, p2_trades_once, p3_found, p3_bars_values, p4_found, p4_grid, p5_found, p5_profile_counts, p5_drift, p5_patterns, p6_found, p6_orders_values)}
