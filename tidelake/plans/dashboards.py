"""Dashboard panels and alerts over the serving and observability tables, on DataFrames; their SQL for DuckDB stands beside them.

The tables are what the engine's own operators write: the published market hours, the executions, the daily quality
log, the anomalies of loads, the lags of ingested trades, and run and health logs made from the micro-batches' stamps.
Times are epoch seconds. Series and figures by symbol look at the last days of each symbol; ``symbol`` picks one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.functions.parsing import utc_timestamp
from tidelake.operators import quality, serving
from tidelake.plans import merges, reference
from tidelake.plans.problem_oracles import ORACLES as PROBLEM_SQL
from tidelake.plans.problem_oracles import _ingest
from tidelake.plans.problems import p5_found
from tidelake.session import table

DAY = 86400
SUCCEEDED, FAILED = ("SUCCESS", "SUCCEEDED"), ("FAILED", "FAILURE", "ERROR")
MARKET = ["open_price", "high_price", "low_price", "close_price", "kline_volume", "kline_quote_volume", "kline_number_of_trades", "trade_count", "trade_qty", "trade_quote_qty", "avg_trade_price", "vwap", "maker_trade_count", "taker_trade_count"]
OFF_TIES = 1e-9


def market(spark: SparkSession, d: str) -> DataFrame:
    """symbol, h and the published figures."""
    rows = merges._published(spark, d)
    return rows.select("symbol", F.unix_seconds("summary_hour").alias("h"), *[F.col(c).cast("double" if c not in ("kline_number_of_trades", "trade_count", "maker_trade_count", "taker_trade_count") else "bigint").alias(c) for c in MARKET])


def execution(spark: SparkSession, d: str) -> DataFrame:
    """symbol, h and the figures of the hour's orders."""
    rows = merges._execution_out(serving.execution_hourly(reference.once_orders(spark, d), merges._published(spark, d)).select(*merges.EXECUTION))
    return rows.withColumn("summary_hour", (F.col("summary_hour") / 1000).cast("bigint")).withColumnRenamed("summary_hour", "h")


def checks(spark: SparkSession, d: str) -> DataFrame:
    return reference.data_quality_daily(spark, d)


def anomalies(spark: SparkSession, d: str) -> DataFrame:
    """quality_events of the loads that stand out; an event's id is what it is about."""
    found = p5_found(spark, d)
    severity = F.when(F.col("finding").isin("null_share", "nonpositive_share"), quality.CRITICAL).otherwise(quality.WARN)
    key = F.concat_ws("/", "table_name", "column_name", "symbol", F.col("load_epoch").cast("string"), "finding")
    return found.select(key.alias("event_id"), (F.col("load_epoch") + 3600).alias("detected_at"), F.col("table_name").alias("source_table"), F.col("finding").alias("check_name"), severity.alias("severity"), F.concat_ws(".", "symbol", "column_name").alias("dimension"))


def lags(spark: SparkSession, d: str) -> DataFrame:
    """lag_samples of the typed trades: a run is a partition, a configuration an ingest day."""
    at = utc_timestamp(F.col("ingest_time"))
    rows = table(spark, d, "processed_trades").select(F.unix_millis(F.col("trade_time").cast("timestamp")).alias("produce_ts"), F.unix_millis(at).alias("commit_ts"), F.concat_ws("-", "source_topic", "source_partition").alias("run_id"), F.date_format(at, "yyyy-MM-dd").alias("config_label"))
    return rows.dropna(subset=["produce_ts", "commit_ts"]).withColumn("lag_ms", F.col("commit_ts") - F.col("produce_ts"))


def batches(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One row a partition and stamp of a raw log: task_name, stamp (s), messages, broken (without a value), bytes."""
    rows = table(spark, d, name).withColumn("stamp", F.unix_seconds(utc_timestamp(F.col("ingest_time")))).filter("stamp is not null and kafka_partition is not null")
    return rows.groupBy(F.concat(F.lit(f"{name}-"), F.col("kafka_partition").cast("string")).alias("task_name"), "stamp").agg(F.count("*").alias("messages"), F.count_if(F.col("message_value").isNull()).alias("broken"), F.sum(F.coalesce(F.octet_length("message_value"), F.lit(0))).cast("bigint").alias("bytes"))


RAW = ("raw_trades", "raw_klines")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """pipeline_run_summary of the micro-batches: a batch with a broken message failed, and took the time since the task's batch before."""
    rows = batches(spark, d, RAW[0]).unionAll(batches(spark, d, RAW[1]))
    since = F.col("stamp") - F.lag("stamp").over(Window.partitionBy("task_name").orderBy("stamp"))
    return rows.select(
        F.concat_ws("@", "task_name", F.col("stamp").cast("string")).alias("run_id"), F.lit("ingest").alias("pipeline_name"), "task_name", F.when(F.col("broken") > 0, "failed").otherwise("Success").alias("status"), F.coalesce(since, F.lit(0)).alias("duration_sec"),
        F.col("messages").alias("processed_rows"), F.substring_index("task_name", "-", 1).alias("target_table"), F.when(F.col("broken") > 0, F.concat(F.col("broken").cast("string"), F.lit(" without a value"))).alias("error_message"), F.col("stamp").alias("created_at"),
    )


def health(spark: SparkSession, d: str) -> DataFrame:
    """table_health_summary of the raw logs at each day's end, a micro-batch being one appended file: running totals of files, records and bytes; broken batches count as files with deletes."""
    out = None
    for name in RAW:
        day = batches(spark, d, name).groupBy((F.col("stamp") - F.pmod("stamp", F.lit(DAY)) + DAY).alias("checked_at")).agg(F.count("*").alias("f"), F.count_if(F.col("broken") > 0).alias("del"), F.sum("messages").alias("r"), F.sum("bytes").alias("b"), F.max("stamp").alias("last_committed_at"))
        upto = Window.orderBy("checked_at").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
        total = lambda c, upto=upto: F.sum(c).over(upto)
        part = day.select(
            F.lit(name).alias("table_name"), "checked_at", F.lit("append").alias("table_mode"), total("f").alias("data_file_count"), total("del").alias("position_delete_file_count"), F.lit(0).cast("bigint").alias("equality_delete_file_count"), F.round(total("del") / total("f") + OFF_TIES, 6).alias("delete_to_data_file_ratio"),
            F.round(total("b") / total("f") / 1048576 + OFF_TIES, 6).alias("avg_file_size_mb"), F.round(total("b") / 1048576 + OFF_TIES, 6).alias("total_size_mb"), total("r").alias("record_count"), F.count("*").over(upto).alias("manifest_count"), total("f").alias("snapshot_count"), "last_committed_at",
        )
        out = part if out is None else out.unionAll(part)
    return out


# shapes of panels


def last_days(df: DataFrame, time: str, days: int, by: str | None = None) -> DataFrame:
    """Rows of the last days before the latest one, of each series or of all."""
    if by:
        return df.withColumn("_m", F.max(time).over(Window.partitionBy(by))).filter(F.col(time) >= F.col("_m") - days * DAY).drop("_m")
    return df.crossJoin(F.broadcast(df.agg(F.max(time).alias("_m")))).filter(F.col(time) >= F.col("_m") - days * DAY).drop("_m")  # one row


def at_latest(df: DataFrame, time: str) -> DataFrame:
    return last_days(df, time, 0)


def series(df: DataFrame, time: str, *columns: str) -> DataFrame:
    return df.select(time, *columns).orderBy(time)


def latest_run(df: DataFrame) -> DataFrame:
    """Samples of the run with the last commit (of equals the greatest name)."""
    return df.join(F.broadcast(df.agg(F.max_by("run_id", F.struct("commit_ts", "run_id")).alias("run_id"))), "run_id")  # one row


def pct(share: float) -> Column:
    """A discrete percentile of the lags, in seconds."""
    return F.round(F.expr(f"percentile_disc({share}) within group (order by lag_ms)") / 1000.0, 3)


def rate() -> Column:
    return F.round(F.try_divide(F.count("*").cast("double"), ((F.max("commit_ts") - F.min("produce_ts")) / 1000.0).cast("double")) + OFF_TIES, 4)


def is_in(column: str, names: tuple[str, ...]) -> Column:
    return F.upper(column).isin(*names)


EXECUTION = ["total_orders", "filled_orders", "canceled_orders", "fill_rate", "cancel_rate", "avg_fill_delay_sec", "avg_order_qty", "avg_filled_qty", "total_order_qty", "total_filled_qty", "benchmark_vwap", "avg_buy_fill_price", "avg_sell_fill_price", "buy_slippage_bps", "sell_slippage_bps", "slippage_cost_quote"]
CHECK = ["checked_at", "table_name", "check_name", "check_status", "row_count", "null_count", "duplicate_count", "warning_message", "run_id"]
HEALTH = ["checked_at", "table_name", "table_mode", "data_file_count", "position_delete_file_count", "equality_delete_file_count", "delete_to_data_file_ratio", "avg_file_size_mb", "total_size_mb", "record_count", "manifest_count", "snapshot_count", "last_committed_at"]
RUN = ["created_at", "pipeline_name", "task_name", "status", "duration_sec", "processed_rows", "target_table", "error_message", "run_id"]
_m30 = lambda df: last_days(df, "h", 30, "symbol")
_top = lambda df, *order: df.orderBy(*order).limit(100)
_sum = lambda column: lambda df: at_latest(df, "checked_at").agg(F.sum(column).cast("bigint").alias(column))
_mean = lambda column: lambda df: at_latest(df, "checked_at").agg(F.round(F.avg(column) + OFF_TIES, 6).alias(column))
_newest = lambda df, by, columns: df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("checked_at").desc()))).filter("_rn = 1").select(*columns)
_week = lambda df: last_days(df, "detected_at", 7)
_by_symbol = lambda df, *figures: _m30(df).groupBy("symbol").agg(*figures)

#: Panel: the table it reads, how, and its SQL over the SQL views below.
PANELS: dict[str, tuple[str, Callable[[DataFrame], DataFrame], str]] = {
    **{f"panel_{n}": ("market", lambda df, cs=cs: series(_m30(df), "h", "symbol", *cs), f"select h, symbol, {', '.join(cs)} from market30") for n, cs in {"close_price": ["close_price"], "kline_volume": ["kline_volume"], "trade_count": ["trade_count"], "avg_trade_price": ["avg_trade_price"], "maker_taker": ["maker_trade_count", "taker_trade_count"], "vwap_vs_avg": ["vwap", "avg_trade_price"]}.items()},
    "panel_recent_market": ("market", lambda df: _top(_m30(df).select("h", "symbol", *MARKET), F.col("h").desc(), "symbol"), f"select h, symbol, {', '.join(MARKET)} from market30 order by h desc, symbol limit 100"),
    "panel_checked_tables": ("checks", lambda df: at_latest(df, "checked_at").agg(F.countDistinct("table_name").alias("checked_tables")), "select count(distinct table_name) checked_tables from checks where checked_at = (select max(checked_at) from checks)"),
    **{f"panel_checked_{n}": ("checks", _sum(c), f"select cast(sum({c}) as bigint) {c} from checks where checked_at = (select max(checked_at) from checks)") for n, c in {"rows": "row_count", "nulls": "null_count", "duplicates": "duplicate_count"}.items()},
    "panel_row_count_by_table": ("checks", lambda df: last_days(df, "checked_at", 30).select("checked_at", "table_name", "row_count").orderBy("checked_at", "table_name"), "select checked_at, table_name, row_count from checks where checked_at >= (select max(checked_at) from checks) - 2592000"),
    "panel_null_duplicate_trend": ("checks", lambda df: last_days(df, "checked_at", 30).groupBy("checked_at").agg(F.sum("null_count").alias("null_count"), F.sum("duplicate_count").alias("duplicate_count")).orderBy("checked_at"), "select checked_at, cast(sum(null_count) as bigint) null_count, cast(sum(duplicate_count) as bigint) duplicate_count from checks where checked_at >= (select max(checked_at) from checks) - 2592000 group by 1"),
    "panel_latest_check": ("checks", lambda df: _newest(df, ["table_name", "check_name"], CHECK), f"select {', '.join(CHECK)} from checks qualify row_number() over (partition by table_name, check_name order by checked_at desc) = 1"),
    **{f"panel_{n}": ("health", _sum(c), f"select cast(sum({c}) as bigint) {c} from health where checked_at = (select max(checked_at) from health)") for n, c in {"data_files": "data_file_count", "position_deletes": "position_delete_file_count", "snapshots": "snapshot_count", "manifests": "manifest_count", "records": "record_count"}.items()},
    **{f"panel_{n}": ("health", _mean(c), f"select round(avg({c}) + 1e-9, 6) {c} from health where checked_at = (select max(checked_at) from health)") for n, c in {"delete_ratio": "delete_to_data_file_ratio", "file_mb": "avg_file_size_mb"}.items()},
    "panel_total_mb": ("health", lambda df: at_latest(df, "checked_at").agg(F.round(F.sum("total_size_mb") + OFF_TIES, 6).alias("total_size_mb")), "select round(sum(total_size_mb) + 1e-9, 6) total_size_mb from health where checked_at = (select max(checked_at) from health)"),
    "panel_file_trend": ("health", lambda df: last_days(df, "checked_at", 30).select("checked_at", "table_name", "data_file_count", "position_delete_file_count", "equality_delete_file_count").orderBy("checked_at", "table_name"), "select checked_at, table_name, data_file_count, position_delete_file_count, equality_delete_file_count from health where checked_at >= (select max(checked_at) from health) - 2592000"),
    "panel_snapshot_trend": ("health", lambda df: last_days(df, "checked_at", 30).select("checked_at", "table_name", "snapshot_count", "manifest_count").orderBy("checked_at", "table_name"), "select checked_at, table_name, snapshot_count, manifest_count from health where checked_at >= (select max(checked_at) from health) - 2592000"),
    "panel_latest_health": ("health", lambda df: _newest(df, ["table_name"], HEALTH), f"select {', '.join(HEALTH)} from health qualify row_number() over (partition by table_name order by checked_at desc) = 1"),
    **{f"panel_{n}": ("execution", lambda df, c=c: _by_symbol(df, F.round(F.avg(c) * 100 + OFF_TIES, 4).alias("v")), f"select symbol, round(avg({c}) * 100 + 1e-9, 4) v from execution30 group by 1") for n, c in {"fill_rate": "fill_rate", "cancel_rate": "cancel_rate"}.items()},
    "panel_total_orders": ("execution", lambda df: _by_symbol(df, F.sum("total_orders").alias("total_orders")), "select symbol, cast(sum(total_orders) as bigint) total_orders from execution30 group by 1"),
    "panel_fill_delay": ("execution", lambda df: _by_symbol(df, F.round(F.avg("avg_fill_delay_sec") + OFF_TIES, 4).alias("v")), "select symbol, round(avg(avg_fill_delay_sec) + 1e-9, 4) v from execution30 group by 1"),
    "panel_rate_trend": ("execution", lambda df: series(_m30(df).withColumns({"fill_rate_pct": F.round(F.col("fill_rate") * 100, 4), "cancel_rate_pct": F.round(F.col("cancel_rate") * 100, 4)}), "h", "symbol", "fill_rate_pct", "cancel_rate_pct"), "select h, symbol, round(fill_rate * 100, 4) fill_rate_pct, round(cancel_rate * 100, 4) cancel_rate_pct from execution30"),
    "panel_hourly_orders": ("execution", lambda df: series(_m30(df), "h", "symbol", "total_orders", "filled_orders", "canceled_orders"), "select h, symbol, total_orders, filled_orders, canceled_orders from execution30"),
    "panel_qty_trend": ("execution", lambda df: series(_m30(df), "h", "symbol", "total_order_qty", "total_filled_qty"), "select h, symbol, total_order_qty, total_filled_qty from execution30"),
    "panel_recent_execution": ("execution", lambda df: _top(_m30(df).select("h", "symbol", *EXECUTION), F.col("h").desc(), "symbol"), f"select h, symbol, {', '.join(EXECUTION)} from execution30 order by h desc, symbol limit 100"),
    "panel_slippage_bps": ("execution", lambda df: series(_m30(df), "h", "symbol", "buy_slippage_bps", "sell_slippage_bps"), "select h, symbol, buy_slippage_bps, sell_slippage_bps from execution30"),
    "panel_slippage_cost": ("execution", lambda df: series(_m30(df), "h", "symbol", "slippage_cost_quote"), "select h, symbol, slippage_cost_quote from execution30"),
    "panel_tasks_succeeded": ("runs", lambda df: last_days(df, "created_at", 30).agg(F.count_if(is_in("status", SUCCEEDED)).alias("succeeded")), "select count(*) filter (ok) succeeded from runs30"),
    "panel_tasks_failed": ("runs", lambda df: last_days(df, "created_at", 30).agg(F.count_if(is_in("status", FAILED)).alias("failed")), "select count(*) filter (not ok) failed from runs30"),
    "panel_success_rate": ("runs", lambda df: last_days(df, "created_at", 30).agg(F.round(F.count_if(is_in("status", SUCCEEDED)) / F.count("*") * 100 + OFF_TIES, 6).alias("success_rate")), "select round(count(*) filter (ok) / count(*)::double * 100 + 1e-9, 6) success_rate from runs30"),
    "panel_task_duration": ("runs", lambda df: last_days(df, "created_at", 30).agg(F.round(F.avg("duration_sec") + OFF_TIES, 6).alias("avg_duration")), "select round(avg(duration_sec) + 1e-9, 6) avg_duration from runs30"),
    "panel_outcomes": ("runs", lambda df: last_days(df, "created_at", 30).groupBy("created_at").agg(F.count_if(is_in("status", SUCCEEDED)).alias("succeeded"), F.count_if(is_in("status", FAILED)).alias("failed")).orderBy("created_at"), "select created_at, count(*) filter (ok) succeeded, count(*) filter (not ok) failed from runs30 group by 1"),
    "panel_duration_by_task": ("runs", lambda df: last_days(df, "created_at", 30).select("created_at", "task_name", "duration_sec").orderBy("created_at", "task_name"), "select created_at, task_name, duration_sec from runs30"),
    "panel_recent_runs": ("runs", lambda df: _top(df.select(*RUN), F.col("created_at").desc(), F.col("task_name")), f"select {', '.join(RUN)} from runs order by created_at desc, task_name limit 100"),
    **{f"panel_{s.lower()}_7d": ("anomalies", lambda df, s=s: _week(df).agg(F.count_if(F.col("severity") == s).alias("n")), f"select count(*) filter (severity = '{s}') n from anomalies7") for s in ("CRITICAL", "WARN")},
    **{f"panel_{n}_7d": ("anomalies", lambda df, c=c: _week(df).agg(F.countDistinct(c).alias("n")), f"select count(distinct {c}) n from anomalies7") for n, c in {"checks": "check_name", "tables": "source_table"}.items()},
    "panel_anomalies_by_check": ("anomalies", lambda df: _week(df).groupBy("check_name", "severity").agg(F.count("*").alias("n")), "select check_name, severity, count(*) n from anomalies7 group by 1, 2"),
    "panel_severity_trend": ("anomalies", lambda df: _week(df).groupBy("detected_at").agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "WARN").alias("warn")).orderBy("detected_at"), "select detected_at, count(*) filter (severity = 'CRITICAL') critical, count(*) filter (severity = 'WARN') warn from anomalies7 group by 1"),
    "panel_recent_anomalies": ("anomalies", lambda df: _top(df, F.col("detected_at").desc(), "event_id"), "select * from anomalies order by detected_at desc, event_id limit 100"),
    **{f"panel_lag_p{int(q * 100)}": ("lags", lambda df, q=q: latest_run(df).agg(pct(q).alias("v")), f"select round(quantile_disc(lag_ms, {q}) / 1000.0, 3) v from lags_run") for q in (0.5, 0.95, 0.99)},
    "panel_lag_throughput": ("lags", lambda df: latest_run(df).agg(rate().alias("v")), "select round(count(*) / nullif((max(commit_ts) - min(produce_ts)) / 1000.0, 0) + 1e-9, 4) v from lags_run"),
    "panel_lag_by_second": ("lags", lambda df: latest_run(df).groupBy(F.expr("commit_ts div 1000").alias("second")).agg(*[pct(q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]).orderBy("second"), "select commit_ts // 1000 as second, " + ", ".join(f"round(quantile_disc(lag_ms, {q}) / 1000.0, 3) p{int(q * 100)}" for q in (0.5, 0.95, 0.99)) + " from lags_run group by 1"),
    "panel_lag_ablation": ("lags", lambda df: df.groupBy("config_label").agg(F.count("*").alias("samples"), *[pct(q).alias(f"p{int(q * 100)}_s") for q in (0.5, 0.95, 0.99)], F.round(F.max("lag_ms") / 1000.0, 3).alias("max_s"), rate().alias("throughput_per_s")).orderBy("p95_s"), "select config_label, count(*) samples, " + ", ".join(f"round(quantile_disc(lag_ms, {q}) / 1000.0, 3) p{int(q * 100)}_s" for q in (0.5, 0.95, 0.99)) + ", round(max(lag_ms) / 1000.0, 3) max_s, round(count(*) / nullif((max(commit_ts) - min(produce_ts)) / 1000.0, 0) + 1e-9, 4) throughput_per_s from lags group by 1"),
    "alert_critical": ("anomalies", lambda df: last_days(df, "detected_at", 1).agg(F.count_if(F.col("severity") == "CRITICAL").alias("n")), "select count(*) filter (severity = 'CRITICAL') n from anomalies where detected_at >= (select max(detected_at) from anomalies) - 86400"),
    "alert_slippage": ("execution", lambda df: last_days(df, "h", 1).agg(F.max(F.greatest(F.abs("buy_slippage_bps"), F.abs("sell_slippage_bps"))).alias("v")), "select max(greatest(abs(buy_slippage_bps), abs(sell_slippage_bps))) v from execution where h >= (select max(h) from execution) - 86400"),
    "alert_failed_task": ("runs", lambda df: last_days(df, "created_at", 1).agg(F.count_if(is_in("status", FAILED)).alias("n")), "select count(*) filter (not ok) n from runs where created_at >= (select max(created_at) from runs) - 86400"),
}

TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"market": market, "execution": execution, "checks": checks, "anomalies": anomalies, "lags": lags, "runs": runs, "health": health}

_BATCHES = " union all ".join(f"select '{n}-' || kafka_partition task_name, '{n}' tab, cast(floor(epoch({_ingest()})) as bigint) stamp, count(*) messages, count(*) filter (message_value is null) broken, cast(sum(coalesce(strlen(message_value), 0)) as bigint) bytes from {n} where {_ingest()} is not null and kafka_partition is not null group by 1, 2, 3" for n in RAW)
_MARKET_KINDS = ", ".join(f"cast({c} as double) {c}" if c not in ("kline_number_of_trades", "trade_count", "maker_trade_count", "taker_trade_count") else c for c in MARKET)
_EXECUTION_SQL = f"with {reference._ORDERS}, {merges._PUBLISHED}, all_hours as ({merges._HOURS_OF('orders_once')}) {merges._BESIDE.format(hours='all_hours')}"
_RUNNING = lambda c: f"sum({c}) over (partition by tab order by checked_at)"

#: SQL views, each by those it needs.
VIEWS: dict[str, str] = {
    "market": f"select symbol, cast(floor(epoch(summary_hour)) as bigint) h, {_MARKET_KINDS} from (select *, row_number() over (partition by symbol, summary_hour order by updated_at desc nulls last, trade_count desc nulls last) rn from market_hourly_summary where symbol is not null and summary_hour is not null) where rn = 1",
    "market30": "select * exclude (mx) from (select *, max(h) over (partition by symbol) mx from market) where h >= mx - 2592000",
    "execution": f"select * exclude (summary_hour), summary_hour // 1000 h from ({_EXECUTION_SQL})",
    "execution30": "select * exclude (mx) from (select *, max(h) over (partition by symbol) mx from execution) where h >= mx - 2592000",
    "checks": reference.ORACLES["data_quality_daily"],
    "anomalies": f"select table_name || '/' || column_name || '/' || symbol || '/' || load_epoch || '/' || finding event_id, load_epoch + 3600 detected_at, table_name source_table, finding check_name, case when finding in ('null_share', 'nonpositive_share') then 'CRITICAL' else 'WARN' end severity, symbol || '.' || column_name dimension from ({PROBLEM_SQL['p5_found']})",
    "anomalies7": "select * from anomalies where detected_at >= (select max(detected_at) from anomalies) - 604800",
    "lags": f"select *, commit_ts - produce_ts lag_ms from (select epoch_ms(trade_time) produce_ts, epoch_ms({_ingest()}) commit_ts, concat_ws('-', source_topic, source_partition) run_id, strftime({_ingest()}, '%Y-%m-%d') config_label from processed_trades) where produce_ts is not null and commit_ts is not null",
    "lags_run": "select * from lags where run_id = (select run_id from lags order by commit_ts desc, run_id desc limit 1)",
    "batch_log": _BATCHES,
    "runs": "select task_name || '@' || stamp run_id, 'ingest' pipeline_name, task_name, case when broken > 0 then 'failed' else 'Success' end status, broken = 0 ok, coalesce(stamp - lag(stamp) over (partition by task_name order by stamp), 0) duration_sec, messages processed_rows, tab target_table, case when broken > 0 then broken || ' without a value' end error_message, stamp created_at from batch_log",
    "runs30": "select * from runs where created_at >= (select max(created_at) from runs) - 2592000",
    "day_log": "select tab, stamp - stamp % 86400 + 86400 checked_at, count(*) f, count(*) filter (broken > 0) del, sum(messages) r, sum(bytes) b, max(stamp) last_committed_at from batch_log group by 1, 2",
    "health": f"select tab table_name, checked_at, 'append' table_mode, cast({_RUNNING('f')} as bigint) data_file_count, cast({_RUNNING('del')} as bigint) position_delete_file_count, 0 equality_delete_file_count, round({_RUNNING('del')}::double / {_RUNNING('f')} + 1e-9, 6) delete_to_data_file_ratio, round({_RUNNING('b')}::double / {_RUNNING('f')} / 1048576 + 1e-9, 6) avg_file_size_mb, round({_RUNNING('b')}::double / 1048576 + 1e-9, 6) total_size_mb, cast({_RUNNING('r')} as bigint) record_count, count(*) over (partition by tab order by checked_at) manifest_count, cast({_RUNNING('f')} as bigint) snapshot_count, last_committed_at from day_log",
}
NEEDS = {"market30": ["market"], "execution30": ["execution"], "anomalies7": ["anomalies"], "lags_run": ["lags"], "runs": ["batch_log"], "runs30": ["batch_log", "runs"], "day_log": ["batch_log"], "health": ["batch_log", "day_log"]}


def panel(name: str, symbol: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A panel as a query; with a symbol only of this one, where the panel's table knows symbols."""
    source, build, _ = PANELS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = TABLES[source](spark, d)
        return build(rows.filter(F.col("symbol") == symbol) if symbol and "symbol" in rows.columns else rows)

    run.__name__ = name
    run.__doc__ = f"Dashboard query {name}."
    return run


def text(name: str) -> str:
    """The SQL of a panel with the views it reads."""
    body = PANELS[name][2]
    wanted = [v for v in VIEWS if re.search(rf"\b(?:from|join) {v}\b", body)]
    wanted = sorted({x for v in wanted for x in [*NEEDS.get(v, []), v]}, key=list(VIEWS).index)
    return ("with " + ", ".join(f"{v} as ({VIEWS[v]})" for v in wanted) + " " if wanted else "") + body


def queries() -> dict:
    return {name: panel(name) for name in PANELS}


def oracle_sql() -> dict[str, str]:
    return {name: text(name) for name in PANELS}
