"""The tables: columns, key, partition column, how they are written and when a merge may overwrite a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _fields(spec: str) -> T.StructType:
    """A StructType from 'name type, name type'; d20, d24, d30 stand for decimals of scale 8."""
    short = {"d20": "decimal(20,8)", "d24": "decimal(24,8)", "d30": "decimal(30,8)"}
    out = T.StructType()
    for part in spec.split(","):
        name, kind = part.split()
        out.add(name, T._parse_datatype_string(short.get(kind, kind).replace(";", ",")))
    return out


@dataclass(frozen=True)
class TableSpec:
    """mode: append, or upsert on key; guard: a column that must not fall when a row is overwritten; days: the column whose date partitions the table."""

    columns: str
    key: tuple[str, ...] = ()
    mode: str = "append"
    guard: str | None = None
    days: str | None = None

    @property
    def schema(self) -> T.StructType:
        return _fields(self.columns)


ENVELOPE = "kafka_topic string, kafka_partition int, kafka_offset bigint, kafka_timestamp bigint, message_key string, message_value string, ingest_time string"
SOURCE = "source_topic string, source_partition int, source_offset bigint, ingest_time string"
BARS = f"symbol string, interval string, open_time timestamp, close_time timestamp, open d20, high d20, low d20, close d20, volume d20, quote_volume d24, number_of_trades bigint, is_closed boolean, {SOURCE}, updated_at timestamp"
ORDER = "order_id string, client_id string, symbol string, side string, order_type string, order_price d20, order_qty d20, filled_qty d20, avg_fill_price d20, event_type string, order_status string"

TABLES = {
    "raw_trades": TableSpec(ENVELOPE, days="ingest_date"),
    "raw_klines": TableSpec(ENVELOPE, days="ingest_date"),
    "raw_orders": TableSpec(ENVELOPE, days="ingest_date"),
    "processed_trades": TableSpec(f"trade_id bigint, symbol string, price d20, qty d20, quote_qty d20, trade_time timestamp, is_buyer_maker boolean, is_best_match boolean, {SOURCE}", ("symbol", "trade_id"), days="trade_time"),
    "staging_klines": TableSpec(BARS, ("symbol", "interval", "open_time"), "upsert", days="open_time"),
    "processed_klines": TableSpec(BARS, ("symbol", "interval", "open_time"), "upsert", "source_offset", "open_time"),
    "staging_orders": TableSpec(f"{ORDER}, event_time timestamp, simulated_parameters string, {SOURCE}, updated_at timestamp", ("order_id", "order_status", "event_time"), "upsert", days="event_time"),
    "processed_orders": TableSpec(f"{ORDER}, created_at timestamp, updated_at timestamp, filled_at timestamp, canceled_at timestamp, simulated_parameters string, {SOURCE}", ("order_id",), "upsert", "updated_at"),
    "market_hourly_summary": TableSpec(
        "summary_hour timestamp, symbol string, open_price d20, high_price d20, low_price d20, close_price d20, kline_volume d30, kline_quote_volume d30, kline_number_of_trades bigint, trade_count bigint, trade_qty d30, trade_quote_qty d30, avg_trade_price d20, vwap d20, maker_trade_count bigint, taker_trade_count bigint, updated_at timestamp",
        ("symbol", "summary_hour"), "upsert", days="summary_hour",
    ),
    "order_execution_summary": TableSpec(
        "summary_hour timestamp, symbol string, total_orders bigint, filled_orders bigint, canceled_orders bigint, fill_rate double, cancel_rate double, avg_fill_delay_sec double, avg_order_qty d20, avg_filled_qty d20, total_order_qty d30, total_filled_qty d30, benchmark_vwap d20, avg_buy_fill_price d20, avg_sell_fill_price d20, buy_slippage_bps double, sell_slippage_bps double, slippage_cost_quote d30, updated_at timestamp",
        ("symbol", "summary_hour"), "upsert", days="summary_hour",
    ),
    "data_quality_summary": TableSpec("run_id string, checked_at timestamp, table_name string, check_name string, check_status string, row_count bigint, null_count bigint, duplicate_count bigint, warning_message string", days="checked_at"),
    "pipeline_run_summary": TableSpec("run_id string, pipeline_name string, task_name string, status string, started_at timestamp, ended_at timestamp, duration_sec bigint, source_table string, target_table string, processed_rows bigint, error_message string, created_at timestamp", days="created_at"),
    "table_health_summary": TableSpec("run_id string, checked_at timestamp, table_name string, table_mode string, data_file_count bigint, position_delete_file_count bigint, equality_delete_file_count bigint, delete_to_data_file_ratio double, avg_file_size_mb double, total_size_mb double, record_count bigint, manifest_count bigint, snapshot_count bigint, last_committed_at timestamp", days="checked_at"),
    "quality_events": TableSpec("event_id string, detected_at timestamp, run_id string, source_table string, check_name string, severity string, dimension string, observed double, threshold double, detail string", days="detected_at"),
    "lag_samples": TableSpec("produce_ts bigint, commit_ts bigint, lag_ms bigint, config_label string, run_id string, batch_id bigint"),
}
