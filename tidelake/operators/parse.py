"""Typed rows from message envelopes. Fields that can't be read are null, messages without their key are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.parsing import json_fields, symbol_key, utc_timestamp


def envelope(stream: DataFrame) -> DataFrame:
    """Kafka's columns as the raw log keeps them, with ingest date and time. Works on batches and streams."""
    return stream.select(
        F.col("topic").cast("string").alias("kafka_topic"), F.col("partition").cast("int").alias("kafka_partition"), F.col("offset").cast("bigint").alias("kafka_offset"),
        F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("kafka_timestamp"), F.col("key").cast("string").alias("message_key"), F.col("value").cast("string").alias("message_value"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd").alias("ingest_date"), F.current_timestamp().cast("string").alias("ingest_time"),
    )


def _source(raw: DataFrame) -> list[Column]:
    return [F.col("kafka_topic").alias("source_topic"), F.col("kafka_partition").alias("source_partition"), F.col("kafka_offset").alias("source_offset"), F.col("ingest_time")]


def _field(name: str) -> Column:
    return F.nullif(F.trim(F.col(f"_v.{name}")), F.lit(""))


def _bool(text: Column) -> Column:
    return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)


def trades(raw: DataFrame) -> DataFrame:
    """processed_trades rows of raw_trades. The symbol is the payload's, else the message key, in upper case."""
    rows = raw.withColumn("_v", json_fields(F.col("message_value"), ["trade_id", "symbol", "price", "qty", "quote_qty", "time", "is_buyer_maker", "is_best_match"]))
    return rows.select(
        _field("trade_id").try_cast("bigint").alias("trade_id"), F.coalesce(symbol_key(_field("symbol")), symbol_key(F.col("message_key"))).alias("symbol"),
        *[_field(c).try_cast("decimal(20,8)").alias(c) for c in ("price", "qty", "quote_qty")],
        F.timestamp_millis(_field("time").try_cast("bigint")).alias("trade_time"), _bool(_field("is_buyer_maker")).alias("is_buyer_maker"), _bool(_field("is_best_match")).alias("is_best_match"),
        *_source(raw),
    ).filter("trade_id is not null and symbol is not null")


def orders(raw: DataFrame) -> DataFrame:
    """staging_orders rows of raw_orders; simulated_parameters stays JSON text."""
    rows = raw.withColumn("_v", json_fields(F.col("message_value"), ["order_id", "client_id", "symbol", "side", "order_type", "order_price", "order_qty", "filled_qty", "avg_fill_price", "event_type", "order_status", "event_time", "simulated_parameters"]))
    return rows.select(
        *[_field(c).alias(c) for c in ("order_id", "client_id", "symbol", "side", "order_type")],
        *[_field(c).try_cast("decimal(20,8)").alias(c) for c in ("order_price", "order_qty", "filled_qty", "avg_fill_price")],
        *[_field(c).alias(c) for c in ("event_type", "order_status")],
        F.timestamp_millis(_field("event_time").try_cast("bigint")).alias("event_time"), F.col("_v.simulated_parameters").alias("simulated_parameters"),
        *_source(raw), utc_timestamp(F.col("ingest_time")).alias("updated_at"),
    ).filter("order_id is not null and order_status is not null and event_time is not null")


def exchange_frames(frames: DataFrame, column: str = "value") -> DataFrame:
    """message_key and message_value of exchange frames, wrapped or bare: aggTrade and kline events; all else gives no row."""
    v = F.try_parse_json(F.col(column))
    rows = frames.withColumn("_f", v).withColumn("_v", F.coalesce(F.try_variant_get("_f", "$.data", "variant"), F.col("_f")))
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    token = lambda c: F.initcap(c)  # noqa: E731  True and False, as the file producers write them
    trade = F.to_json(F.struct(
        get("$.a").alias("trade_id"), get("$.p").alias("price"), get("$.q").alias("qty"), (get("$.p").try_cast("double") * get("$.q").try_cast("double")).cast("string").alias("quote_qty"),
        get("$.T").alias("time"), token(get("$.m")).alias("is_buyer_maker"), token(get("$.M")).alias("is_best_match"), get("$.s").alias("symbol"),
        F.lit("aggTrade").alias("event_type"), get("$.E", "bigint").alias("exchange_event_time"), F.lit("websocket").alias("source"),
    ))
    bar = F.to_json(F.struct(
        *[get(f"$.k.{a}").alias(n) for a, n in (("t", "open_time"), ("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"), ("T", "close_time"), ("q", "quote_volume"), ("n", "number_of_trades"), ("V", "taker_buy_base_volume"), ("Q", "taker_buy_quote_volume"), ("B", "ignore"), ("s", "symbol"), ("i", "interval"))],
        get("$.k.x", "boolean").alias("is_closed"), F.lit("kline").alias("event_type"), get("$.E", "bigint").alias("exchange_event_time"), F.lit("websocket").alias("source"),
    ))
    kind = get("$.e")
    return rows.filter(kind.isin("aggTrade", "kline")).select(
        F.when(kind == "aggTrade", get("$.s")).otherwise(F.concat_ws("_", get("$.k.s"), get("$.k.i"))).alias("message_key"),
        F.when(kind == "aggTrade", trade).otherwise(bar).alias("message_value"),
    )
