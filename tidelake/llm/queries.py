"""The queries of the llm problems over the test tables, and SQL for those that SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.parsing import symbol_letters
from tidelake.llm import leaks, nearest_time, packing, personal
from tidelake.session import scratch, table

#: Tolerances of a fill's neighbours: 2 seconds to a trade, 20 seconds to a 1m bar.
TRADE_US, BAR_US = 2_000_000, 20_000_000


def p7_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Each filled order with its nearest trade and bar within tolerance, and the distance."""
    orders = table(spark, d, "processed_orders").filter("filled_at is not null and order_id is not null")
    fills = orders.groupBy("order_id").agg(F.max_by(F.struct("symbol", "filled_at"), F.struct("updated_at", "filled_at", "symbol")).alias("o")).select("order_id", symbol_letters(F.col("o.symbol")).alias("symbol"), F.col("o.filled_at").alias("filled_at"), F.explode(F.array(F.lit("processed_trades"), F.lit("processed_klines"))).alias("side"))
    trades = table(spark, d, "processed_trades").select(F.lit("processed_trades").alias("side"), symbol_letters(F.col("symbol")).alias("symbol"), F.col("trade_time").alias("at"), F.col("trade_id").alias("key"))
    bars = table(spark, d, "processed_klines").filter("interval = '1m'").select(F.lit("processed_klines").alias("side"), symbol_letters(F.col("symbol")).alias("symbol"), F.col("open_time").alias("at"), F.unix_millis(F.col("open_time").cast("timestamp")).alias("key"))
    near = nearest_time.nearest(
        fills, trades.unionByName(bars),
        left_entity=[F.col("side"), F.col("symbol")], left_time=F.col("filled_at"), left_id=F.col("order_id"),
        right_entity=[F.col("side"), F.col("symbol")], right_time=F.col("at"), right_key=F.col("key"),
        tolerance_us=F.when(F.col("side") == "processed_trades", F.lit(TRADE_US)).otherwise(F.lit(BAR_US)),
    )
    return near.select(F.col("id").alias("order_id"), F.col("e0").alias("matched_table"), F.col("key").alias("matched_key"), "distance_us")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Each filled order with its nearest trade and bar within tolerance."""
    return p7_nearest(spark, d).select("order_id", "matched_table", "matched_key")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of a text over 2,048 tokens, with its container."""
    lengths = packing.token_lengths(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(spark, lengths, scratch(spark, "token-lengths")).withColumnRenamed("key", "doc_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evaluation passage, the item, and how many of its words."""
    found = leaks.find(spark, table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage", scratch(spark, "term-index"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "words", "length")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evaluation passage, and the item."""
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of personal information."""
    return personal.occurrences(table(spark, d, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), F.col("kind").alias("pii_type"), F.col("start").alias("start_pos"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """documents with typed placeholders in the text."""
    return personal.redact(table(spark, d, "documents"), "text")


def queries() -> dict:
    return {f.__name__: f for f in (p7_found, p7_nearest, p8_containers, p9_found, p9_leaks, p10_found, p10_redacted)}


#: TESTDATA.md: symbols are equal when their letters are, ignoring case.
_LETTERS = "nullif(upper(regexp_replace(symbol, '[^\\p{L}]', '', 'g')), '')"


def oracle_sql() -> dict[str, str]:
    nearest = f"""with fills as (select order_id, arg_max({_LETTERS}, updated_at) symbol, arg_max(epoch_us(filled_at), updated_at) t from processed_orders where filled_at is not null and order_id is not null group by 1),
  cand as (select 'processed_trades' matched_table, {TRADE_US} tol, {_LETTERS} symbol, epoch_us(trade_time) t, trade_id k from processed_trades where trade_time is not null
    union all select 'processed_klines', {BAR_US}, {_LETTERS}, epoch_us(open_time), epoch_ms(open_time) from processed_klines where "interval" = '1m' and open_time is not null),
  pairs as (select f.order_id, c.matched_table, c.k matched_key, abs(c.t - f.t) distance_us, row_number() over (partition by f.order_id, c.matched_table order by abs(c.t - f.t), c.t, c.k) rn
    from fills f join cand c on f.symbol = c.symbol and c.t between f.t - c.tol and f.t + c.tol)"""
    return {
        "p7_found": f"{nearest} select order_id, matched_table, matched_key from pairs where rn = 1",
        "p7_nearest": f"{nearest} select order_id, matched_table, matched_key, distance_us from pairs where rn = 1",
    }
