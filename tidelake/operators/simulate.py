"""A synthetic feed of order events, for loads and tests: every event a function of its number and a seed.

No state and no sequence of draws: an order's values come from hashes of its number, so any task makes any order, a
lost task makes the same again, and a feed of any length is one narrow plan. What is drawn from (rates, spans, spreads)
are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.sample import uniform, weighted_draws


@dataclass(frozen=True)
class Feed:
    """Parameters of a feed; times in milliseconds, shares from 0 to 1."""

    seed: int = 1
    clients: int = 50
    prefix: str = "S"
    spread: float = 0.003
    least_qty: float = 0.001
    most_qty: float = 0.08
    partial_share: float = 0.45
    cancel_share: float = 0.25
    least_part: float = 0.2
    most_part: float = 0.8
    partial_ms: tuple[int, int] = (100, 3000)
    final_ms: tuple[int, int] = (3000, 15000)
    most_pause_ms: int = 0


def between(low: float, high: float, *parts, seed: int) -> Column:
    """A number in [low, high) from the values of parts."""
    return F.lit(float(low)) + uniform(*parts, seed=seed) * float(high - low)


def whole(low: int, high: int, *parts, seed: int) -> Column:
    """A whole number from low to high, both included."""
    return F.lit(int(low)).cast("bigint") + F.least(F.floor(uniform(*parts, seed=seed) * (high - low + 1)), F.lit(high - low)).cast("bigint")


def in_window(spark: SparkSession, n: int, start_ms: int, end_ms: int, feed: Feed, price: float) -> DataFrame:
    """no, base_ms, reference: n orders spread evenly over a window, ending early enough for their last events. Too short a window is refused."""
    if end_ms - start_ms <= feed.final_ms[1]:
        raise ValueError("the window is shorter than an order's life")
    return spark.range(n).select(F.col("id").alias("no"), whole(start_ms, end_ms - feed.final_ms[1] - 1, "id", F.lit("base"), seed=feed.seed).alias("base_ms"), F.lit(float(price)).alias("reference"), F.lit(None).cast("double").alias("ratio"))


def anchored(anchors: DataFrame, n: int, feed: Feed) -> DataFrame:
    """no, base_ms, reference, ratio: n orders within the minutes of an anchor (open_time_ms, close, volume), more where the volume is high.

    reference is the minute's close, ratio its volume against the mean."""
    rows = anchors.filter("close > 0 and volume > 0")
    draws = weighted_draws(rows, "open_time_ms", "volume", n, feed.seed)
    mean = rows.agg(F.avg("volume").alias("_mean"))  # one row
    return draws.join(rows.crossJoin(F.broadcast(mean)).select("open_time_ms", "close", (F.col("volume") / F.col("_mean")).alias("ratio")), draws["key"] == F.col("open_time_ms")).select(
        F.col("draw").alias("no"), (F.col("open_time_ms") + F.floor(F.col("within") * 60_000)).cast("bigint").alias("base_ms"), F.col("close").alias("reference"), "ratio"
    )


def linked(share: float, ratio: Column, rising: bool) -> Column:
    """A share that rises (or falls) with a ratio, kept between 0 and 1 (falling with nothing: 1); a null ratio leaves it as it is."""
    moved = F.lit(share) * ratio if rising else F.coalesce(F.try_divide(F.lit(share), ratio), F.lit(1.0))
    return F.when(ratio.isNull(), F.lit(float(share))).otherwise(F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0)))


def events(orders: DataFrame, symbol: str, feed: Feed = Feed()) -> DataFrame:
    """The change feed of orders (no, base_ms, reference, ratio): new, perhaps partly filled, then filled or canceled.

    A partly filled order that is canceled keeps what was filled. simulated_parameters tells what an order was made from."""
    u = lambda label: uniform("no", F.lit(label), seed=feed.seed)
    fixed = lambda c: F.format_string("%.8f", c).cast("decimal(20,8)")
    o = orders.select(
        F.concat(F.lit(f"O{feed.prefix}"), F.lpad(F.col("no").cast("string"), 8, "0")).alias("order_id"), F.concat(F.lit("C"), whole(1, feed.clients, "no", F.lit("client"), seed=feed.seed).cast("string")).alias("client_id"),
        F.lit(symbol.strip().upper()).alias("symbol"), F.when(u("side") < 0.5, "BUY").otherwise("SELL").alias("side"), F.lit("LIMIT").alias("order_type"),
        fixed(F.col("reference") * between(1 - feed.spread, 1 + feed.spread, "no", F.lit("price"), seed=feed.seed)).alias("order_price"), between(feed.least_qty, feed.most_qty, "no", F.lit("qty"), seed=feed.seed).alias("_qty"),
        (u("partial") < linked(feed.partial_share, F.col("ratio"), True)).alias("_partial"), (u("cancel") < linked(feed.cancel_share, F.col("ratio"), False)).alias("_cancel"), between(feed.least_part, feed.most_part, "no", F.lit("part"), seed=feed.seed).alias("_part"),
        F.col("base_ms"), whole(*feed.partial_ms, "no", F.lit("partial_ms"), seed=feed.seed).alias("_partial_ms"), whole(*feed.final_ms, "no", F.lit("final_ms"), seed=feed.seed).alias("_final_ms"), "reference", "ratio", "no",
    )
    qty, part = fixed(F.col("_qty")), fixed(F.col("_qty") * F.col("_part"))
    none = F.lit(None).cast("decimal(20,8)")
    zero = F.lit(0).cast("decimal(20,8)")
    done = F.when(~F.col("_cancel"), qty).when(F.col("_partial"), part).otherwise(zero)
    step = lambda status, ms, filled: F.struct(F.lit(status).alias("order_status") if isinstance(status, str) else status.alias("order_status"), (F.col("base_ms") + ms).cast("bigint").alias("ms"), filled.alias("filled_qty"))
    life = F.array_compact(F.array(
        step("NEW", F.lit(0), zero), F.when(F.col("_partial"), step("PARTIALLY_FILLED", F.col("_partial_ms"), part)),
        step(F.when(F.col("_cancel"), "CANCELED").otherwise("FILLED"), F.col("_final_ms"), done),
    ))
    made = F.to_json(F.struct(F.lit(feed.seed).alias("seed"), F.col("reference").alias("reference_price"), F.col("ratio").alias("volume_ratio"), F.array(F.lit(feed.partial_share), F.lit(feed.cancel_share)).alias("shares")))
    rows = o.withColumn("simulated_parameters", made).withColumn("_life", life).select("*", F.posexplode("_life").alias("step", "_e"))
    pause = whole(0, feed.most_pause_ms, "no", "step", F.lit("pause"), seed=feed.seed)
    return rows.select(
        "order_id", "client_id", "symbol", "side", "order_type", "order_price", qty.alias("order_qty"), F.col("_e.filled_qty").alias("filled_qty"), F.when(F.col("_e.filled_qty") > 0, F.col("order_price")).otherwise(none).alias("avg_fill_price"),
        F.concat(F.lit("ORDER_"), F.col("_e.order_status")).alias("event_type"), F.col("_e.order_status").alias("order_status"), F.timestamp_millis("_e.ms").alias("event_time"), "simulated_parameters", F.timestamp_millis(F.col("_e.ms") + pause).alias("arrives_at"),
    )
