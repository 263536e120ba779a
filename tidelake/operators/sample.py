"""Weighted sampling with replacement, the same in every run and under every partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Draws find their item within one of this many equal stretches of the total weight.
STRETCHES = 4096


def uniform(*parts, seed: int) -> F.Column:
    """A number in [0, 1) from the values of parts: no state, so a lost task draws the same again."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def weighted_draws(items: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """draw (0..n-1), key, within (uniform in [0, 1)): each draw takes an item with probability weight / total.

    key must be unique and sets the order of the running sum. Null, zero and negative weights are never drawn; with
    none left there are no draws. Running sums are taken per block of keys, then over blocks."""
    rows = items.select(F.col(key).alias("key"), F.col(weight).cast("double").alias("w")).filter("w > 0 and key is not null")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(256)))
    inside = Window.partitionBy("block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("block").agg(F.sum("w").alias("bw"))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
    bases = sums.withColumns({"base": F.coalesce(F.sum("bw").over(over), F.lit(0.0)), "total": F.sum("bw").over(Window.partitionBy())})
    spans = rows.withColumn("upto", F.sum("w").over(inside)).join(bases, "block").withColumns({"hi": (F.col("base") + F.col("upto")) / F.col("total"), "lo": (F.col("base") + F.col("upto") - F.col("w")) / F.col("total")})
    cut = lambda c: F.least(F.floor(c * STRETCHES), F.lit(STRETCHES - 1)).cast("bigint")
    spans = spans.select("key", "lo", "hi", F.explode(F.sequence(cut(F.col("lo")), cut(F.col("hi")))).alias("s"))
    draws = items.sparkSession.range(n).select(F.col("id").alias("draw"), uniform("id", F.lit("item"), seed=seed).alias("u")).withColumn("s", cut(F.col("u")))
    hit = draws.join(spans, "s").filter("u >= lo and u < hi")
    return hit.groupBy("draw").agg(F.min("key").alias("key")).withColumn("within", uniform("draw", F.lit("within"), seed=seed))
