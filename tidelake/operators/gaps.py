"""Hours missing inside a symbol's range, and what to fill again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.operators.blocked import neighbour


def missing_hours(hours: DataFrame, symbol: str, hour: str) -> DataFrame:
    """symbol, missing_hour: hours absent between a symbol's first and last. Exploded gap by gap, so nothing is compared with a grid."""
    once = hours.select(F.col(symbol).alias("symbol"), F.unix_seconds(F.date_trunc("hour", F.col(hour).cast("timestamp"))).alias("_h")).dropna().distinct()
    pairs = neighbour(once, ["symbol"], "_h", [], 3600 * 24 * 31, "_before").filter("_h - _before._h > 3600")
    each = pairs.select("symbol", F.explode(F.sequence(F.col("_before._h") + 3600, F.col("_h") - 3600, F.lit(3600).cast("bigint"))).alias("_m"))
    return each.select("symbol", F.timestamp_seconds("_m").alias("missing_hour"))


def coverage(hours: DataFrame, symbol: str, hour: str) -> DataFrame:
    """symbol, expected, actual, missing hours."""
    once = hours.select(F.col(symbol).alias("symbol"), F.unix_seconds(F.date_trunc("hour", F.col(hour).cast("timestamp"))).alias("_h")).dropna().distinct()
    out = once.groupBy("symbol").agg(((F.max("_h") - F.min("_h")) / 3600 + 1).cast("bigint").alias("expected"), F.count("*").alias("actual"))
    return out.withColumn("missing", F.col("expected") - F.col("actual"))


def backfill_day(missing: DataFrame) -> tuple[str, str] | None:
    """The day of the earliest gap as [start, end), or None."""
    first = missing.agg(F.min("missing_hour").alias("h")).select(F.date_format("h", "yyyy-MM-dd").alias("a"), F.date_format(F.date_add(F.to_date("h"), 1), "yyyy-MM-dd").alias("b")).first()
    return None if first["a"] is None else (f"{first['a']} 00:00:00", f"{first['b']} 00:00:00")
