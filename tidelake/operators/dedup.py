"""Latest row per key, rows not seen before, keys touched by an ingest window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.parsing import utc_timestamp


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the greatest by ``order`` (nulls lowest); full ties fall to the row's content, so reruns agree.

    An aggregate rather than row_number: it combines map-side, so the versions of a hot key never meet in one task.
    Null keys are a key. Columns keep their names and order."""
    names = df.columns
    packed = df.select(*[df[k].alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(*[df[c] for c in names]).alias("h")).alias("o"), F.struct(*[df[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("r"))
    best = packed.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.max_by("r", "o").alias("r"))
    return best.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)])


def not_yet_in(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the target lacks. Only the target's key columns are read. Null keys are never in it."""
    return df.join(target.select(*keys), keys, "left_anti")


def in_ingest_window(df: DataFrame, start: str, end: str, column: str = "ingest_time", date: str | None = None) -> DataFrame:
    """Rows ingested in [start, end); date: a partition column of yyyy-MM-dd texts, compared inclusively at both ends so that whole folders are skipped."""
    if date:
        df = df.filter(F.col(date).between(start[:10], end[:10]))
    at = utc_timestamp(F.col(column))
    return df.filter((at >= utc_timestamp(F.lit(start))) & (at < utc_timestamp(F.lit(end))))


def touched(df: DataFrame, touching: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of df whose key any row of ``touching`` has (null keys touch nothing)."""
    return df.join(touching.select(*keys).distinct(), keys, "left_semi")
