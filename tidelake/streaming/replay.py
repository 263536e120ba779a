"""Replaying records at a fixed rate, and reading a source that breaks off."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def replay_records(rows: DataFrame, columns: list[str], produce_ts: Column) -> DataFrame:
    """key and value of rows as replayed messages: the columns as JSON, with produce_ts (ms) and source. Rows with any of the columns missing in the file (all null) are none."""
    kept = rows.dropna(how="all", subset=columns)
    return kept.select(F.col(columns[0]).cast("string").alias("key"), F.to_json(F.struct(*columns, produce_ts.cast("bigint").alias("produce_ts"), F.lit("replay").alias("source"))).alias("value"))


def schedule(rows: DataFrame, order: list[Column], rate: float, slice_ms: int = 50, blocks: int = 256) -> DataFrame:
    """Adds no (from 0, by order), due_ms (from the start, at ``rate`` rows a second) and slice (of slice_ms).

    Numbers are counted range by range of the order and then over the ranges, so no task sorts everything."""
    if rate <= 0:
        raise ValueError("rate must be positive")
    placed = rows.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # one row a block
    numbered = placed.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn("no", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    due = F.floor(F.col("no") * 1000 / rate).cast("bigint")
    return numbered.withColumns({"due_ms": due, "slice": F.floor(due / slice_ms).cast("bigint")}).drop("_at", "_part", "_base")


def pace(slices: Iterator[int], send: Callable[[int], None], slice_ms: int = 50, *, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, resync_s: float = 1.0) -> int:
    """Sends slice after slice, each at its place of an absolute schedule, so that delays do not add up. Fallen behind by more than resync_s, the schedule begins anew from there. Gives how often it did."""
    start, resyncs = clock(), 0
    for k in slices:
        wait = start + k * slice_ms / 1000 - clock()
        if wait > 0:
            sleep(wait)
        elif -wait > resync_s:
            start, resyncs = start - wait, resyncs + 1
        send(k)
    return resyncs


def timed(query: StreamingQuery, seconds: float) -> bool:
    """Lets a stream run for some time, then stops it. Gives whether it had ended by itself; its error, if any, is raised."""
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)


def backoff(attempt: int, least_s: float = 1.0, most_s: float = 60.0, jitter: float = 0.25, rand: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt (from 0): doubling up to most_s, and up to the share ``jitter`` more."""
    return min(most_s, least_s * 2 ** min(attempt, 63)) * (1 + jitter * rand())


def reconnecting(connect: Callable[[], Iterator[str]], sleep: Callable[[float], None] = time.sleep, most_attempts: int | None = None, **how) -> Iterator[str]:
    """The messages of a source that is opened again whenever it breaks off, after backoff(); a message that came through sets the attempts back. Ends when connect() ends without an error, or raises after most_attempts failures in a row."""
    attempt = 0
    while True:
        try:
            for message in connect():
                attempt = 0
                yield message
            return
        except OSError:
            if most_attempts is not None and attempt + 1 >= most_attempts:
                raise
            sleep(backoff(attempt, **how))
            attempt += 1
