"""The late-event operator over a stream: periods are published when every source has passed them, and never change after.

State is three tables of the snapshot store, small beside the stream: partial aggregates per batch, key and period; the
furthest punctuation of each source per batch; and the periods closed so far. A batch adds to the first two, then
closes what its punctuations allow and writes those periods' figures. Every UPKEEP batches the partials of closed
periods are dropped, punctuations are folded to one a source, files are compacted and old snapshots expire, so that a
batch costs by the open periods, not by the stream's age. Records that their own source
had already passed, and records of closed periods, go to the table of diverted ones. Every write carries the batch as
token, so a batch run again after a failure completes instead of repeating."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelake.functions.parsing import micros
from tidelake.operators.late_periods import US, Periods, assign
from tidelake.schemas import TableSpec
from tidelake.store import Table


#: Batches between two rounds of upkeep.
UPKEEP = 50


class PeriodStream:
    """Counts (and sums) per key and period of a stream of records with event time, arrival and source."""

    def __init__(self, spark: SparkSession, path: str, periods: Periods, *, key: str, event_time: str, arrival: str, source: str, value: str | None = None) -> None:
        self.periods, self.key, self.event_time, self.arrival, self.source, self.value = periods, key, event_time, arrival, source, value
        self.batches = 0
        made = lambda name, spec: Table(spark, f"{path.rstrip('/')}/{name}", TableSpec(spec))
        self.partials = made("partials", "item string, period bigint, n bigint, total double")
        self.marks = made("marks", "source string, arrival_us bigint")
        self.closed = made("closed", "period bigint")
        self.final = made("final", "item string, period_epoch bigint, n bigint, total double")
        self.diverted = made("diverted", "item string, event_us bigint, arrival_us bigint, source string, reason string")

    def batch(self, rows: DataFrame, token: str) -> None:
        """Takes one micro-batch."""
        rows = assign(rows.dropna(subset=[self.event_time, self.arrival]), self.periods, F.col(self.event_time), F.col(self.arrival)).persist()
        try:
            done = self.closed.read().withColumnRenamed("period", "_period").withColumn("_done", F.lit(True))
            marked = rows.join(done, "_period", "left")
            late = F.col("_diverted") | F.coalesce("_done", F.lit(False))
            item, source = F.col(self.key).cast("string").alias("item"), F.coalesce(F.col(self.source).cast("string"), F.lit("?")).alias("source")
            value: Column = F.col(self.value).cast("double") if self.value else F.lit(None).cast("double")
            self.diverted.append(marked.filter(late).select(item, micros(F.col(self.event_time)).alias("event_us"), micros(F.col(self.arrival)).alias("arrival_us"), source, F.when(F.col("_diverted"), "passed by its source").otherwise("period closed").alias("reason")), token=f"{token}/diverted")
            self.partials.append(marked.filter(~late).groupBy(item, F.col("_period").alias("period")).agg(F.count("*").alias("n"), F.sum(value).alias("total")), token=f"{token}/partials")
            self.marks.append(rows.groupBy(source).agg(F.max(micros(F.col(self.arrival))).alias("arrival_us")), token=f"{token}/marks")
            self._close(token)
            self.batches += 1
            if self.batches % UPKEEP == 0:
                self.upkeep()
        finally:
            rows.unpersist()

    def upkeep(self, keep_last: int = 10) -> None:
        """Makes the state small again. A break within it loses nothing: what is dropped is in closed periods, and of a source's punctuations only the furthest tells."""
        if self.partials.parts():
            self.partials.overwrite(self.partials.read().join(self.closed.read(), "period", "left_anti"), "fold")
        if self.marks.parts():
            self.marks.overwrite(self.marks.read().groupBy("source").agg(F.max("arrival_us").alias("arrival_us")), "fold")
        for t in (self.partials, self.marks, self.closed):
            t.compact()
            t.expire(int(time.time() * 1000) + 1, keep_last)

    def passed(self) -> int | None:
        """The last period that may close: every source has passed it, or the furthest stamp lies the idle timeout past its bound. The same as late_periods.closing_times()."""
        at = self.marks.read().groupBy("source").agg(F.max("arrival_us").alias("a"))
        by_all, by_time = self.periods.passed(F.col("least")), self.periods.passed(F.col("now") - self.periods.idle_timeout_s * US + 1)
        return at.agg(F.min("a").alias("least"), F.max("a").alias("now")).select(F.greatest(by_all, by_time).alias("p")).first()["p"]

    def _close(self, token: str) -> None:
        upto = self.passed()
        if upto is None:
            return
        ready = self.partials.read().filter(F.col("period") <= upto).join(self.closed.read(), "period", "left_anti")
        self.final.append(ready.groupBy("item", "period").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select("item", (F.col("period") * self.periods.period_s).alias("period_epoch"), "n", "total"), token=f"{token}/final")
        self.closed.append(ready.select("period").distinct(), token=f"{token}/closed")

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        write = lambda rows, batch_id: self.batch(rows, f"{checkpoint}/{batch_id}")
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
