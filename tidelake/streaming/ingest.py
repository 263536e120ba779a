"""Streams into the raw log and into tables, with lag measurement."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelake.operators.parse import envelope
from tidelake.store import Table


def raw_log(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Kafka-shaped rows into the raw Parquet log, by ingest date. Batches write into the folder as jobs of their own, so it stays open to batch appends."""

    def write(batch: DataFrame, batch_id: int) -> None:
        envelope(batch).write.mode("append").partitionBy("ingest_date").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def measured(stream: DataFrame, target: Table, samples: Table, checkpoint: str, *, run_id: str, label: str, trigger: dict | None = None) -> StreamingQuery:
    """Rows with produce_ts into a table, and for each how long it took until committed.

    Both commits carry the run and batch as token: a batch retried after a failure between them is completed, not
    repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.filter("produce_ts is not null").persist()
        try:
            if batch.isEmpty():
                return
            target.append(batch.withColumn("run_id", F.lit(run_id)), token=f"{run_id}/{batch_id}")
            now = int(time.time() * 1000)
            lag = batch.select("produce_ts", F.lit(now).alias("commit_ts"), (F.lit(now) - F.col("produce_ts")).alias("lag_ms"), F.lit(label).alias("config_label"), F.lit(run_id).alias("run_id"), F.lit(batch_id).cast("bigint").alias("batch_id"))
            samples.append(lag, token=f"{run_id}/{batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def merged(stream: DataFrame, target: Table, checkpoint: str, prepare, trigger: dict | None = None) -> StreamingQuery:
    """Upserts each micro-batch into a table; prepare() makes at most one row a key of it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        target.merge(prepare(batch), token=f"{checkpoint}/{batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def lag_report(samples: DataFrame) -> DataFrame:
    """run_id, config_label, samples, p50, p95, p99, low, high, per_second: by run."""
    from tidelake.operators.quality import lag_percentiles

    by = ["run_id", "config_label"]
    rate = samples.groupBy(*by).agg(F.round(F.count("*") / F.nullif((F.max("commit_ts") - F.min("commit_ts")) / 1000.0, F.lit(0.0)), 1).alias("per_second"))
    return lag_percentiles(samples, by).join(rate, by).orderBy(*by)
