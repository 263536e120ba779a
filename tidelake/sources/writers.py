"""Sinks beside the snapshot store: message topics, small exports, external tables and views, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_messages(df: DataFrame, key: Column, columns: list[str] | None = None) -> DataFrame:
    """key and value (the row as JSON) as Kafka's sink wants them. Null fields are left out of the JSON."""
    return df.select(key.cast("string").alias("key"), F.to_json(F.struct(*(columns or df.columns))).alias("value"))


def to_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Writes as_messages() rows to a topic, acknowledged by all replicas. Needs Spark's Kafka package."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("topic", topic).save()


def one_csv(df: DataFrame, path: str, order: list[str], most_rows: int = 5_000_000) -> int:
    """CSV with header, in order: one file up to most_rows rows, else as many files as that takes, whose names are in order too. Gives their number.

    Rows alike in ``order`` may be split between neighbouring files; every file is written by a task of its own."""
    rows = df.count()
    parts = max(1, -(-rows // most_rows))
    if parts == 1:
        spread = df.orderBy(*order).coalesce(1)
    else:
        rest = [c for c in df.columns if c not in order]
        spread = df.repartitionByRange(parts, *order, *([F.xxhash64(*rest)] if rest else [])).sortWithinPartitions(*order)
    spread.write.mode("overwrite").option("header", True).csv(path)
    return parts


def append_log(df: DataFrame, path: str, partition: str = "ingest_date") -> None:
    """Adds rows to a partitioned Parquet log."""
    df.write.mode("append").partitionBy(partition).parquet(path)


def gap_report(coverage: DataFrame, missing: DataFrame, path: str, most_symbols: int = 1000) -> dict:
    """Writes a JSON summary for a scheduler: gaps in all, and the symbols with most of them."""
    total = coverage.agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("n"), F.count_if(F.col("missing") > 0).alias("s")).first()
    worst = coverage.filter("missing > 0").orderBy(F.col("missing").desc(), "symbol").limit(most_symbols).collect()  # the feature: a top list
    first = missing.agg(F.date_format(F.min("missing_hour"), "yyyy-MM-dd HH:mm:ss").alias("h")).first()["h"]
    out = {"gap_count": total["n"], "symbols_with_gaps": total["s"], "earliest_gap": first, "by_symbol": {r["symbol"]: r["missing"] for r in worst}}
    write_text(coverage.sparkSession, path, json.dumps(out))
    return out


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, wherever Spark's file systems reach."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def external_table(spark: SparkSession, name: str, schema: str, path: str, partition: str | None = None) -> None:
    """Declares a table over existing Parquet files, and finds its partitions."""
    names = [c.split()[0] for c in schema.split(",")]
    by = f"PARTITIONED BY ({partition})" if partition else ""
    if partition and partition not in names:
        schema = f"{schema}, {partition} string"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet {by} LOCATION '{path}'")
    if partition:
        spark.sql(f"MSCK REPAIR TABLE {name}")


def register(views: dict[str, DataFrame]) -> None:
    """Temporary views by name."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def markdown(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a Markdown table: a report, not an export."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in df.limit(rows).collect()])
