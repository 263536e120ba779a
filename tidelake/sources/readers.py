"""Sources: message logs, files, Kafka topics, exchange frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.dedup import in_ingest_window

TRADE_CSV = "trade_id string, price string, qty string, quote_qty string, time string, is_buyer_maker string, is_best_match string"
BAR_CSV = "open_time string, open string, high string, low string, close string, volume string, close_time string, quote_volume string, number_of_trades string, taker_buy_base_volume string, taker_buy_quote_volume string, ignore string"
KAFKA_SHAPE = "topic string, partition int, offset bigint, timestamp timestamp, key binary, value binary"


def raw_window(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """The raw log in an ingest window [start, end), skipping the folders of other dates."""
    return in_ingest_window(spark.read.parquet(path), start, end, date="ingest_date")


def kafka_stream(spark: SparkSession, servers: str, topic: str, *, starting: str = "earliest", max_offsets: int | None = None, min_partitions: int | None = None) -> DataFrame:
    """A Kafka topic as a stream. Needs Spark's Kafka package on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    for name, value in (("maxOffsetsPerTrigger", max_offsets), ("minPartitions", min_partitions)):
        reader = reader.option(name, value) if value else reader
    return reader.load()


def kafka_batch(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """All of a Kafka topic, earliest to latest, without a checkpoint: running it twice reads twice."""
    return spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("endingOffsets", "latest").load()


def file_stream(spark: SparkSession, path: str, schema: str, *, max_files: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder as a stream, max_files a trigger."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def strict_csv(spark: SparkSession, paths: str | Iterable[str], schema: str) -> DataFrame:
    """Header-less CSV; rows with another number of columns are left out."""
    names = [c.split()[0] for c in schema.split(",")]
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths).select(F.from_csv("value", schema + ", _more string", {"mode": "PERMISSIVE"}).alias("r"), F.size(F.split("value", ",")).alias("n"))
    return lines.filter(F.col("n") == len(names)).select(*[f"r.{c}" for c in names])


def existing(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """Those paths that exist: for loops over months of which some were never exported."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return [p for p in paths if path(p).getFileSystem(conf).exists(path(p))]


def monthly(spark: SparkSession, template: str, first: str, last: str, schema: str) -> DataFrame | None:
    """strict_csv of the months' files from first to last ('2024-01'), named by a template with {month}; months without a file are left out, and None stands for no file at all."""
    (y, m), (y1, m1) = ((int(x) for x in month.split("-")) for month in (first, last))
    names = [template.format(month=f"{k // 12:04d}-{k % 12 + 1:02d}") for k in range(12 * y + m - 1, 12 * y1 + m1)]
    there = existing(spark, names)
    return strict_csv(spark, there, schema) if there else None


def first_rows(spark: SparkSession, path: str, schema: str, limit: int | None) -> DataFrame:
    """The first rows of a CSV file, as many as asked for: for trials. None: all."""
    rows = strict_csv(spark, path, schema)
    return rows if limit is None else rows.limit(limit)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of files, to tell what a result was made from. A file is read whole by one task: for fixtures, not for logs."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def bars_of(bars: DataFrame, symbol: str, interval: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of one series with close and volume, from start (included) to end (not), where these are given."""
    rows = bars.filter((F.col("symbol") == symbol) & (F.col("interval") == interval)).dropna(subset=["open_time", "close", "volume"])
    at = F.col("open_time").cast("timestamp")
    if start:
        rows = rows.filter(at >= F.lit(start).cast("timestamp"))
    return rows.filter(at < F.lit(end).cast("timestamp")) if end else rows


def symbols_of(config: dict, shard: int | None = None) -> list[str]:
    """The symbols a configuration (streams, symbols, shards) gives to one shard, or all; each belongs to exactly one."""
    symbols = sorted({s.strip().upper() for s in config.get("symbols", []) if s.strip()})
    shards = int(config.get("shards", 1))
    if not symbols or shards < 1:
        raise ValueError("a configuration needs symbols, and one shard at least")
    if shard is not None and not 0 <= shard < shards:
        raise ValueError(f"there is no shard {shard} of {shards}")
    return symbols if shard is None else symbols[shard::shards]


def only(df: DataFrame, symbols: list[str], column: str = "symbol") -> DataFrame:
    """Rows of the given symbols."""
    return df.filter(F.col(column).isin(symbols))


def anchor_frame(spark: SparkSession, path: str, start_ms: int, end_ms: int) -> DataFrame:
    """open_time_ms, close, volume of a CSV with header in [start, end), positive close and volume only, in order."""
    df = spark.read.option("header", True).schema("open_time_ms bigint, close double, volume double").csv(path)
    return df.filter((F.col("open_time_ms") >= start_ms) & (F.col("open_time_ms") < end_ms) & (F.col("close") > 0) & (F.col("volume") > 0)).orderBy("open_time_ms")


def stream_url(base: str, streams: Iterable[str], symbols: Iterable[str], most: int = 1024) -> str:
    """The address of a combined stream; refuses no symbols, unknown streams and too many of them."""
    streams, symbols = list(streams), [s.strip().lower() for s in symbols if s.strip()]
    if not symbols:
        raise ValueError("no symbols")
    if unknown := [s for s in streams if s != "aggTrade" and not s.startswith("kline_")]:
        raise ValueError(f"unsupported streams: {unknown}")
    names = [f"{s}@{x}" for s in symbols for x in streams]
    if len(names) > most:
        raise ValueError(f"{len(names)} streams, at most {most} are allowed")
    return f"{base.rstrip('/')}/stream?streams={'/'.join(names)}"
