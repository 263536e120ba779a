"""A table rebuilt from a change feed: sorted runs, merged on read, compacted now and then.

Changes are folded per key into a summary that can be merged in any order: the last change, the last insert and the
last delete, each by the change sequence; a key with a third of all changes leaves each task as one row. A run is a set
of summaries, cut by key into a fixed number of buckets and sorted by key within each; the deletes in it are its
tombstones. Reading is a k-way merge: one task takes one bucket of every run, streams its sorted files side by side and
folds equal keys as they meet, a bounded number of rows of each run in memory, nothing shuffled and nothing sorted
again. As folding is associative, commutative and idempotent, repeated and out-of-order changes, replayed runs and lost
executors do not alter the result. Compacting writes the merged summaries as one run, bucket by bucket; tombstones
stay, since an older change may still arrive."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelake.session import ship

INSERT, UPDATE, DELETE = "insert", "update", "delete"
#: Buckets of a new log; a log keeps the number it began with.
BUCKETS = 32
#: Rows of each run that a merging task holds at a time.
AT_ONCE = 16_384


def summarise(changes: DataFrame, key: list[str], sequence: list[Column], kind: Column, payload: list[str], run: Column | None = None) -> DataFrame:
    """One row a key (and run): last (sequence and payload), born (sequence of the last insert), dead (of the last delete).

    Rows with a null key column or a null in the sequence's first column are no changes. Changes of equal sequence
    are told apart by their payload, so the result does not depend on the order of rows."""
    seq = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(sequence)])
    rows = changes.select(*key, *([run.alias("_run")] if run is not None else []), seq.alias("_seq"), kind.alias("_kind"), F.struct(*payload).alias("_row")).dropna(subset=key).filter("_seq.s0 is not null and _kind is not null")
    return rows.groupBy(*key, *(["_run"] if run is not None else [])).agg(
        F.max(F.struct("_seq", "_row")).alias("last"),
        F.max(F.when(F.col("_kind") == INSERT, F.col("_seq"))).alias("born"),
        F.max(F.when(F.col("_kind") == DELETE, F.col("_seq"))).alias("dead"),
    )


def current(merged: DataFrame, key: list[str]) -> DataFrame:
    """Keys that exist, with the payload of their last change.

    After a delete only a later insert brings a key back; a key that was never deleted exists from any change on."""
    alive = F.col("dead").isNull() | F.coalesce(F.col("born") > F.col("dead"), F.lit(False))
    return merged.filter(alive).select(*key, "last._row.*")


# merging sorted runs


class _Run:
    """The sorted rows of one file, some at a time."""

    def __init__(self, batches: Iterator[pa.RecordBatch], key: list[str]) -> None:
        self.batches, self.key = batches, key
        self.rows, self.keys, self.more = None, [], True
        self.fill()

    def fill(self) -> None:
        while self.more and not self.keys:
            batch = next(self.batches, None)
            if batch is None:
                self.rows, self.more = None, False
            else:
                self.rows, self.keys = batch, list(zip(*(batch.column(k).to_pylist() for k in self.key), strict=True))

    def take(self, bound: tuple | None) -> tuple[pa.RecordBatch, list[tuple]]:
        """Takes the rows with keys up to the bound; None: all at hand."""
        n = len(self.keys) if bound is None else bisect_right(self.keys, bound)
        rows, keys = self.rows.slice(0, n), self.keys[:n]
        self.rows, self.keys = self.rows.slice(n), self.keys[n:]
        self.fill()
        return rows, keys


def merge_runs(files: list[Iterator[pa.RecordBatch]], key: list[str]) -> Iterator[tuple[pa.Table, list[tuple]]]:
    """Blocks of rows of all runs, with their keys: every row of a key is in one block, and blocks rise by key.

    A block reaches to the least of the last keys at hand: beyond it some run may still have rows to come."""
    runs = [r for r in (_Run(f, key) for f in files) if r.keys]
    while runs:
        bound = min(r.keys[-1] for r in runs) if len(runs) > 1 else None
        parts = [r.take(bound) for r in runs]
        runs = [r for r in runs if r.keys]
        yield pa.Table.from_batches([p for p, _ in parts]), [k for _, ks in parts for k in ks]


def _order(value):
    """Values in Spark's order of structs: nulls first, field by field."""
    if isinstance(value, dict):
        return (1, tuple(_order(v) for v in value.values()))
    return (0,) if value is None else (1, value)


def fold_block(rows: pa.Table, keys: list[tuple], key: list[str]) -> pa.Table:
    """One summary a key, by key."""
    at: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        at.setdefault(k, []).append(i)
    whole = {c: rows.column(c).combine_chunks() for c in ("last", "born", "dead")}
    winners = {c: [] for c in whole}
    for k in sorted(at):
        places = at[k]
        for c, won in winners.items():
            won.append(places[0] if len(places) == 1 else max(places, key=lambda i, c=c: _order(whole[c][i].as_py())))
    columns = [rows.column(k).take(pa.array(winners["last"], pa.int64())) for k in key]
    return pa.table([*columns, *(whole[c].take(pa.array(w, pa.int64())) for c, w in winners.items())], [*key, *whole])


def open_runs(folders: list[str], schema: pa.Schema) -> list[Iterator[pa.RecordBatch]]:
    """The rows of every Parquet file in the folders that exist, in one schema, a stream a file, read where the executor runs."""
    import pyarrow.fs as pf
    import pyarrow.parquet as pq

    out = []
    for folder in folders:
        fs, path = pf.FileSystem.from_uri("file:///" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder)
        for f in sorted(fs.get_file_info(pf.FileSelector(path, allow_not_found=True, recursive=True)), key=lambda f: f.path):
            if f.path.endswith(".parquet"):
                file = pq.ParquetFile(fs.open_input_file(f.path), coerce_int96_timestamp_unit="us")
                out.append(b for rows in file.iter_batches(AT_ONCE) for b in pa.Table.from_batches([rows]).select(schema.names).cast(schema).to_batches())
    return out


class ChangeLog:
    """The runs of one table under a path in the shared folder. Each run is a folder with a name of its own: written anew, it replaces itself.

    The path must be one that executors reach through pyarrow's file systems (a mounted folder, HDFS, S3, GCS)."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], sequence: list[Column], kind: Column, payload: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.sequence, self.kind, self.payload, self.buckets = spark, path.rstrip("/"), key, sequence, kind, payload, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._schema = None
        for folder in self._finished():
            self.buckets = int(folder.rsplit("-of-", 1)[1])

    def append(self, changes: DataFrame, name: str, split_by: Column | None = None) -> None:
        """Writes a run, or with split_by (the log segment a change came from) one sorted run a segment, in one job."""
        seg = F.lit("0") if split_by is None else F.coalesce(split_by.cast("string"), F.lit("none"))
        rows = summarise(changes, self.key, self.sequence, self.kind, self.payload, seg)
        self._schema = rows.drop("_run").schema
        self._write(rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")).repartition("_bucket"), name)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.sortWithinPartitions("_bucket", "_run", *self.key).write.mode("overwrite").partitionBy("_bucket", "_run").parquet(self._folder(name))

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}-of-{self.buckets}"

    def runs(self) -> list[str]:
        """Names of finished runs."""
        return [f.rsplit("-of-", 1)[0] for f in self._finished()]

    def _finished(self) -> list[str]:
        """Folders of finished runs: name-of-buckets."""
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root) if self._fs.exists(self._path(s.getPath(), "_SUCCESS")))

    def merged(self) -> DataFrame | None:
        """key, last, born, dead, _bucket: one row a key out of all runs, each bucket merged by one task."""
        names = self._finished()
        full = [f"{self.path}/{n}" for n in names if len(self._fs.listStatus(self._path(f"{self.path}/{n}"))) > 1]  # a run without changes has its mark only
        if not full:
            return self.spark.createDataFrame([], self._schema).withColumn("_bucket", F.lit(0)) if self._schema else None
        ship(self.spark)
        plain = self.spark.read.parquet(full[0]).drop("_run", "_bucket").schema
        schema = to_arrow_schema(plain)
        key = self.key

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for bucket in b.column(0).to_pylist():
                    for rows, keys in merge_runs(open_runs([f"{f}/_bucket={bucket}" for f in full], schema), key):
                        out = fold_block(rows, keys, key).select(schema.names)
                        yield from out.append_column("_bucket", pa.array([bucket] * out.num_rows, pa.int32())).combine_chunks().to_batches()

        each = self.spark.range(0, self.buckets, 1, self.buckets)
        return each.mapInArrow(run, T.StructType([*plain.fields, T.StructField("_bucket", T.IntegerType())]))

    def read(self) -> DataFrame | None:
        """The current table, merged on read; None before the first run."""
        merged = self.merged()
        return None if merged is None else current(merged, self.key)

    def compact(self, name: str) -> None:
        """One run out of all. The new run is whole before the old ones go, and merging is idempotent, so a break in between loses nothing."""
        old, merged = self._finished(), self.merged()
        if merged is None:
            return
        self._write(merged.withColumn("_run", F.lit("0")), name)
        for n in old:
            if f"{self.path}/{n}" != self._folder(name):
                self._fs.delete(self._path(f"{self.path}/{n}"), True)
