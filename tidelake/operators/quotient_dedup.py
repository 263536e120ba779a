"""Exactly-once from at-least-once: quotient hash tables over fixed-width identifiers.

A 64-bit identifier is permuted by a Feistel network (a bijection, keyed by the identifier's name space) and cut into
a quotient, which names a shard, and a remainder, which is stored whole. As the permutation can be undone, quotient
and remainder together are the identifier: membership has no false matches, unlike a fingerprint. The permutation
spreads sequential ids evenly over shards. A table is stored by quotient: in each shard's folder the remainders, sorted
within their name space, each once, with how often it was met. Before anything is stored, a combining aggregate inserts
each identifier once per task, so an identifier or name space with a third of all rows reaches the shuffle as one row a
task. A further batch meets only its own shards, read beside it by the task that holds the shard; what is stored is
never shuffled again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.change_log import open_runs
from tidelake.session import ship

LOW = 0xFFFFFFFF
ROUNDS = 3
#: A shard's stored rows.
STORED = pa.schema([("space", pa.string()), ("r", pa.int64()), ("n", pa.int64())])


def _round(half: Column, space: Column, k: int) -> Column:
    return F.xxhash64(half, space, F.lit(k)).bitwiseAND(F.lit(LOW))


def split(df: DataFrame, identifier: str, space: str, quotient_bits: int = 12) -> DataFrame:
    """Adds _q (int, the shard) and _r (bigint, the remainder); both null where the identifier is null."""
    df = df.withColumns({"_h": F.shiftrightunsigned(identifier, 32), "_l": F.col(identifier).bitwiseAND(F.lit(LOW))})
    for k in range(ROUNDS):
        df = df.withColumns({"_h": F.col("_l"), "_l": F.col("_h").bitwiseXOR(_round(F.col("_l"), F.col(space), k))})
    whole = F.shiftleft("_h", 32).bitwiseOR(F.col("_l"))
    rest = 64 - quotient_bits
    return df.withColumns({"_q": F.shiftrightunsigned(whole, rest).cast("int"), "_r": whole.bitwiseAND(F.lit((1 << rest) - 1))}).drop("_h", "_l")


def restore(df: DataFrame, identifier: str, space: str, quotient_bits: int = 12) -> DataFrame:
    """Undoes split(): adds the identifier computed from _q and _r and drops them."""
    rest = 64 - quotient_bits
    whole = F.shiftleft(F.col("_q").cast("bigint"), rest).bitwiseOR(F.col("_r"))
    df = df.withColumn("_w", whole).withColumns({"_h": F.shiftrightunsigned("_w", 32), "_l": F.col("_w").bitwiseAND(F.lit(LOW))})
    for k in reversed(range(ROUNDS)):
        df = df.withColumns({"_h": F.col("_l").bitwiseXOR(_round(F.col("_h"), F.col(space), k)), "_l": F.col("_h")})
    return df.withColumn(identifier, F.shiftleft("_h", 32).bitwiseOR(F.col("_l"))).drop("_w", "_h", "_l", "_q", "_r")


def occurrences(df: DataFrame, space: Column, identifier: Column, quotient_bits: int = 12) -> DataFrame:
    """One row an identifier: space, identifier, n (its rows). Rows with a null identifier are none; a null space is a space of its own."""
    keyed = split(df.select(space.cast("string").alias("space"), identifier.cast("bigint").alias("identifier")).filter("identifier is not null"), "identifier", "space", quotient_bits)
    counted = keyed.groupBy("_q", "space", "_r").agg(F.count("*").alias("n"))
    return restore(counted, "identifier", "space", quotient_bits).select("space", "identifier", "n")


def keep_first(df: DataFrame, space: Column, identifier: Column, order: list[Column], quotient_bits: int = 12) -> DataFrame:
    """Exactly one copy of every identifier: the first by ``order``; full ties are broken by the row's content, so the result is the same in every run.

    Rows without identifier are not messages with an identity: all stay. Columns and their order are the input's,
    whatever their names. An empty input gives an empty result."""
    names = df.columns
    packed = df.select(space.cast("string").alias("space"), identifier.cast("bigint").alias("identifier"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(*[df[c] for c in names]).alias("h")).alias("ord"), F.struct(*[df[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    unpack = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)]
    keyed = split(packed.filter("identifier is not null"), "identifier", "space", quotient_bits)
    kept = keyed.groupBy("_q", "space", "_r").agg(F.min_by("row", "ord").alias("row"))
    return kept.select(*unpack).unionAll(packed.filter("identifier is null").select(*unpack))


def _shard_of(folders: list[str], q: int) -> dict[str | None, np.ndarray]:
    """The remainders stored for a shard in any of the folders, by name space, sorted."""
    held: dict[str | None, list[np.ndarray]] = {}
    for rows in open_runs([f"{f}/_q={q}" for f in folders], STORED):
        for b in rows:
            space = b.column(0).dictionary_encode()
            code, r = space.indices.fill_null(-1).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            for c in np.unique(code):
                held.setdefault(None if c < 0 else space.dictionary[int(c)].as_py(), []).append(r[code == c])
    return {s: np.sort(np.concatenate(parts)) for s, parts in held.items()}


class QuotientIndex:
    """The identifiers seen so far, kept in the shared folder: one folder a batch, in it one a quotient.

    The folder must be one that executors reach through pyarrow's file systems (a mounted folder, HDFS, S3, GCS).
    quotient_bits: 2 to so many shards; a shard of one batch must fit in a task's memory, eight bytes an identifier."""

    def __init__(self, spark: SparkSession, path: str, quotient_bits: int = 6) -> None:
        self.spark, self.path, self.bits = spark, path.rstrip("/"), quotient_bits

    def _batches(self) -> list[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = hadoop(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        full = [s.getPath() for s in fs.listStatus(root) if fs.exists(hadoop(s.getPath(), "_SUCCESS"))]
        return sorted(p.getName() for p in full if len(fs.listStatus(p)) > 1)  # a batch without identifiers has its mark only

    def _write(self, ids: DataFrame, name: str) -> None:
        """ids: q, space, r, n, each identifier once."""
        ids.withColumnRenamed("q", "_q").repartition("_q").sortWithinPartitions("_q", "space", "r").write.mode("overwrite").partitionBy("_q").parquet(f"{self.path}/{name}")

    def stored(self) -> DataFrame:
        """space, identifier, n (rows met) of all batches; an identifier that was counted in several is in several rows."""
        names = self._batches()
        if not names:
            return self.spark.createDataFrame([], "space string, identifier bigint, n bigint")
        # each batch's folder is read by itself, as partition folders must share a root
        rows = None
        for n in names:
            part = self.spark.read.schema("space string, r bigint, n bigint, _q int").parquet(f"{self.path}/{n}")
            rows = part if rows is None else rows.unionByName(part)
        return restore(rows.withColumnRenamed("r", "_r"), "identifier", "space", self.bits).select("space", "identifier", "n")

    def count(self, df: DataFrame, name: str, space: Column, identifier: Column) -> None:
        """Stores how often each identifier of a table stands in it. Rows with a null identifier have none."""
        keyed = split(df.select(space.cast("string").alias("space"), identifier.cast("bigint").alias("identifier")).filter("identifier is not null"), "identifier", "space", self.bits)
        self._write(keyed.groupBy(F.col("_q").alias("q"), "space", F.col("_r").alias("r")).agg(F.count("*").alias("n")), name)

    def insert(self, batch: DataFrame, batch_id: int, space: Column, identifier: Column, order: list[Column]) -> DataFrame:
        """The rows of a batch whose identifier no earlier batch held, one an identifier (the first by order).

        They are written once, beside the index. A batch replayed under its own id (after a lost driver) replaces its
        folders and gives the same rows again."""
        ship(self.spark)
        name = f"batch-{batch_id:012d}"
        folders = [f"{self.path}/{b}" for b in self._batches() if b != name]
        once = keep_first(batch.filter(identifier.isNotNull()), space, identifier, order, self.bits)
        ids = split(once.select(F.struct("*").alias("row"), space.cast("string").alias("space"), identifier.cast("bigint").alias("id")), "id", "space", self.bits)
        rows = ids.select(F.col("_q").alias("q"), "space", F.col("_r").alias("r"), "row").repartition("q").sortWithinPartitions("q")

        def fresh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, {}
            for b in batches:
                shard = b.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), b.num_rows]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    if hi == lo:
                        continue
                    if at != shard[lo]:
                        at = int(shard[lo])
                        held = _shard_of(folders, at)
                    part = b.slice(lo, hi - lo)
                    known = [s in held and bool((i := np.searchsorted(held[s], r)) < len(held[s]) and held[s][i] == r) for s, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                    yield part.filter(pa.array([not k for k in known], pa.bool_()))

        kept = f"{self.path}/_rows/{name}"
        (rows.mapInArrow(fresh, rows.schema) if folders else rows).write.mode("overwrite").parquet(kept)
        out = self.spark.read.schema(rows.schema).parquet(kept)
        self._write(out.select("q", "space", "r", F.lit(1).cast("bigint").alias("n")), name)
        return out.select("row.*")

    def compact(self, name: str = "base") -> None:
        """One batch out of all, shard by shard, each task merging its shard's files. Batches compacted can't be replayed any more.

        The new folder is whole before the old ones go; in between identifiers are merely stored twice."""
        ship(self.spark)
        names = self._batches()
        folders, fields = [f"{self.path}/{b}" for b in names], STORED

        def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for q in b.column(0).to_pylist():
                    for space, r in _shard_of(folders, q).items():
                        r, n = np.unique(r, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([q] * len(r), pa.int32()), pa.array([space] * len(r), pa.string()), pa.array(r), pa.array(n)], ["q", *fields.names])

        shards = self.spark.range(0, 1 << self.bits, 1, 1 << self.bits)
        self._write(shards.mapInArrow(merge, "q int, space string, r bigint, n bigint"), f"{name}-{len(names)}-{names[-1] if names else ''}")
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for n in names:
            fs.delete(hadoop(f"{self.path}/{n}"), True)
