"""Filling containers of fixed capacity with texts, measured in tokens: minimum bin slack over a histogram.

Only lengths matter for how well containers fill, and there are at most ``capacity`` of them, however many items.
So the plan is made on the driver from a histogram of bounded size: the longest remaining length is put into a
container, a subset-sum over the remaining lengths (a bitset of reachable sums, counts split into powers of two)
finds the filling closest to capacity, backtracking gives how often each length is in it, and that pattern is used
as often as the counts allow. Items then find their container by arithmetic from their rank within their length;
ranks come from counts per length and shard, so no length is ever sorted in one task.

An item longer than the capacity is split, at token borders, into full containers and a rest; nothing else is split."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.session import ship

#: Where the public tokenizers' files lie unless the caller says otherwise.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
#: The pre-tokenizer of the byte-level BPE (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank between two non-blanks: the pre-tokenizer always cuts before it, so the pieces' token counts add up.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Remembered pieces a worker process keeps.
REMEMBERED = 200_000


class TokenCounter:
    """Number of tokens of a text under a tiktoken vocabulary file. Counts of pieces between single blanks are remembered."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        known, total = self.known, 0
        first, *rest = CUT.split(text)
        total = len(self.encoding.encode_ordinary(first))
        for piece in rest:
            n = known.get(piece)
            if n is None:
                n = len(self.encoding.encode_ordinary(" " + piece))
                if len(piece) < 40:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = n
            total += n
        return total


_counters: dict[str, TokenCounter] = {}


def token_lengths(texts: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """key, tokens (bigint) of every text that is not null or blank; a null key is kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counters.setdefault(tokenizer, None) or TokenCounter(tokenizer)
        _counters[tokenizer] = count
        for b in batches:
            lengths = pa.array((count(t) for t in b.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), lengths], ["key", "tokens"])

    ship(texts.sparkSession)
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(r"\S"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, tokens bigint")


def token_slices(texts: DataFrame, packed: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """key, piece, container, ids: the token numbers of every packed piece, cut out of its whole text's tokens.

    Joined by key, which must be unique in the texts; a null key joins nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counters.setdefault(tokenizer, None) or TokenCounter(tokenizer)
        _counters[tokenizer] = count
        for b in batches:
            starts, sizes, last, ids = b.column(2).to_pylist(), b.column(3).to_pylist(), None, []
            cut = []
            for t, a, n in zip(b.column(5).to_pylist(), starts, sizes, strict=True):
                if t is not last:  # the pieces of a text come one after another
                    last, ids = t, count.encoding.encode_ordinary(t)
                cut.append(ids[a : a + n])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), pa.array(cut, pa.list_(pa.int32()))], ["key", "piece", "container", "ids"])

    ship(texts.sparkSession)
    rows = packed.select("key", "piece", "start", "tokens", "container").join(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, piece bigint, container bigint, ids array<int>")


def fill_once(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The filling, as length: times, that holds the longest length and comes closest to capacity."""
    longest = max(counts)
    goal = capacity - longest
    full, reach, steps = (1 << (goal + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= goal), reverse=True):
        left = min(counts[length] - (length == longest), goal // length)
        part = 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            part *= 2
        if reach >> goal & 1:
            break
    rest = reach.bit_length() - 1
    out = {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> rest & 1:
            out[length] = out.get(length, 0) + take
            rest -= length * take
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Fillings and how many containers get each; together they use every counted item exactly once."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    out = []
    while counts:
        filling = fill_once(counts, capacity)
        times = min(counts[x] // k for x, k in filling.items())
        for x, k in filling.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
        out.append((filling, times))
    return out


def segments(fillings: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, per container, first container), sorted: where the ranks of each length go."""
    used: dict[int, int] = {}
    rows, container = [], 0
    for filling, times in fillings:
        for length, k in filling.items():
            rows.append((length, used.get(length, 0), k, container))
            used[length] = used.get(length, 0) + k * times
        container += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(spark: SparkSession, lengths: DataFrame, scratch: str, capacity: int = CAPACITY, shards: int | None = None) -> DataFrame:
    """key, piece, start, tokens, container: each item (or piece of one longer than capacity) in one container.

    ``lengths`` has key and tokens; rows of no tokens are no items. It is written once under ``scratch`` (the shared
    folder), so that ranks are taken from one and the same table however often tasks are run again. shards: tasks that
    share the ranking of one length."""
    ship(spark)
    lengths.filter("tokens > 0").write.mode("overwrite").parquet(scratch)
    kept = spark.read.parquet(scratch)
    shards = shards or max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    pieces = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / capacity).cast("bigint"))
    items = kept.withColumn("piece", F.explode(pieces)).select("key", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("piece") * capacity).alias("tokens"))
    items = items.withColumn("_shard", F.pmod(F.xxhash64("key", "piece"), F.lit(shards)))
    counts = items.groupBy("tokens", "_shard").agg(F.count("*").alias("_n"))
    # at most capacity rows, whatever the input
    histogram = {r["tokens"]: r["n"] for r in counts.groupBy("tokens").agg(F.sum("_n").alias("n")).collect()}
    table = segments(plan(histogram, capacity))
    before = Window.partitionBy("tokens").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("tokens", "_shard").orderBy("key", "piece")
    ranked = items.withColumn("_in", F.row_number().over(inside)).join(bases, ["tokens", "_shard"]).withColumn("rank", F.col("_base") + F.col("_in") - 1)
    ranked = ranked.select("key", "piece", "start", "tokens", "rank")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = (table[:, 0] << 44) | table[:, 1]
        for b in batches:
            length, rank = b.column("tokens").to_numpy(), b.column("rank").to_numpy()
            row = table[np.searchsorted(code, (length << 44) | rank, "right") - 1]
            where = row[:, 3] + (rank - row[:, 1]) // row[:, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(where)], ["key", "piece", "start", "tokens", "container"])

    kind = lengths.schema["key"].dataType.simpleString()
    return ranked.mapInArrow(place, f"key {kind}, piece bigint, start bigint, tokens bigint, container bigint")
