"""Pairing records of two sides by nearest time within a tolerance: a stateful, watermark-driven join.

Per entity both sides are buffered. A left record is emitted once the watermark has passed its tolerance horizon
(time + tolerance): no better candidate can come any more. Right records older than what any pending or future left
record can reach are evicted. One state machine (``Buffers``) does this; it is driven

* over bounded tables by ``nearest``: rows sorted by time stream through each task, the watermark being the time of
  the last row seen, and
* over streams by ``nearest_stream``: Spark's event-time watermark, the buffers in the state store.

An entity with a third of all rows is split: state is kept per entity and time block, and right records within the
tolerance of a block's edge are given to both sides of it. So no task holds an entity, only its block, and of that
only what the watermark has not yet passed.

Nulls: rows without entity or time pair with nothing. Ties: at equal distance the earlier right record wins, at
equal time the smaller key. Repeated left rows are one row each in the result; repeated right rows change nothing."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.session import ship

US = 1_000_000
NONE = np.zeros(0, dtype=np.int64)


class Buffers:
    """Pending left records and reachable right records of one entity and block. Times in microseconds."""

    def __init__(self, tolerance: int) -> None:
        self.tolerance = tolerance
        self.left_t, self.left_id = NONE, np.zeros(0, dtype=object)
        self.right_t, self.right_key = NONE, NONE

    def add(self, left_t: np.ndarray, left_id: np.ndarray, right_t: np.ndarray, right_key: np.ndarray) -> None:
        if len(left_t):
            self.left_t, self.left_id = np.concatenate([self.left_t, left_t]), np.concatenate([self.left_id, left_id])
        if len(right_t):
            t, key = np.concatenate([self.right_t, right_t]), np.concatenate([self.right_key, right_key])
            order = np.lexsort((key, t))
            self.right_t, self.right_key = t[order], key[order]

    def advance(self, watermark: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, keys and distances of the left records whose horizon the watermark passed and that have a match. None: the end of time."""
        if watermark is None:
            ready = np.ones(len(self.left_t), dtype=bool)
        else:
            ready = self.left_t + self.tolerance < watermark
        out = self._match(self.left_t[ready], self.left_id[ready])
        self.left_t, self.left_id = self.left_t[~ready], self.left_id[~ready]
        if watermark is not None:
            reach = min(watermark, int(self.left_t.min()) if len(self.left_t) else watermark) - self.tolerance
            first = int(np.searchsorted(self.right_t, reach, "left"))
            if first:
                self.right_t, self.right_key = self.right_t[first:], self.right_key[first:]
        return out

    def _match(self, t: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(t) or not len(self.right_t):
            return ids[:0], NONE, NONE
        far = np.int64(2**62)
        at = np.searchsorted(self.right_t, t, "left")
        has_next, has_prev = at < len(self.right_t), at > 0
        nxt = np.where(has_next, self.right_t[np.minimum(at, len(self.right_t) - 1)] - t, far)
        prev_t = self.right_t[np.maximum(at - 1, 0)]
        prev = np.where(has_prev, t - prev_t, far)
        back = prev <= nxt
        index = np.where(back, np.searchsorted(self.right_t, prev_t, "left"), np.minimum(at, len(self.right_t) - 1))
        distance = np.where(back, prev, nxt)
        ok = distance <= self.tolerance
        return ids[ok], self.right_key[index[ok]], distance[ok]


def _sides(left: DataFrame, right: DataFrame, left_entity: list[Column], left_time: Column, left_id: Column, right_entity: list[Column], right_time: Column, right_key: Column, tolerance: Column, block_s: int) -> DataFrame:
    """Both sides in one shape: entity columns e0.., block, t, tol, id (left) or key (right); edge records in both blocks."""
    names = [f"e{i}" for i in range(len(left_entity))]
    block = lambda t: F.floor(t / (block_s * US)).cast("bigint")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    lrows = left.select(*[c.alias(n) for n, c in zip(names, left_entity, strict=True)], micros(left_time).alias("t"), left_id.cast("string").alias("id"), F.lit(None).cast("bigint").alias("key"), tolerance.cast("bigint").alias("tol"))
    rrows = right.select(*[c.alias(n) for n, c in zip(names, right_entity, strict=True)], micros(right_time).alias("t"), F.lit(None).cast("string").alias("id"), right_key.cast("bigint").alias("key"), tolerance.cast("bigint").alias("tol"))
    lrows = lrows.dropna(subset=[*names, "t", "id"]).withColumn("block", block(F.col("t")))
    rrows = rrows.dropna(subset=[*names, "t", "key"]).withColumn("block", F.explode(F.sequence(block(F.col("t") - F.col("tol")), block(F.col("t") + F.col("tol")))))
    return lrows.unionByName(rrows)


def _drive(names: list[str]):
    keys = [*names, "block"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def emit(who: tuple, found: tuple) -> pa.RecordBatch:
            ids, key, dist = found
            cols = [pa.array([v] * len(ids), pa.string()) for v in who[:-1]]
            return pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.string()), pa.array(key, pa.int64()), pa.array(dist, pa.int64())], [*names, "id", "key", "distance_us"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = [np.asarray(batch.column(k).to_pandas()) for k in keys]
            edge = np.zeros(n, dtype=bool)
            for c in codes:
                edge[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(np.concatenate([[True], edge[1:]])) if n > 1 else np.array([0])
            ends = np.append(starts[1:], n)
            t, tol = batch.column("t").to_numpy(zero_copy_only=False), batch.column("tol").to_numpy(zero_copy_only=False)
            left = np.asarray(batch.column("key").is_null())
            key = batch.column("key").fill_null(0).to_numpy(zero_copy_only=False)
            ids = np.asarray(batch.column("id").to_pandas(), dtype=object)
            for a, b in zip(starts, ends, strict=True):
                who = tuple(c[a] for c in codes)
                if who != current:
                    if state is not None and len((found := state.advance(None))[0]):
                        yield emit(current, found)
                    current, state = who, Buffers(int(tol[a]))
                side, tt = left[a:b], t[a:b]
                state.add(tt[side], ids[a:b][side], tt[~side], key[a:b][~side])
                if b == n and len((found := state.advance(int(tt[-1])))[0]):  # the block may go on in the next batch
                    yield emit(current, found)
        if state is not None and len((found := state.advance(None))[0]):
            yield emit(current, found)

    return run


def nearest(left: DataFrame, right: DataFrame, *, left_entity: list[Column], left_time: Column, left_id: Column, right_entity: list[Column], right_time: Column, right_key: Column, tolerance_us: Column, block_s: int = 600) -> DataFrame:
    """e0.. (the entity, as text), id, key, distance_us: each left row that has a right record within tolerance.

    tolerance_us must depend on the entity columns only; both sides evaluate it. One shuffle, on entity and block."""
    ship(left.sparkSession)
    names = [f"e{i}" for i in range(len(left_entity))]
    rows = _sides(left, right, [c.cast("string") for c in left_entity], left_time, left_id, [c.cast("string") for c in right_entity], right_time, right_key, tolerance_us, block_s)
    sorted_rows = rows.repartition(*names, "block").sortWithinPartitions(*names, "block", "t")
    return sorted_rows.mapInArrow(_drive(names), ", ".join(f"{n} string" for n in names) + ", id string, key bigint, distance_us bigint")


def nearest_stream(left: DataFrame, right: DataFrame, *, left_entity: Column, left_time: str, left_id: Column, right_entity: Column, right_time: str, right_key: Column, tolerance_s: float, delay: str, block_s: int = 3600) -> DataFrame:
    """The same join over two streams: entity, id, key, distance_us, in append mode.

    ``delay`` is how late a record may come (Spark's watermark). A left record is emitted in the first trigger after
    the watermark passed its horizon; with no match it is dropped."""
    ship(left.sparkSession)
    tolerance = int(tolerance_s * US)
    block = lambda t: F.floor(t / (block_s * US)).cast("bigint")
    lrows = left.select(left_entity.cast("string").alias("entity"), F.col(left_time).alias("at"), left_id.cast("string").alias("id"), F.lit(None).cast("bigint").alias("key"))
    rrows = right.select(right_entity.cast("string").alias("entity"), F.col(right_time).alias("at"), F.lit(None).cast("string").alias("id"), right_key.cast("bigint").alias("key"))
    rows = lrows.unionByName(rrows).dropna(subset=["entity", "at"]).withWatermark("at", delay).withColumn("t", F.unix_micros("at"))
    reach = F.when(F.col("key").isNull(), F.array(block(F.col("t")))).otherwise(F.sequence(block(F.col("t") - tolerance), block(F.col("t") + tolerance)))
    rows = rows.withColumn("block", F.explode(reach))

    def step(who, chunks, state):
        buffers = pickle.loads(state.get[0]) if state.exists else Buffers(tolerance)
        for pdf in chunks:
            side = pdf["id"].notna().to_numpy()
            t = pdf["t"].to_numpy()
            buffers.add(t[side], pdf["id"].to_numpy(dtype=object)[side], t[~side], pdf["key"].to_numpy()[~side].astype(np.int64))
        watermark = state.getCurrentWatermarkMs() * 1000
        found = buffers.advance(watermark)
        if len(buffers.left_t) or len(buffers.right_t):
            state.update((pickle.dumps(buffers),))
            horizon = (int(buffers.left_t.min()) if len(buffers.left_t) else int(buffers.right_t.max())) + tolerance
            state.setTimeoutTimestamp(max(horizon // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"entity": [who[0]] * len(found[0]), "id": found[0], "key": found[1], "distance_us": found[2]})

    return rows.groupBy("entity", "block").applyInPandasWithState(step, "entity string, id string, key bigint, distance_us bigint", "buffers binary", "append", "EventTimeTimeout")
