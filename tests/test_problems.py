"""The general problems' operators on small fixtures: brute force, nulls, ties, repeats, empty tables, clashing names."""

import datetime as dt
import json
import random
from collections import Counter
from decimal import Decimal
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidelake.functions.parsing import floor_div, floor_to, interval_seconds, order_status, utc_timestamp
from tidelake.operators import blocked, change_log, column_profile, late_periods, quotient_dedup, regular_grid, schema_lifespan

UTC = dt.timezone.utc


def at(seconds):
    return dt.datetime.fromtimestamp(seconds, UTC)


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# parsing


def test_utc_timestamp_reads_each_spelling(spark):
    texts = ["2016-01-05 05:46:32.451+09:00", "2016-01-04T20:46:32.451Z", "2016-01-04 20:46:32.451", " 2016-01-04 20:46:32.451 ", "nonsense", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_millis(utc_timestamp(F.col("t"))).alias("m"))
    assert [r["m"] for r in df.collect()] == [1451940392451] * 4 + [None] * 3


def test_floor_of_negatives(spark):
    r = spark.createDataFrame([(-1,), (0,), (3599,), (3600,)], "x bigint").select(floor_to(F.col("x"), 3600).alias("a"), floor_div(F.col("x"), 3600).alias("b")).collect()
    assert [(x["a"], x["b"]) for x in r] == [(-3600, -1), (0, 0), (0, 0), (3600, 1)]


def test_interval_and_status(spark):
    r = spark.createDataFrame([("1m",), ("4h",), ("x",), ("0m",), (None,)], "t string").select(interval_seconds(F.col("t")).alias("s")).collect()
    assert [x["s"] for x in r] == [60, 14400, None, None, None]
    rows = [(" NEW", None), ("partially-filled", None), ("CANCELLED", "ORDER_NEW"), (None, "ORDER_FILLED"), ("??", "ORDER_DELETED"), (None, None), ("", "")]
    r = spark.createDataFrame(rows, "s string, e string").select(order_status(F.col("s"), F.col("e")).alias("o")).collect()
    assert [x["o"] for x in r] == ["NEW", "PARTIALLY_FILLED", "CANCELED", "FILLED", "DELETED", None, None]


@pytest.mark.parametrize("block", [1, 7, 1000])
@pytest.mark.parametrize("ahead", [False, True])
def test_neighbour_is_lag_and_lead(spark, block, ahead):
    rng = random.Random(5)
    rows = [(k, o, o * 2) for k in "ab" for o in rng.sample(range(-200, 200), 60)]
    df = blocked.neighbour(spark.createDataFrame(rows, "k string, o bigint, v bigint"), ["k"], "o", ["v"], block, "n", ahead)
    want = {}
    for k in "ab":
        own = sorted(o for x, o, _ in rows if x == k)
        want |= {(k, o): (own[i + (1 if ahead else -1)] if 0 <= i + (1 if ahead else -1) < len(own) else None) for i, o in enumerate(own)}
    assert {(r["k"], r["o"]): r["n"]["o"] if r["n"] else None for r in df.collect()} == want


def test_neighbour_of_nothing(spark):
    assert blocked.neighbour(spark.createDataFrame([], "k string, o bigint"), ["k"], "o", [], 5, "n").count() == 0


# 1 late events

P = late_periods.Periods(3600, 6 * 3600, 3600)


def test_cut_off_is_inclusive_and_diverts_after(spark):
    bound = 3600 + 6 * 3600
    rows = [("in", at(10), at(bound)), ("late", at(10), at(bound + 0.000001)), ("early", at(10), at(0)), ("no time", None, at(5)), ("no arrival", at(10), None)]
    df = late_periods.assign(spark.createDataFrame(rows, "k string, t timestamp, a timestamp"), P, F.col("t"), F.col("a"))
    assert {r["k"]: r["_diverted"] for r in df.collect()} == {"in": False, "late": True, "early": False, "no time": None, "no arrival": None}


def test_counts_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        t = rng.randrange(0, 40 * 3600)
        for _ in range(rng.choice([1, 1, 2, 3])):
            rows.append((rng.choice(["x", "y", None]) if i % 50 == 0 else "xy"[i % 2], i, None if rng.random() < 0.03 else at(t), None if rng.random() < 0.03 else at(t + rng.expovariate(1 / 9000)), "s%d" % (i % 3)))
    df = spark.createDataFrame(rows, "symbol string, id bigint, t timestamp, a timestamp, src string")
    once = late_periods.first_arrivals(df, {"symbol": F.col("symbol"), "id": F.col("id")}, F.col("t"), F.col("a"), F.col("src"))
    out = late_periods.aggregate(late_periods.assign(once, P, F.col("event_time"), F.col("arrival")), P, ["symbol"])
    first = {}
    for s, i, t, a, _ in rows:
        if t and a and ((s, i) not in first or (a, t) < first[s, i]):
            first[s, i] = (a, t)
    want = Counter()
    late = Counter()
    for (s, _), (a, t) in first.items():
        h = int(t.timestamp()) // 3600 * 3600
        (want if a.timestamp() <= h + 3600 * 7 else late)[s, h] += 1
    assert {(r["symbol"], r["period_epoch"]): (r["counted"], r["diverted"]) for r in out.collect()} == {k: (want[k], late[k]) for k in {*want, *late}}


def test_watermarks_settle_as_the_cut_off_does(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for i in range(500):
        t = rng.randrange(0, 60 * 3600)
        for _ in range(rng.choice([1, 1, 2])):
            rows.append((rng.choice(["x", "y", None]), i, None if rng.random() < 0.03 else at(t), None if rng.random() < 0.03 else at(min(t + rng.expovariate(1 / 12000), 63 * 3600) // 600 * 600), rng.choice(["a", "b", None])))
    df = spark.createDataFrame(rows, "symbol string, id bigint, t timestamp, a timestamp, src string")
    once = late_periods.first_arrivals(df, {"symbol": F.col("symbol"), "id": F.col("id")}, F.col("t"), F.col("a"), F.col("src"))
    whole = late_periods.corrected(df, once, P, ["symbol"], F.col("a"), F.col("src"), f"file://{tmp_path}/w").collect()
    plain = late_periods.aggregate(late_periods.assign(once, P, F.col("event_time"), F.col("arrival")), P, ["symbol"])
    figures = lambda rs: {(r["symbol"], r["period_epoch"]): (r["counted"], r["diverted"]) for r in rs}
    assert figures(whole) == figures(plain.collect()) and sum(r["diverted"] for r in whole) > 20
    # while the input goes on, a period is in no row before every source has passed it or was excused
    running = late_periods.corrected(df, once, P, ["symbol"], F.col("a"), F.col("src"), f"file://{tmp_path}/r", end_of_input=False).collect()
    last = max(r[3] for r in rows if r[3])
    assert 0 < len(running) < len(whole) and set(figures(running).items()) <= set(figures(whole).items())
    assert all(at(r["period_epoch"] + 7 * 3600).replace(tzinfo=None) < r["closed_at"] <= last.replace(tzinfo=None) for r in running)
    assert late_periods.corrected(df.limit(0), once.limit(0), P, ["symbol"], F.col("a"), F.col("src"), f"file://{tmp_path}/e").count() == 0


def test_period_closes_with_its_last_source_or_the_timeout(spark):
    bound = 7 * 3600
    rows = [("a", at(100), at(200)), ("a", at(3700), at(bound + 60)), ("b", at(120), at(300)), ("b", at(3800), at(bound + 900)), ("a", at(30), at(bound + 9000)), ("b", at(40), at(bound + 9500))]
    df = spark.createDataFrame(rows, "s string, t timestamp, a timestamp")
    first = {r["period_epoch"]: r for r in late_periods.closings(df, P, F.col("t"), F.col("a"), F.col("s")).collect()}
    assert first[0]["closed_at"].timestamp() == at(bound + 900).replace(tzinfo=None).timestamp()
    assert (first[0]["sources_passed"], first[0]["last_source"]) == (2, "b")
    quiet = spark.createDataFrame([*rows[:3], ("a", at(30), at(bound + 9000))], "s string, t timestamp, a timestamp")  # b falls silent
    r = {r["period_epoch"]: r for r in late_periods.closings(quiet, P, F.col("t"), F.col("a"), F.col("s")).collect()}[0]
    assert r["sources_excused"] == 1 and r["closed_at"] == at(bound + 3600).replace(tzinfo=None)
    assert late_periods.closings(quiet.limit(0), P, F.col("t"), F.col("a"), F.col("s")).count() == 0


# 2 duplicates


def test_split_is_undone_and_keeps_identifiers_apart(spark):
    rng = random.Random(2)
    ids = [0, 1, -1, 2**63 - 1, -(2**63)] + [rng.randrange(-(2**63), 2**63) for _ in range(2000)]
    df = spark.createDataFrame([(i, s) for i in ids for s in ("A", None)], "i bigint, s string")
    cut = quotient_dedup.split(df, "i", "s").withColumnRenamed("i", "was")
    back = quotient_dedup.restore(cut, "i", "s")
    assert back.filter("i <> was").count() == 0
    assert cut.select("s", "_q", "_r").distinct().count() == len(ids) * 2


def test_occurrences_and_keep_first(spark):
    rows = [("A", 1, 5), ("A", 1, 3), ("A", 1, 3), ("B", 1, 9), (None, 1, 2), (None, 1, 1), ("A", None, 7), ("A", None, 7)]
    df = spark.createDataFrame(rows, "space string, identifier bigint, _q int")  # clashing names
    n = quotient_dedup.occurrences(df, F.col("space"), F.col("identifier"))
    assert {(r["space"], r["identifier"]): r["n"] for r in n.collect()} == {("A", 1): 3, ("B", 1): 1, (None, 1): 2}
    kept = quotient_dedup.keep_first(df, F.col("space"), F.col("identifier"), [F.col("_q")])
    assert kept.columns == df.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter({("A", 1, 3): 1, ("B", 1, 9): 1, (None, 1, 1): 1, ("A", None, 7): 2})
    assert quotient_dedup.keep_first(df.limit(0), F.col("space"), F.col("identifier"), [F.col("_q")]).count() == 0


def test_index_over_batches_and_replay(spark, tmp_path):
    index = quotient_dedup.QuotientIndex(spark, f"file://{tmp_path}/ids")
    batch = lambda rows: spark.createDataFrame(rows, "s string, id bigint, v string")
    ins = lambda b, n: got(index.insert(b, n, F.col("s"), F.col("id"), [F.col("v")]), "s", "id", "v")
    assert ins(batch([("A", 1, "x"), ("A", 1, "y"), ("A", 2, "x")]), 0) == [("A", 1, "x"), ("A", 2, "x")]
    second = batch([("A", 2, "z"), ("A", 3, "q"), ("B", 1, "r")])
    assert ins(second, 1) == ins(second, 1) == [("A", 3, "q"), ("B", 1, "r")]
    assert ins(batch([("A", 3, "k")]), 2) == []
    index.compact()
    fresh = index.insert(batch([("A", 3, "k"), (None, 3, "k"), ("A", 9, "k"), ("B", 2, "m"), ("B", None, "m")]), 3, F.col("s"), F.col("id"), [F.col("v")]).collect()
    assert {(r["s"], r["id"]) for r in fresh} == {(None, 3), ("A", 9), ("B", 2)} and len(fresh) == 3
    assert sorted((r["space"] or "", r["identifier"], r["n"]) for r in index.stored().collect()) == [("", 3, 1), ("A", 1, 1), ("A", 2, 1), ("A", 3, 1), ("A", 9, 1), ("B", 1, 1), ("B", 2, 1)]


def test_stored_counts_of_identifiers(spark, tmp_path):
    rows = [("A", 5), ("A", 5), ("B", 5), (None, 5), (None, 5), (None, 5), ("A", None), ("A", -(2**63)), ("A", 2**63 - 1)]
    index = quotient_dedup.QuotientIndex(spark, f"file://{tmp_path}/ids")
    assert index.stored().count() == 0
    df = spark.createDataFrame(rows, "s string, id bigint").withColumn("n", F.lit("clash")).withColumn("space", F.lit("clash"))
    index.count(df, "all", F.col("s"), F.col("id"))
    want = Counter((s, i) for s, i in rows if i is not None)
    assert {(r["space"], r["identifier"]): r["n"] for r in index.stored().collect()} == want
    empty = quotient_dedup.QuotientIndex(spark, f"file://{tmp_path}/none")
    empty.count(df.limit(0), "all", F.col("s"), F.col("id"))
    assert empty.stored().count() == 0


# 3 schema drift


def kinds(message):
    try:
        d = json.loads(message)
    except (TypeError, ValueError):
        return None
    if not isinstance(d, dict):
        return None
    name = lambda v: None if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array"
    return {k: name(v) for k, v in d.items()}


def drift_by_hand(rows):
    alias = {a: own for own, others in schema_lifespan.BAR_ALIASES.items() for a in [own, *others]}
    out = set()
    for p in {r[0] for r in rows if r[0] is not None}:
        before, known = None, {}
        for o, m in sorted({(r[1], r[2]) for r in rows if r[0] == p and r[1] is not None and r[2] is not None}):
            now = kinds(m)
            if now is None:
                continue
            if before is not None:
                gone, come = sorted(set(before) - set(now)), sorted(set(now) - set(before))
                for g in list(gone):
                    match = next((c for c in come if alias.get(c, c) == alias.get(g, g)), None)
                    if match:
                        out.add((p, o, g, "renamed"))
                        gone.remove(g)
                        come.remove(match)
                out |= {(p, o, g, "removed") for g in gone} | {(p, o, c, "added") for c in come}
                out |= {(p, o, f, "retyped") for f, k in now.items() if k and f in before and known.get(f) and known[f] != k}
            known |= {f: k for f, k in now.items() if k}
            before = now
    return out


@pytest.mark.parametrize("block", [3, 50_000])
def test_changes_against_brute_force(spark, block):
    rng = random.Random(3)
    rows = []
    for p in (0, 1, 2):
        shape = {"open_time": "1", "volume": "2", "x": 1, "tags": ["a"]}
        for o in range(120):
            if rng.random() < 0.2:
                f = rng.choice(list(shape) + ["y", "z"])
                shape = {("vol" if k == "volume" else "volume" if k == "vol" else k) if rng.random() < 0.3 else k: v for k, v in shape.items()}
                if f in shape and rng.random() < 0.5 and len(shape) > 1:
                    del shape[f]
                else:
                    shape[f] = rng.choice(["s", 1.5, 7, True, {"a": {"b": 1}}, [1], 10**20])
            m = json.dumps({k: None if rng.random() < 0.1 else v for k, v in shape.items()})
            m = rng.choice([m] * 20 + [m[:-3], "", None, "[1]", "7", "null"])
            rows += [(p, o, m)] * rng.choice([1, 1, 1, 2])
    rows += [(None, 1, "{}"), (5, None, "{}"), (6, 1, "broken")]
    df = spark.createDataFrame(rows, "kafka_partition int, kafka_offset bigint, message_value string").withColumn("field", F.lit("clash"))
    out = schema_lifespan.changes(df, ["kafka_partition"], "kafka_offset", "message_value", block=block)
    assert {tuple(r) for r in out.collect()} == drift_by_hand(rows)
    assert out.count() == len(drift_by_hand(rows))
    assert schema_lifespan.changes(df.limit(0), ["kafka_partition"], "kafka_offset", "message_value").count() == 0


def test_changes_on_the_test_table(spark, data):
    from tidelake.plans import problems

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/raw_klines.parquet").select("kafka_partition", "kafka_offset", "message_value").collect()]
    assert {tuple(r) for r in problems.p3_found(spark, data).collect()} == drift_by_hand(rows)


def test_unify_reads_aliases_and_casts(spark):
    rows = [('{"t_open": "60000", "vol": 3, "is_final": true}',), ('{"open_time": 120000, "volume": "x", "closed": "false"}',), ("broken{",), (None,)]
    df = schema_lifespan.unify(spark.createDataFrame(rows, "message_value string"), "message_value", {"open_time": "timestamp", "volume": "decimal(20,8)", "is_closed": "boolean"})
    out = [(r["open_time"] and r["open_time"].timestamp() - dt.datetime(1970, 1, 1).timestamp(), r["volume"], r["is_closed"]) for r in df.collect()]
    assert out == [(60.0, Decimal(3), True), (120.0, None, False), (None, None, None), (None, None, None)]


# 4 regular grid


def grid(spark, rows, silence=86400, hold=None):
    df = spark.createDataFrame(rows, "s string, t timestamp, v double, n int").withColumn("slot_epoch", F.lit(1))
    held = regular_grid.step_intervals(df, {"series": F.col("s")}, F.col("t"), F.lit(60).cast("bigint"), F.col("v"), [F.col("n")])
    return regular_grid.onto_grid(held, ["series"], silence, hold)


def test_grid_fills_weighs_and_covers(spark):
    rows = [("a", at(0), 1.0, 1), ("a", at(30), 3.0, 1), ("a", at(30), 9.0, 0), ("a", at(30), 3.0, 1), ("a", at(190), 5.0, 1), ("a", None, 1.0, 1), (None, at(0), 1.0, 1)]
    out = {r["slot_epoch"]: (r["readings"], r["mean"], round(r["coverage"], 4), r["marked"]) for r in grid(spark, rows).collect()}
    assert out == {0: (2, 2.0, 1.0, "observed"), 60: (0, 3.0, 0.5, "filled"), 120: (0, 3.0, 0.0, "filled"), 180: (1, pytest.approx((3 * 10 + 5 * 50) / 60), pytest.approx(50 / 60, abs=1e-4), "observed")}


def test_long_silence_ends_a_series_and_its_bound_does_not(spark):
    far = grid(spark, [("a", at(59), 1.0, 1), ("a", at(86400), None, 1)]).collect()
    assert len(far) == 86400 // 60 + 1
    apart = grid(spark, [("a", at(59), 1.0, 1), ("a", at(86460), None, 1)]).collect()
    assert sorted(r["slot_epoch"] for r in apart) == [0, 86460] and all(r["readings"] == 1 for r in apart)
    assert grid(spark, []).count() == 0


# 5 profile


def test_profile_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(s, h, None if rng.random() < 0.1 else Decimal(rng.choice([0, -1, 5, 5, 5, rng.randrange(1, 900)])).scaleb(-rng.randrange(3)), rng.choice(["ab1", "ab22", None, ""])) for s in ("x", None) for h in (0, 3600) for _ in range(rng.randrange(40, 90))]
    df = spark.createDataFrame(rows, "symbol string, n bigint, v decimal(20,8), c string")
    counts = column_profile.value_counts(df, {"symbol": F.col("symbol"), "load": F.col("n")}, ["v", "c"], {"c": "^ab\\d$"})
    out = {(r["symbol"], r["load"], r["column_name"]): r for r in column_profile.named(column_profile.profile(counts, ["symbol", "load"]), ["v", "c"]).collect()}
    for s in ("x", None):
        for h in (0, 3600):
            own = [r for r in rows if r[:2] == (s, h)]
            v = [r[2] for r in own if r[2] is not None]
            r = out[s, h, "v"]
            assert (r["rows"], r["nulls"], r["distinct"], r["top"], r["nonpositive"]) == (len(own), len(own) - len(v), len(set(v)), max(Counter(v).values()), sum(x <= 0 for x in v))
            assert r["median"] == pytest.approx(float(median(v))) and (r["low"], r["high"]) == (min(v), max(v))
            c = [r[3] for r in own if r[3] is not None]
            r = out[s, h, "c"]
            assert (r["distinct"], r["violations"], r["median"]) == (len(set(c)), sum(x != "ab1" for x in c), None)


def findings(spark, loads):
    rows = [("s", h, v) for h, vs in loads.items() for v in vs]
    df = spark.createDataFrame(rows, "symbol string, h bigint, v double").select("symbol", "h", F.col("v").cast("decimal(20,8)").alias("v"))
    counts = column_profile.value_counts(df, {"symbol": F.col("symbol"), "load": F.col("h")}, ["v"])
    return got(column_profile.findings(column_profile.profile(counts, ["symbol", "load"]), ["symbol"], "load", 3600), "load", "finding")


def test_findings_at_their_bounds(spark):
    spread = [float(i + 1) for i in range(30)]
    assert findings(spark, {0: [None] * 3 + spread[:27], 3600: [None] * 4 + spread[:26]}) == [(3600, "null_share")]
    assert findings(spark, {0: [0.0] * 2 + spread[:23] + [None] * 5}) == [(0, "null_share")]
    assert findings(spark, {0: [-1.0] * 3 + spread[:27]}) == [(0, "nonpositive_share")]
    assert findings(spark, {0: [7.5] * 12 + spread[:18], 7200: [7.5] * 13 + spread[:17]}) == [(7200, "dominant_value")]
    assert findings(spark, {0: spread, 3600: [v * 5 for v in spread], 7200: [v * 26 for v in spread]}) == [(7200, "median_shift")]
    assert findings(spark, {0: spread, 7200: [v * 9 for v in spread]}) == []
    assert findings(spark, {0: spread[:29], 3600: [v * 9 for v in spread]}) == []
    assert findings(spark, {0: [None] * 30}) == [(0, "null_share")]


def test_drift_index(spark):
    df = spark.createDataFrame([("s", 0, 1.0)] * 8 + [("s", 0, 100.0)] * 2 + [("s", 3600, 1.0)] * 2 + [("s", 3600, 100.0)] * 8, "symbol string, h bigint, v double")
    counts = column_profile.value_counts(df, {"symbol": F.col("symbol"), "load": F.col("h")}, ["v"])
    out = column_profile.drift(counts, ["symbol"], "load", 3600).collect()
    assert [(r["load"], round(r["psi"], 4), r["chi_square"]) for r in out] == [(3600, 1.6636, 7.2)]


# 6 change feed


def feed(spark, rows):
    return spark.createDataFrame(rows, "id string, t timestamp, rank int, off bigint, kind string, st string")


def log_at(spark, path):
    return change_log.ChangeLog(spark, path, ["id"], [F.col("t"), F.col("rank"), F.col("off")], F.col("kind"), ["st", "t"])


def state_by_hand(rows):
    out = {}
    for i in {r[0] for r in rows if r[0] is not None}:
        alive, dead, last = False, False, None
        for r in sorted({r for r in rows if r[0] == i and r[1] is not None and r[4] is not None}, key=lambda r: (r[1], r[2], r[3])):
            if r[4] == "delete":
                alive, dead = False, True
            elif r[4] == "insert" or not dead:
                alive, dead, last = True, False, r[5]
            elif alive:
                last = r[5]
        if alive:
            out[i] = last
    return out


def test_runs_in_any_order_repeated_and_compacted(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for n in range(600):
        kind, rank, st = rng.choice([("insert", 1, "NEW"), ("update", 3, "FILLED"), ("update", 2, "PART"), ("delete", 4, "DELETED")])
        rows.append((f"o{rng.randrange(60)}", at(rng.randrange(50)), rank, n, kind, st))
    rows += rng.sample(rows, 80) + [(None, at(1), 1, 1, "insert", "NEW"), ("o1", None, 1, 1, "insert", "NEW"), ("o2", at(99), 9, 9, None, "??")]
    rng.shuffle(rows)
    log = log_at(spark, f"file://{tmp_path}/log")
    assert log.read() is None
    for k in range(3):
        log.append(feed(spark, rows[k::3]), f"run-{k}", F.col("rank") if k == 1 else None)
    want = state_by_hand(rows)
    now = lambda: {r["id"]: r["st"] for r in log.read().collect()}
    assert now() == want
    log.append(feed(spark, rows[1::3]), "run-1")  # replayed
    log.append(feed(spark, []), "run-empty")
    assert now() == want
    log.compact("run-c")
    assert log.runs() == ["run-c"] and now() == want
    late = [("o3", at(0), 1, 0, "insert", "NEW"), ("new", at(1), 2, 1, "update", "PART")]
    log.append(feed(spark, late), "run-late")
    assert now() == state_by_hand(rows + late)


def test_blocks_of_a_k_way_merge_rise_and_hold_whole_keys():
    import pyarrow as pa

    rng = random.Random(16)
    for _ in range(40):
        runs = [sorted(rng.sample(range(60), rng.randrange(0, 40))) for _ in range(rng.randrange(1, 6))]
        batches = lambda ks: iter([pa.record_batch({"k": pa.array(ks[i : i + 4], pa.int64())}) for i in range(0, len(ks), 4)])
        blocks = [sorted(k for (k,) in keys) for _, keys in change_log.merge_runs([batches(r) for r in runs], ["k"])]
        assert sorted(k for b in blocks for k in b) == sorted(k for r in runs for k in r)
        assert all(a[-1] < b[0] for a, b in zip(blocks, blocks[1:], strict=False))


def test_json_fields_take_whole_objects_only(spark):
    from tidelake.functions.parsing import json_fields

    texts = ['{"a": 1, "b": {"c": [2]}} ', '{"a": "x"', '{"a": 1} tail', "[1]", "7", "", None, '{"a": null}', '{"a": 1, "a": 2}']
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(json_fields(F.col("t"), ["a", "b"]).alias("r")).collect()
    assert [r["r"] and (r["r"]["a"], r["r"]["b"]) for r in out] == [("1", '{"c":[2]}'), None, None, None, None, None, None, (None, None), ("2", None)]


def test_loads_profiled_together_or_spread_are_the_same(spark, tmp_path):
    rng = random.Random(55)
    rows = []
    for load, n in (("a", 400), ("b", 7), (None, 60), ("c", 1)):
        for _ in range(n):
            v = rng.choice([None, Decimal("5"), Decimal("5"), Decimal(rng.randrange(-300, 10**rng.randrange(1, 9))).scaleb(-4)])
            rows.append((load, v, rng.choice([None, "ab1", "zz", ""]), rng.choice([1.5, float("nan"), None, -2.0])))
    df = spark.createDataFrame(rows, "l string, v decimal(20,8), t string, d double").withColumn("num", F.lit("clash"))
    n = iter(range(100))
    figures = lambda hot: sorted(str(tuple(r)) for r in column_profile.profile_loads(df, {"load": F.col("l")}, ["v", "t", "d"], lambda label: f"file://{tmp_path}/{label}-{next(n)}", {"t": "^ab"}, hot_rows=hot).select("load", "column_id", "rows", "nulls", "nonpositive", "distinct", "top", "low", "high", "low_text", "high_text", "violations", "median", F.round("mean", 6)).collect())
    together = figures(10**9)
    assert len(together) == 12 and together == figures(50) == figures(0)
    for name in ("a", "b", None):
        values = sorted(r[1] for r in rows if r[0] == name and r[1] is not None)
        mine = next(r for r in together if r.startswith(f"({name!r}, 0, "))
        assert f", {float(median(values))!r}, " in mine
    assert column_profile.profile_loads(df.limit(0), {"load": F.col("l")}, ["v"], lambda label: f"file://{tmp_path}/{label}-e", hot_rows=0).count() == 0


def test_beside_against_brute_force_from_one_exchange(spark):
    rng = random.Random(56)
    rows = [(k, o, rng.choice([None, "p", "q"])) for k in ("x", "y") for o in rng.sample(range(-500, 500), 120)] + [(None, 1, "p"), ("x", None, "p")]
    df = spark.createDataFrame(rows, "k string, o bigint, v string").withColumn("extra", F.lit(1))
    out = blocked.beside(df.groupBy("k", "o", "v").agg(F.max("extra").alias("extra")), ["k"], "o", ["v"], 37, before="b", after="a", known=("v", "last"))
    have = {(r["k"], r["o"]): (r["b"] and tuple(r["b"]), r["a"] and tuple(r["a"]), r["last"]) for r in out.collect()}
    want = {}
    for key in ("x", "y"):
        line = sorted((o, v) for k, o, v in rows if k == key and o is not None)
        for i, (o, _) in enumerate(line):
            want[key, o] = (line[i - 1] if i else None, line[i + 1] if i + 1 < len(line) else None, next((v for _, v in reversed(line[:i]) if v), None))
    assert have == want
    narrow = blocked.neighbour(df.groupBy("k", "o").agg(F.max("extra").alias("extra")), ["k"], "o", [], 37, "b").select("k", "o", "b")
    narrow.collect()
    plan = narrow._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("Scan") == 1
    assert blocked.beside(df.limit(0), ["k"], "o", [], 5, before="b").count() == 0
