"""Quality rules as DataFrames of anomalies with one schema. Nothing is collected; neighbours come from ``blocked``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.operators.blocked import neighbour
from tidelake.operators.column_profile import magnitude_bin

CRITICAL, WARN = "CRITICAL", "WARN"
#: Columns of an anomaly before it is stamped.
ANOMALY = ["check_name", "severity", "dimension", "observed", "threshold", "detail"]


def _anomaly(df: DataFrame, check: str, severity: Column, dimension: Column, observed: Column, threshold: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check_name"), severity.alias("severity"), dimension.cast("string").alias("dimension"), observed.cast("double").alias("observed"), threshold.cast("double").alias("threshold"), detail.alias("detail"))


def freshness(lags: DataFrame, label: str, p95: str, worst: str, sla: float) -> DataFrame:
    """CRITICAL where p95 exceeds the bound, else WARN where the worst does; at the bound is fine, nulls are silent."""
    critical, warn = F.col(p95) > sla, F.col(worst) > sla
    bad = lags.filter(F.coalesce(critical, F.lit(False)) | F.coalesce(warn, F.lit(False)))
    severe = F.coalesce(critical, F.lit(False))
    observed = F.when(severe, F.col(p95)).otherwise(F.col(worst))
    return _anomaly(bad, "FRESHNESS_SLA", F.when(severe, CRITICAL).otherwise(WARN), F.col(label), observed, F.lit(sla), F.concat(F.lit("lag "), observed.cast("string"), F.lit(" over "), F.lit(str(sla))))


def lag_percentiles(samples: DataFrame, by: list[str], lag: str = "lag_ms") -> DataFrame:
    """samples, p50, p95, p99, low, high of a lag by group; a percentile is the least value that so many of the samples do not exceed.

    Exact at any size, from value counts: sums over magnitude bins name the bin of each rank, and only these are sorted."""
    percents = (50, 95, 99)
    counts = samples.groupBy(*by, F.col(lag).alias("_v")).agg(F.count(lag).alias("_n")).withColumn("_bin", magnitude_bin(F.col("_v")))
    out = counts.groupBy(*by).agg(F.sum("_n").alias("samples"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    bins = counts.filter("_bin is not null").groupBy(*by, "_bin").agg(F.sum("_n").alias("_in"))
    bins = bins.withColumns({"_upto": F.sum("_in").over(Window.partitionBy(*by).orderBy("_bin")), "_all": F.sum("_in").over(Window.partitionBy(*by))})
    bins = bins.withColumn("_below", F.col("_upto") - F.col("_in")).select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(by)], F.col("_bin").alias("_b"), "_below", "_upto", *[F.expr(f"({p} * _all + 99) div 100").alias(f"_r{p}") for p in percents])
    bins = bins.filter(" or ".join(f"_r{p} > _below and _r{p} <= _upto" for p in percents)).drop("_upto")
    same = F.col("_bin") == F.col("_b")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_b{i}"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_bin").orderBy("_v")) + F.col("_below")
    found = counts.join(bins, same).withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_n"))
    ranked = found.groupBy(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(by)]).agg(*[F.max(F.when((F.col("_from") < F.col(f"_r{p}")) & (F.col("_to") >= F.col(f"_r{p}")), F.col("_v"))).alias(f"p{p}") for p in percents])
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_b{i}"))
    return out.join(ranked, same, "left").select(*by, "samples", *[f"p{p}" for p in percents], "low", "high")


def gap_segments(ids: DataFrame, dimension: str, column: str, step: int = 1, block: int = 100_000) -> DataFrame:
    """dimension, before, after, missing: stretches of a sequence of integers with missing members. Duplicates and order don't matter."""
    if step <= 0:
        raise ValueError("step must be positive")
    once = ids.select(dimension, F.col(column).cast("bigint").alias("_id")).dropna().distinct()
    pairs = neighbour(once, [dimension], "_id", [], block * step, "_before").filter("_before is not null")
    missing = F.expr(f"(_id - _before._id) div {step} - 1")
    return pairs.select(dimension, F.col("_before._id").alias("before"), F.col("_id").alias("after"), missing.alias("missing")).filter("missing > 0")


def gaps(ids: DataFrame, dimension: str, column: str, step: int = 1, max_missing: int = 0) -> DataFrame:
    """One CRITICAL anomaly per stretch with more than max_missing members missing."""
    bad = gap_segments(ids, dimension, column, step).filter(F.col("missing") > max_missing)
    return _anomaly(bad, "GAP", F.lit(CRITICAL), F.col(dimension), F.col("missing"), F.lit(max_missing), F.concat_ws(" ", F.lit("missing between"), F.col("before").cast("string"), F.lit("and"), F.col("after").cast("string")))


def reversal_counts(rows: DataFrame, dimension: str, order: str, column: str, block: int = 100_000) -> DataFrame:
    """dimension, reversals, first_before, first_after: how often a value falls along an order (bigint; ties are taken by the value)."""
    base = rows.select(dimension, F.col(order).cast("bigint").alias("_o"), F.col(column).cast("bigint").alias("_v")).dropna()
    # within one place of the order values rise, so only each place's lowest and highest can meet a neighbour
    ends = base.groupBy(dimension, "_o").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    pairs = neighbour(ends, [dimension], "_o", ["_high"], block, "_before")
    falls = F.col("_low") < F.col("_before._high")
    return pairs.groupBy(dimension).agg(F.count_if(falls).alias("reversals"), F.min(F.when(falls, F.struct("_o", F.col("_before._high").alias("b"), F.col("_low").alias("a")))).alias("_f")).select(dimension, "reversals", F.col("_f.b").alias("first_before"), F.col("_f.a").alias("first_after"))


def reversals(rows: DataFrame, dimension: str, order: str, column: str) -> DataFrame:
    """One WARN per dimension with any reversal, showing the first."""
    bad = reversal_counts(rows, dimension, order, column).filter("reversals > 0")
    return _anomaly(bad, "ORDER_REVERSAL", F.lit(WARN), F.col(dimension), F.col("reversals"), F.lit(0), F.concat_ws(" ", F.lit("first:"), F.col("first_before").cast("string"), F.lit("then"), F.col("first_after").cast("string")))


def null_or_zero_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, nulls, zeros, total in one pass. A text that is no number counts as zero."""
    counts = [F.struct(F.lit(c).alias("field"), F.count_if(df[c].isNull()).alias("nulls"), F.count_if(df[c].isNotNull() & F.coalesce(df[c].cast("string").try_cast("double") == 0, F.lit(True))).alias("zeros"), F.count("*").alias("total")) for c in fields]
    return df.agg(F.array(*counts).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def null_or_zero(df: DataFrame, table: str, fields: list[str]) -> DataFrame:
    """One CRITICAL anomaly per field with nulls or zeros."""
    bad = null_or_zero_counts(df, fields).filter("nulls + zeros > 0")
    return _anomaly(bad, "NULL_OR_ZERO", F.lit(CRITICAL), F.concat(F.lit(f"{table}."), F.col("field")), F.col("nulls") + F.col("zeros"), F.lit(0), F.concat_ws(" ", F.col("nulls").cast("string"), F.lit("null,"), F.col("zeros").cast("string"), F.lit("zero")))


def schema_drift(df: DataFrame, table: str, expected: Mapping[str, str]) -> DataFrame:
    """Missing and retyped columns are CRITICAL, extra ones WARN. Reads the schema only."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(CRITICAL, c, f"missing, expected {t}") for c, t in expected.items() if c not in actual]
    rows += [(CRITICAL, c, f"{actual[c]} instead of {t}") for c, t in expected.items() if c in actual and actual[c] != t]
    rows += [(WARN, c, f"extra {t}") for c, t in actual.items() if c not in expected]
    made = df.sparkSession.createDataFrame(rows, "severity string, field string, detail string")
    return _anomaly(made, "SCHEMA_DRIFT", F.col("severity"), F.concat(F.lit(f"{table}."), F.col("field")), F.lit(1), F.lit(0), F.col("detail"))


def stamp(anomalies: DataFrame, run_id: str, source_table: str) -> DataFrame:
    """quality_events rows: the anomaly with id, time, run and table."""
    return anomalies.select(F.uuid().alias("event_id"), F.current_timestamp().alias("detected_at"), F.lit(run_id).alias("run_id"), F.lit(source_table).alias("source_table"), *ANOMALY)


def table_check(df: DataFrame, table: str, keys: list[str], required: list[str], time: str | None = None, window: tuple[str, str] | None = None) -> DataFrame:
    """table_name, row_count, null_count, duplicate_count, check_status in a business-time window [start, end).

    null_count: rows with any required column null. duplicate_count: rows less distinct non-null keys (the key's parts
    joined, nulls skipped). No rows is a PASS."""
    if window and time:
        df = df.filter((F.col(time) >= F.lit(window[0]).cast("timestamp")) & (F.col(time) < F.lit(window[1]).cast("timestamp")))
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys]) if len(keys) > 1 else F.col(keys[0])
    absent = F.lit(False)
    for c in required:
        absent = absent | F.col(c).isNull()
    # distinct keys by grouping first: a count(distinct) would meet in one task
    per_key = df.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"), F.count_if(absent).alias("_null"))
    out = per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("_null"), F.lit(0)).alias("null_count"), F.count("_key").alias("_keys"))
    dup = F.col("row_count") - F.col("_keys")
    return out.select(F.lit(table).alias("table_name"), "row_count", "null_count", dup.alias("duplicate_count"), F.when((F.col("null_count") > 0) | (dup > 0), "FAIL").otherwise("PASS").alias("check_status"))


def checks_by_day(df: DataFrame, table: str, keys: list[str], required: list[str], time: str) -> DataFrame:
    """data_quality_summary rows, one a day of the table's business time, as table_check() counts them; checked at the day's end. Rows without a time are in no day."""
    rows = df.withColumn("_day", F.date_trunc("day", F.col(time).cast("timestamp"))).filter("_day is not null")
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys]) if len(keys) > 1 else F.col(keys[0])
    absent = F.lit(False)
    for c in required:
        absent = absent | F.col(c).isNull()
    per_key = rows.groupBy("_day", key.alias("_key")).agg(F.count("*").alias("_n"), F.count_if(absent).alias("_null"))
    out = per_key.groupBy("_day").agg(F.sum("_n").alias("row_count"), F.sum("_null").alias("null_count"), F.count("_key").alias("_keys"))
    dup, day, after = F.col("row_count") - F.col("_keys"), F.date_format("_day", "yyyy-MM-dd"), F.col("_day") + F.expr("interval 1 day")
    return out.select(
        F.concat(F.lit("daily-"), day).alias("run_id"), after.alias("checked_at"), F.lit(table).alias("table_name"), F.lit("rows_nulls_duplicates").alias("check_name"), F.when((F.col("null_count") > 0) | (dup > 0), "FAIL").otherwise("PASS").alias("check_status"),
        "row_count", "null_count", dup.alias("duplicate_count"), F.concat(F.lit(f"{time} in ["), day, F.lit(", "), F.date_format(after, "yyyy-MM-dd"), F.lit(")")).alias("warning_message"),
    )


def webhook(url: str, timeout_s: float = 5.0):
    """A post for send_alert(): the text as JSON to an address."""
    import json
    from urllib.request import Request, urlopen

    def post(text: str) -> None:
        request = Request(url, json.dumps({"text": text}).encode(), {"Content-Type": "application/json"})
        with urlopen(request, timeout=timeout_s) as answer:
            if answer.status >= 300:
                raise OSError(f"answered {answer.status}")

    return post


def alert_text(anomalies: list[Mapping], limit: int = 10) -> str:
    """A message from anomalies already brought to the driver: counts, the first few lines, how many are left."""
    if not anomalies:
        return "All checks passed."
    severe = sum(a["severity"] == CRITICAL for a in anomalies)
    lines = [f"{len(anomalies)} anomalies, {severe} CRITICAL"] + [f"{a['severity']} {a['check_name']} {a['dimension']}: {a['detail']}" for a in anomalies[:limit]]
    return "\n".join(lines + ([f"and {len(anomalies) - limit} more"] if len(anomalies) > limit else []))


def send_alert(anomalies: list[Mapping], post=None) -> dict:
    """Sends alert_text through ``post`` (a callable); says why it did not."""
    if not anomalies:
        return {"sent": False, "reason": "no_anomalies"}
    if post is None:
        return {"sent": False, "reason": "no_webhook_configured"}
    try:
        post(alert_text(anomalies))
    except Exception as error:  # noqa: BLE001  an alert must not end the job
        return {"sent": False, "reason": f"failed: {error}"}
    return {"sent": True, "reason": "ok"}
