"""The quality scan: freshness, schema, sequence and value rules over one table, as its configuration says, in one frame of events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.operators import quality
from tidelake.store import Table


@dataclass(frozen=True)
class ScanConfig:
    """What is looked at, and how strictly.

    dimension: the column by which sequences and freshness are judged; sequence: a column of whole numbers that should
    have no gaps of over max_missing members, step apart; order: the column of arrival, along which the sequence should
    not fall; fields: columns that should be neither null nor zero; expected: columns and their types. Freshness is
    judged by lags (a table of lag_label and lag_ms) where ``freshness`` is 'lag', by the age of the last event in
    event_time where it is 'event'; '' leaves it out."""

    dimension: str = "symbol"
    sequence: str = "trade_id"
    step: int = 1
    max_missing: int = 0
    order: str = "produce_ts"
    fields: tuple[str, ...] = ("price", "qty")
    expected: Mapping[str, str] = field(default_factory=dict)
    freshness: str = "lag"
    lag_label: str = "config_label"
    lag_column: str = "lag_ms"
    event_time: str | None = None
    sla_ms: float = 15_000.0


#: The measured stream, and the tables of the pipeline.
STREAM = ScanConfig(expected={"produce_ts": "bigint", "trade_id": "string", "price": "string", "qty": "string", "symbol": "string", "run_id": "string"})
TRADES = ScanConfig(order="source_offset", freshness="event", event_time="trade_time", sla_ms=3_600_000.0)


def of_run(df: DataFrame, run_id: str | None) -> DataFrame:
    """The rows of one run, where a run is asked for and the table knows runs."""
    return df.filter(F.col("run_id") == run_id) if run_id and "run_id" in df.columns else df


def ages(rows: DataFrame, dimension: str, event_time: str, now: Column) -> DataFrame:
    """dimension, age_ms: time from the last event to now. Without any event time the age is null."""
    last = rows.groupBy(F.col(dimension).alias("dimension")).agg(F.max(F.unix_millis(F.col(event_time).cast("timestamp"))).alias("_last"))
    return last.select("dimension", (F.unix_millis(now) - F.col("_last")).alias("age_ms"))


def scan(rows: DataFrame, name: str, config: ScanConfig, lags: DataFrame | None = None, run_id: str | None = None, now: dt.datetime | None = None) -> DataFrame:
    """All anomalies of a table: freshness, then schema, gaps, reversals, nulls and zeros. Columns as quality.ANOMALY.

    The schema is that of the whole table; everything else is judged within the run, if one is given. now: the moment
    that ages are counted to, by default the present."""
    part = of_run(rows, run_id)
    found = []
    if config.freshness == "lag" and lags is not None:
        found.append(quality.freshness(quality.lag_percentiles(of_run(lags, run_id), [config.lag_label], config.lag_column), config.lag_label, "p95", "high", config.sla_ms))
    elif config.freshness == "event" and config.event_time:
        at = F.lit(now) if now else F.current_timestamp()
        found.append(quality.freshness(ages(part, config.dimension, config.event_time, at), "dimension", "age_ms", "age_ms", config.sla_ms))
    if config.expected:
        found.append(quality.schema_drift(rows, name, config.expected))
    found.append(quality.gaps(part, config.dimension, config.sequence, config.step, config.max_missing))
    found.append(quality.reversals(part, config.dimension, config.order, config.sequence))
    if config.fields:
        found.append(quality.null_or_zero(part, name, list(config.fields)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def run(rows: DataFrame, name: str, config: ScanConfig, target: Table, run_id: str, **how) -> int:
    """Scans, stamps and appends the events; without any nothing is written. Gives their number."""
    before = {p.path for p in target.parts()}
    target.append(quality.stamp(scan(rows, name, config, run_id=run_id, **how), run_id, name), token=f"{run_id}:{name}")
    return sum(p.rows for p in target.parts() if p.path not in before)
