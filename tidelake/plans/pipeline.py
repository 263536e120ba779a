"""Jobs in order, with a run log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import SparkSession

from tidelake.store import Table

#: Job: the jobs it needs. Trades and bars make the market hours, which the order hours need.
DAILY = {
    "processed_trades": [],
    "staging_klines": [],
    "staging_orders": [],
    "processed_klines": ["staging_klines"],
    "processed_orders": ["staging_orders"],
    "market_hourly_summary": ["processed_trades", "processed_klines"],
    "order_execution_summary": ["processed_orders", "market_hourly_summary"],
    "data_quality": ["market_hourly_summary", "order_execution_summary"],
    "table_health": ["data_quality"],
}


def in_order(needs: dict[str, list[str]] = DAILY) -> list[str]:
    """Every job after those it needs; refuses a circle."""
    out: list[str] = []
    while len(out) < len(needs):
        ready = [j for j, n in needs.items() if j not in out and all(x in out for x in n)]
        if not ready:
            raise ValueError("the jobs need each other in a circle")
        out += ready
    return out


@contextmanager
def logged(runs: Table, run_id: str, pipeline: str, task: str, source: str | None = None, target: str | None = None):
    """Runs a job and appends its record, whether it succeeds or fails. The job may set ``rows`` in the yielded dict."""
    spark: SparkSession = runs.spark
    start, note = dt.datetime.now(dt.timezone.utc), {"rows": None}
    status, error = "SUCCESS", None
    try:
        yield note
    except Exception as e:
        status, error = "FAILED", str(e)[:1000]
        raise
    finally:
        end = dt.datetime.now(dt.timezone.utc)
        row = (run_id, pipeline, task, status, start, end, int((end - start).total_seconds()), source, target, note["rows"], error, end)
        runs.append(spark.createDataFrame([row], runs.spec.schema))


def run_all(jobs: dict[str, Callable[[], None]], runs: Table, run_id: str, pipeline: str = "daily") -> None:
    """Runs jobs in order, each logged; the first failure ends the run."""
    for name in in_order({j: [n for n in DAILY.get(j, []) if n in jobs] for j in jobs}):
        with logged(runs, run_id, pipeline, name, target=name):
            jobs[name]()


def run_sql(spark: SparkSession, script: str) -> None:
    """Runs the statements of a script one after another; semicolons in quotes or comments don't split."""
    statement, quote, i = "", "", 0
    while i < len(script):
        c = script[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif script.startswith("--", i):
            i = script.find("\n", i) if "\n" in script[i:] else len(script)
            continue
        elif c == ";":
            if statement.strip():
                spark.sql(statement)
            statement = ""
            i += 1
            continue
        statement += c
        i += 1
    if statement.strip():
        spark.sql(statement)
