"""The daily jobs over an ingest window, table by table in the snapshot store, each logged; run again they change nothing.

A window selects what was ingested in it; what is written is keyed by business time. Affected keys (bars, orders, hours)
are worked out from the window's rows and then built anew from all of their rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.parsing import order_status
from tidelake.operators import dedup, lifecycle, parse, quality, schema_lifespan, serving
from tidelake.plans import pipeline
from tidelake.schemas import TABLES
from tidelake.session import scratch, table
from tidelake.store import Catalog, Table, health_summary

BAR_KEY, ORDER_KEY = ["symbol", "interval", "open_time"], ["order_id", "order_status", "event_time"]
CHECKED = {"processed_trades": (["symbol", "trade_id"], "trade_time"), "processed_klines": (BAR_KEY, "open_time"), "processed_orders": (["order_id"], "updated_at"), "market_hourly_summary": (["symbol", "summary_hour"], "summary_hour"), "order_execution_summary": (["symbol", "summary_hour"], "summary_hour")}
CARRIED = ["client_id", "symbol", "side", "order_type", "order_price", "order_qty", "filled_qty", "avg_fill_price", "event_type", "simulated_parameters", "source_topic", "source_partition"]


@dataclass
class Daily:
    """The jobs of one window. Sources: raw_trades and raw_klines (envelopes), orders (typed events)."""

    spark: SparkSession
    catalog: Catalog
    raw_trades: DataFrame
    raw_klines: DataFrame
    orders: DataFrame
    window: tuple[str, str]
    run_id: str
    namespace: str = "lake"

    def t(self, name: str) -> Table:
        return self.catalog.table(f"{self.namespace}.{name}", TABLES[name])

    def fresh(self, df: DataFrame) -> DataFrame:
        """Rows ingested in the window."""
        return dedup.in_ingest_window(df, *self.window, date="ingest_date" if "ingest_date" in df.columns else None)

    def processed_trades(self) -> None:
        """New trades are appended; those that the table holds, or that come twice, are not."""
        once = dedup.latest_by(parse.trades(self.fresh(self.raw_trades)), ["symbol", "trade_id"], [-F.col("source_offset"), -F.col("source_partition")])
        target = self.t("processed_trades")
        target.append(dedup.not_yet_in(once, target.read(), ["symbol", "trade_id"]))

    def staging_klines(self) -> None:
        """The window's bars, one version each, overwrite what is staged."""
        from tidelake.plans.problems import unified_bars

        bars = unified_bars(self.fresh(self.raw_klines), schema_lifespan.BAR_ALIASES).dropna(subset=BAR_KEY)
        self.t("staging_klines").merge(dedup.latest_by(bars, BAR_KEY, [F.col("is_closed"), F.col("source_offset"), F.col("ingest_time"), F.col("source_partition")]), check=False)

    def staging_orders(self) -> None:
        """The window's order events, one row each."""
        feed = self.fresh(self.orders).withColumn("order_status", order_status(F.col("order_status"), F.col("event_type"))).dropna(subset=ORDER_KEY)
        self.t("staging_orders").merge(dedup.latest_by(feed, ORDER_KEY, [F.col("source_offset"), F.col("source_partition")]), check=False)

    def processed_klines(self) -> None:
        """The latest staged version of every bar that the window touched, unless the table's has a later offset."""
        staged = self.t("staging_klines").read()
        source = dedup.latest_by(dedup.touched(staged, self.fresh(staged), BAR_KEY), BAR_KEY, [F.col("source_offset"), F.col("updated_at")])
        self.t("processed_klines").merge(source, check=False)

    def processed_orders(self) -> None:
        """Every order that the window touched, folded from all its events; its ingest time is that of its last arrival, so that a late event marks the order's hour."""
        staged = self.t("staging_orders").read()
        self.t("processed_orders").merge(lifecycle.fold(dedup.touched(staged, self.fresh(staged), ["order_id"]), CARRIED, "ingest_time"), check=False)

    def market_hourly_summary(self) -> None:
        """Every hour that the window touched, from all its bars and trades."""
        bars, trades = self.t("processed_klines").read().filter("interval = '1m'"), self.t("processed_trades").read()
        keys = serving.affected_hours((self.fresh(bars), "open_time"), (self.fresh(trades), "trade_time"))
        self.t("market_hourly_summary").merge(serving.market_hourly(bars, trades, keys).withColumn("updated_at", F.current_timestamp()), check=False)

    def order_execution_summary(self) -> None:
        """Every hour of whose orders the window touched any, beside the market's hours."""
        orders = self.t("processed_orders").read()
        keys = serving.affected_hours((self.fresh(orders), "created_at"))
        self.t("order_execution_summary").merge(serving.execution_hourly(orders, self.t("market_hourly_summary").read(), keys).withColumn("updated_at", F.current_timestamp()), check=False)

    def data_quality(self) -> None:
        """Rows, nulls and repeated keys of the tables, by day of business time."""
        out = None
        for name, (keys, time) in CHECKED.items():
            part = quality.checks_by_day(self.t(name).read(), name, keys, keys, time).withColumn("run_id", F.lit(self.run_id))
            out = part if out is None else out.unionByName(part)
        self.t("data_quality_summary").append(out, token=f"{self.run_id}:data_quality")

    def table_health(self) -> None:
        """Files, deletes and snapshots of the tables."""
        self.t("table_health_summary").append(health_summary({n: self.t(n) for n in CHECKED}, self.run_id), token=f"{self.run_id}:table_health")

    def jobs(self) -> dict[str, Callable[[], None]]:
        return {name: getattr(self, name) for name in pipeline.DAILY}

    def run(self) -> None:
        """All jobs in order; the first failure is logged and ends the run."""
        pipeline.run_all(self.jobs(), self.t("pipeline_run_summary"), self.run_id)


def daily_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table after the jobs of two windows."""
    catalog = Catalog(spark, scratch(spark, "daily"))
    for k, window in enumerate(WINDOWS):
        Daily(spark, catalog, table(spark, d, "raw_trades"), table(spark, d, "raw_klines"), table(spark, d, "staging_orders"), window, f"run-{k}").run()
    out = None
    for name in [*CHECKED, "staging_klines", "staging_orders"]:
        part = catalog.table(f"lake.{name}", TABLES[name]).read().agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = part if out is None else out.unionAll(part)
    runs = catalog.table("lake.pipeline_run_summary", TABLES["pipeline_run_summary"]).read()
    return out.unionAll(runs.agg(F.lit("pipeline_run_summary").alias("table_name"), F.count_if(F.col("status") == "SUCCESS").alias("n")))


#: The ingest windows of the query.
WINDOWS = [("2016-01-04 18:00:00", "2016-01-04 21:00:00"), ("2016-01-04 21:00:00", "2016-01-05 00:00:00")]


def oracle() -> str:
    """The rows as each window leaves them: an hour whose only order turned out to begin earlier keeps its row."""
    from tidelake.plans import merges, reference
    from tidelake.plans.problem_oracles import _ingest

    inside = f"({_ingest()} >= '{WINDOWS[0][0]}+00'::timestamptz and {_ingest()} < '{WINDOWS[1][1]}+00'::timestamptz)"
    fold = lambda name, rows: f"{name} as (select order_id, arg_max({{'s': symbol}}, (event_time, case order_status when 'NEW' then 1 when 'PARTIALLY_FILLED' then 2 when 'DELETED' then 4 else 3 end, source_offset)).s symbol, min(event_time) c from {rows} group by 1)"
    hour = lambda c: f"cast(floor(epoch_ms({c}) / 3600000.0) as bigint)"
    return f"""with {reference._PARSED}, {merges._BARS}, {merges._FEED},
      trades as (select symbol, trade_id, arg_min(time_ms, (source_offset, source_partition)) time_ms, count(*) from parsed where trade_id is not null and symbol is not null and {inside} group by 1, 2),
      klines as (select distinct symbol, kline_interval, open_time from bars where {inside}), events as (select * from feed where {inside} and ingest_time is not null),
      {fold('first_orders', f"(select * from events where {_ingest()} < '{WINDOWS[0][1]}+00'::timestamptz)")}, {fold('orders', 'events')}
      select 'processed_trades' table_name, count(*) n from trades union all select 'staging_klines', count(*) from klines union all select 'processed_klines', count(*) from klines
      union all select 'staging_orders', count(*) from (select distinct order_id, order_status, event_time from events) union all select 'processed_orders', count(*) from orders
      union all select 'market_hourly_summary', count(*) from (select symbol, cast(floor(open_time / 3600000.0) as bigint) h from klines where kline_interval = '1m' union select symbol, cast(floor(time_ms / 3600000.0) as bigint) from trades where time_ms is not null)
      union all select 'order_execution_summary', count(*) from (select symbol, {hour('c')} from first_orders where symbol is not null union select symbol, {hour('c')} from orders where symbol is not null)
      union all select 'pipeline_run_summary', 18"""
