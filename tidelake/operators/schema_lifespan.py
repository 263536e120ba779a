"""Schemas that drift along a log: a catalogue of every field's lifespan, the changes in it, and one table out of all shapes.

Each message carries its own footer: its top-level field names and JSON types, read from the payload in one parse
before anything is shuffled; only footers travel, not texts. Only messages whose footer differs from the one before
are exploded; each starts a run of messages of one shape. All neighbours come from ``blocked``, so neither a partition
nor a field of it is ever one task, even if every message changes its shape. Runs exploded into producer-field rows form islands: a field whose row has no row in
the run before starts there (added), one without a row in the next run ends there (removed), one whose type differs
from the last known type is retyped. A field that ends where another of the same quantity starts is renamed. The
alias table says which names mean one quantity; names it does not know are compared by their words. The same table
yields the casts into one fixed schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.parsing import json_fields
from tidelake.operators.blocked import beside, in_blocks

#: Names under which bar messages carry one quantity, the table's own name first.
BAR_ALIASES = {
    "open_time": ["t_open", "openTime"],
    "close_time": ["closeTime", "t_close"],
    "open": ["o", "open_price", "openPrice"],
    "high": ["h", "high_price", "highPrice"],
    "low": ["l", "low_price", "lowPrice"],
    "close": ["c", "close_price", "closePrice"],
    "volume": ["vol", "base_volume", "baseVolume"],
    "quote_volume": ["q_vol", "quoteVolume", "quote_asset_volume", "quoteAssetVolume"],
    "number_of_trades": ["trade_count", "numTrades", "num_trades", "trades"],
    "taker_buy_base_volume": ["taker_base_vol", "takerBuyBase", "taker_buy_base"],
    "taker_buy_quote_volume": ["taker_quote_vol", "takerBuyQuote", "taker_buy_quote"],
    "is_closed": ["closed", "is_final", "isClosed", "isFinal"],
    "symbol": ["sym", "pair"],
    "interval": ["kline_interval"],
}

#: Offsets of a block; see blocked.neighbour.
BLOCK = 50_000


def quantity(name: Column, aliases: Mapping[str, list[str]]) -> Column:
    """The quantity a field name stands for: the alias table's, else its words in lower case and without order."""
    words = F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[_\\W]+")
    pairs = [F.lit(x) for own, others in aliases.items() for alias in [own, *others] for x in (alias, own)]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), F.array_join(F.array_sort(words), "_"))


def footers(messages: DataFrame, producer: list[str], offset: str, payload: str, block: int = BLOCK) -> DataFrame:
    """One row a message that is a JSON object: producer columns, block, offset and footer (array of field and kind, by field).

    kind is string, number, boolean, object, array, or null for a null. Copies at one offset are one message (of copies
    that differ the least footer counts). Rows with a null producer column, offset or payload are none. A message with
    one name twice is no JSON object."""
    rows = messages.select(*producer, F.col(offset).alias("_offset"), F.try_parse_json(F.col(payload)).alias("_value")).dropna()
    shape = F.schema_of_variant
    kind = lambda v: (
        F.when(shape(v) == "VOID", F.lit(None).cast("string"))
        .when(shape(v) == "STRING", "string")
        .when(shape(v) == "BOOLEAN", "boolean")
        .when(shape(v).startswith("OBJECT"), "object")
        .when(shape(v).startswith("ARRAY"), "array")
        .otherwise("number")
    )
    fields = F.map_entries(F.try_variant_get("_value", "$", "map<string,variant>"))
    rows = rows.select(*producer, "_offset", F.transform(fields, lambda e: F.struct(e["key"].alias("field"), kind(e["value"]).alias("kind"))).alias("_footer")).filter("_footer is not null")
    return in_blocks(rows, producer, "_offset", block).groupBy(*producer, "_block", "_offset").agg(F.min("_footer").alias("_footer"))


def runs(messages: DataFrame, producer: list[str], offset: str, payload: str, block: int = BLOCK) -> DataFrame:
    """Messages that start a run of one shape: producer, at, _footer, before and after (offsets of the runs beside it)."""
    feet = footers(messages, producer, offset, payload, block)
    near = beside(feet, producer, "_offset", ["_footer"], block, before="_prev")
    starts = near.filter("_prev is null or not (_prev._footer <=> _footer)").select(*producer, F.col("_offset").alias("at"), "_footer")
    out = beside(starts, producer, "at", [], block, before="_run_before", after="_run_after")
    return out.select(*producer, "at", "_footer", F.col("_run_before.at").alias("before"), F.col("_run_after.at").alias("after"))


def lifespans(messages: DataFrame, producer: list[str], offset: str, payload: str, block: int = BLOCK) -> DataFrame:
    """The catalogue: one row a producer, run and field: field, kind, starts, ends (the next run's offset, or null), retyped.

    starts and retyped are facts about the run's first message; ``first`` marks the producer's first run."""
    rows = runs(messages, producer, offset, payload, block).select(*producer, "at", "before", "after", F.inline("_footer"))
    rows = beside(rows, [*producer, "field"], "at", [], block, before="_prev", after="_next", known=("kind", "_known"))
    here = F.col("_prev.at").eqNullSafe(F.col("before"))
    return rows.select(
        *producer, "field", "kind", "at",
        F.col("before").isNull().alias("first"),
        (~here).alias("starts"),
        F.when(~F.col("_next.at").eqNullSafe(F.col("after")), F.col("after")).alias("ends"),
        (here & F.col("before").isNotNull() & F.col("kind").isNotNull() & F.col("_known").isNotNull() & (F.col("kind") != F.col("_known"))).alias("retyped"),
    )


def changes(messages: DataFrame, producer: list[str], offset: str, payload: str, aliases: Mapping[str, list[str]] = BAR_ALIASES, block: int = BLOCK) -> DataFrame:
    """producer columns, offset (under its own name), field_name, change_kind: added, removed, retyped or renamed.

    A field that comes back has its type compared only from its next message on. Two fields of one quantity that go
    while one comes: the first by name is renamed, the other removed. An empty or wholly broken log has no changes."""
    spans = lifespans(messages, producer, offset, payload, block)
    events = spans.select(
        *producer, "field",
        F.explode(F.array_compact(F.array(
            F.when(F.col("starts") & ~F.col("first"), F.struct(F.col("at").alias("at"), F.lit("added").alias("kind"))),
            F.when(F.col("ends").isNotNull(), F.struct(F.col("ends").alias("at"), F.lit("removed").alias("kind"))),
            F.when(F.col("retyped"), F.struct(F.col("at").alias("at"), F.lit("retyped").alias("kind"))),
        ))).alias("e"),
    ).select(*producer, "e.at", "e.kind", "field", quantity(F.col("field"), aliases).alias("quantity"))
    # the k-th name that goes and the k-th that comes of a quantity at one offset are one renaming
    nth = Window.partitionBy(*producer, "at", "quantity", "kind").orderBy("field")
    events = events.withColumn("nth", F.row_number().over(nth))
    pair = Window.partitionBy(*producer, "at", "quantity", "nth")
    moved = F.count_if(F.col("kind") == "added").over(pair) + F.count_if(F.col("kind") == "removed").over(pair) == 2
    events = events.withColumn("moved", moved & (F.col("kind") != "retyped")).filter(~(F.col("moved") & (F.col("kind") == "added")))
    return events.select(*producer, F.col("at").alias(offset), F.col("field").alias("field_name"), F.when(F.col("moved"), "renamed").otherwise(F.col("kind")).alias("change_kind"))


def unify(messages: DataFrame, payload: str, columns: Mapping[str, str], aliases: Mapping[str, list[str]] = BAR_ALIASES) -> DataFrame:
    """All messages in one table: the input's columns plus ``columns`` (name: type), each read from whichever alias stands in the message and cast.

    One parse reads all aliases. Timestamps are read from epoch milliseconds in text or number. What can't be cast, and every column of a message
    that is no JSON object, is null. Clashing input columns give way to the read ones."""
    known = {name: [name, *aliases.get(name, [])] for name in columns}
    base = messages.withColumn("_value", json_fields(F.col(payload), [a for names in known.values() for a in names]))
    out: dict[str, Column] = {}
    for name, kind in columns.items():
        text = F.nullif(F.trim(F.coalesce(*[F.col("_value").getField(a) for a in known[name]])), F.lit(""))
        out[name] = F.timestamp_millis(text.try_cast("bigint")) if kind == "timestamp" else text.try_cast(kind)
    return base.withColumns(out).drop("_value")
