"""Column expressions that read dirty text without raising. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank of an order status among changes of one instant.
STATUS_RANK = {"NEW": 1, "PARTIALLY_FILLED": 2, "FILLED": 3, "CANCELED": 3, "DELETED": 4}


def utc_timestamp(text: Column) -> Column:
    """Timestamp of a text with or without a zone; no zone means UTC, whatever the session's zone. Unreadable text is null."""
    text = F.trim(text)
    zoned = F.right(text, F.lit(6)).rlike(r"(?i)(z|utc|[+-]\d{1,2}:?\d{2})$") & text.rlike(r"\d:\d")  # no zone is longer
    return F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")


def floor_to(value: Column, step: int | Column) -> Column:
    """The multiple of step at or below value, exactly, for negative values too (both bigint)."""
    step = F.lit(step).cast("bigint") if isinstance(step, int) else step
    return value - F.pmod(value, step)


def floor_div(value: Column, step: int | Column) -> Column:
    """Integer floor division of bigints."""
    step = F.lit(step).cast("bigint") if isinstance(step, int) else step
    return ((value - F.pmod(value, step)) / step).cast("bigint")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def symbol_key(text: Column) -> Column:
    """Upper case without outer white space; blank is null."""
    return F.nullif(F.upper(F.trim(text)), F.lit(""))


def symbol_letters(text: Column) -> Column:
    """The letters of a symbol in upper case, whatever stands between them; null without letters."""
    return F.nullif(F.upper(F.regexp_replace(text, r"[^\p{L}]", "")), F.lit(""))


def order_status(status: Column, event_type: Column) -> Column:
    """One of STATUS_RANK's names, from the status or else from the event type; null if neither tells."""

    def read(text: Column) -> Column:
        text = F.regexp_replace(F.upper(F.trim(text)), r"[\s\-]+", "_")
        text = F.regexp_replace(F.regexp_replace(text, "^ORDER_", ""), "^CANCELLED$", "CANCELED")
        return F.when(text.isin(*STATUS_RANK), text)

    plain = lambda text: F.when(text.isin(*STATUS_RANK), text)  # noqa: E731  most need no reading
    return F.coalesce(plain(status), read(status), plain(event_type), read(event_type))


def status_rank(status: Column) -> Column:
    """STATUS_RANK as an expression; 0 for anything else."""
    out = F.lit(0)
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, F.lit(rank)).otherwise(out)
    return out


def json_fields(text: Column, names: list[str]) -> Column:
    """A struct of the named top-level fields of a JSON object as texts (nested values as JSON); null unless the whole text is one object.

    Of a name that stands twice the last counts."""
    schema = ", ".join(f"`{n}` string" for n in [*names, "_corrupt"])
    read = F.from_json(text, schema, {"columnNameOfCorruptRecord": "_corrupt"})
    return F.when(F.rtrim(text).endswith("}") & read["_corrupt"].isNull(), read)


def interval_seconds(text: Column) -> Column:
    """Seconds of a bar interval such as 1m, 15m, 1h or 1d; null for anything else."""
    text = F.lower(F.trim(text))
    n = F.regexp_extract(text, r"^(\d{1,6})[smhdw]$", 1).try_cast("bigint")
    unit = F.substring(text, -1, 1)
    size = F.lit(None).cast("bigint")
    for name, seconds in (("s", 1), ("m", 60), ("h", 3600), ("d", 86400), ("w", 604800)):
        size = F.when(unit == name, F.lit(seconds).cast("bigint")).otherwise(size)
    return F.when(n > 0, n * size)
