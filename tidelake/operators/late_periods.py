"""Per-period aggregates by event time under late and out-of-order arrival.

Every source stamps its micro-batches with an arrival time. That stamp is the source's punctuation: nothing the
source sends later arrives before it. A source passes a period's bound (period end + lateness) with its first batch
stamped after the bound; that batch's stamp is when. A record of a period that its source has passed is diverted; all
others count. The period closes when every source has passed it; a source silent for longer than the idle timeout
after the bound is excused at that moment; where the input ends, every source has passed everything.

The state is small: ``marks`` has one row a source and furthest bound that a stamp of it passed, bounded by sources x
calendar. Records are counted into partials first (key, period, source, the mark their batch carried), combining
map-side; only partials meet the marks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.parsing import floor_div, micros

US = 1_000_000


@dataclass(frozen=True)
class Periods:
    """period_s, lateness_s, idle_timeout_s: seconds. A record at exactly the bound still counts."""

    period_s: int = 3600
    lateness_s: int = 6 * 3600
    idle_timeout_s: int = 3600

    def index(self, event_us: Column) -> Column:
        """Number of the period since 1970 that an event falls in."""
        return floor_div(event_us, self.period_s * US)

    def bound_us(self, index: Column) -> Column:
        return (index + 1) * F.lit(self.period_s * US) + F.lit(self.lateness_s * US)

    def passed(self, arrival_us: Column) -> Column:
        """The last period whose bound a punctuation at this time has passed."""
        return -floor_div(F.lit(self.lateness_s * US) - arrival_us, self.period_s * US) - 2


def assign(events: DataFrame, periods: Periods, event_time: Column, arrival: Column) -> DataFrame:
    """Adds _period (index) and _diverted to every record; both null where event time or arrival is null.

    Narrow: no shuffle. Records without an event time belong to no period and stay, unassigned."""
    at, arrived = micros(event_time), micros(arrival)
    known = arrived.isNotNull() & at.isNotNull()
    return events.withColumns({"_period": F.when(known, periods.index(at)), "_diverted": F.when(known, periods.index(at) <= periods.passed(arrived))})


#: Range of the event times that first_arrivals() keeps apart in a tie: years 1 to 9999, in microseconds.
_EARLIEST, _LATEST, _SPAN = -62_135_596_800_000_000, 253_402_300_799_999_999, 10**18


def first_arrivals(events: DataFrame, identity: dict[str, Column], event_time: Column, arrival: Column, source: Column) -> DataFrame:
    """One row a record identity: its earliest arrival, and event time and source (as a number that tells sources apart) of that copy.

    Copies without event time or arrival count for nothing. Ties of arrival go to the earliest event time; of copies
    alike in both any source is given. Identity columns may be null (nulls are one identity). Times outside the years 1
    to 9999 are taken as these years' ends. The aggregate hashes and combines map-side (arrival and event time are one
    number in it), so a repeated record never piles up and no row is sorted."""
    within = lambda us: F.when(us.isNotNull(), F.greatest(F.least(us, F.lit(_LATEST)), F.lit(_EARLIEST)) - F.lit(_EARLIEST))
    rows = events.select(*[c.alias(k) for k, c in identity.items()], within(micros(arrival)).alias("_a"), within(micros(event_time)).alias("_t"), source_id(source).alias("_s")).dropna(subset=["_a", "_t"])
    both = F.col("_a").cast("decimal(18,0)") * F.lit(_SPAN).cast("decimal(19,0)") + F.col("_t").cast("decimal(18,0)")
    first = rows.withColumn("_k", both.cast("decimal(38,0)")).groupBy(*identity).agg(F.min("_k").alias("_k"), F.min_by("_s", "_k").alias("source"))
    back = lambda c: F.timestamp_micros(c.cast("bigint") + F.lit(_EARLIEST))
    span = F.lit(_SPAN).cast("decimal(38,0)")
    return first.select(*identity, back(F.col("_k") % span).alias("event_time"), back(F.expr(f"_k div cast({_SPAN} as decimal(38,0))")).alias("arrival"), "source")


def source_id(source: Column) -> Column:
    """A number for a source; null sources are one source."""
    return F.xxhash64(F.coalesce(source.cast("string"), F.lit("?")))


def marks(events: DataFrame, periods: Periods, arrival: Column, source: Column) -> DataFrame:
    """The watermarks: name of the source, source (source_id), mark (the furthest period whose bound a stamp passed), at (us: the first such stamp). Rows without arrival are none."""
    rows = events.select(F.coalesce(source.cast("string"), F.lit("?")).alias("name"), micros(arrival).alias("at")).filter("at is not null")
    found = rows.withColumn("mark", periods.passed(F.col("at"))).groupBy("name", "mark").agg(F.min("at").alias("at"))
    return found.select("name", source_id(F.col("name")).alias("source"), "mark", "at")


def partials(once: DataFrame, periods: Periods, keys: list[str]) -> DataFrame:
    """keys, period, source, mark (that the record's batch carried), n: records counted before they meet the watermarks."""
    rows = once.select(*keys, periods.index(micros(F.col("event_time"))).alias("period"), "source", periods.passed(micros(F.col("arrival"))).alias("mark"))
    return rows.groupBy(*keys, "period", "source", "mark").agg(F.count("*").alias("n"))


def settle(parts: DataFrame, watermarks: DataFrame, closed: DataFrame, keys: list[str], periods: Periods) -> DataFrame:
    """keys, period_epoch, counted, diverted, closed_at: each period's figures against the sources' watermarks, once it is closed.

    A part is diverted if its source's watermark stands at or past the period when the part's batch has come; its source
    passed the period then or before. Of parts of one source only the first mark at or past the period tells, so the
    watermarks are asked by source and period. closed: periods (period, closed_us) that are closed; the others' parts
    wait and are in no row."""
    wanted = parts.select("source", "period").distinct()
    # the first mark at or past each asked period: marks and asked periods in one order, by source
    line = wanted.select("source", F.col("period").alias("at_period"), F.lit(None).cast("bigint").alias("mark")).unionAll(watermarks.select("source", F.col("mark").alias("at_period"), "mark"))
    ahead = Window.partitionBy("source").orderBy("at_period").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    passed = line.withColumn("passed_mark", F.min("mark").over(ahead)).filter("mark is null").select(F.col("source").alias("_s"), F.col("at_period").alias("_p"), "passed_mark")
    judged = parts.join(passed, (F.col("source") == F.col("_s")) & (F.col("period") == F.col("_p")), "left")
    late = F.coalesce(F.col("mark") >= F.col("passed_mark"), F.lit(False))
    sums = judged.groupBy(*keys, "period").agg(F.sum(F.when(~late, F.col("n")).otherwise(0)).alias("counted"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("diverted"))
    return sums.join(closed, "period").select(*keys, (F.col("period") * periods.period_s).alias("period_epoch"), "counted", "diverted", F.timestamp_micros("closed_us").alias("closed_at"))


def aggregate(assigned: DataFrame, periods: Periods, keys: list[str], aggregates: list[Column] | None = None) -> DataFrame:
    """One row per key and period that has any record: counted, diverted, and the given aggregates over counted rows.

    ``aggregates`` see diverted records too: guard them with ``~_diverted``. Map-side combine makes the result safe
    for a key with a third of all rows."""
    return (
        assigned.filter(F.col("_period").isNotNull())
        .groupBy(*keys, "_period")
        .agg(F.count_if(~F.col("_diverted")).alias("counted"), F.count_if(F.col("_diverted")).alias("diverted"), *(aggregates or []))
        .withColumn("period_epoch", F.col("_period") * periods.period_s)
        .drop("_period")
    )


def closing_times(seen: DataFrame, watermarks: DataFrame, periods: Periods, end_of_input: bool = False) -> DataFrame:
    """period, closed_us, passed (sources), excused (sources), last (name of the source): when each seen period closed.

    Periods that no source has passed are open: closed_us null. With end_of_input every source passes everything after
    its last batch, so that all periods are closed, at the last stamp of all if not before."""
    step, idle = periods.period_s * US, periods.idle_timeout_s * US
    before = F.lag("mark").over(Window.partitionBy("source").orderBy("mark"))
    # A mark speaks for the periods after the source's previous one, as far back as the timeout lets it.
    reach = F.greatest(F.coalesce(before + 1, F.col("mark")), F.col("mark") - (idle // step + 1))
    each = watermarks.withColumn("reach", reach).withColumn("period", F.explode(F.sequence("reach", "mark"))).filter(F.col("at") - periods.bound_us(F.col("period")) <= idle)
    passes = each.groupBy("period").agg(F.max("at").alias("at"), F.count("*").alias("passed"), F.max_by("name", F.struct("at", "name")).alias("last"))
    totals = watermarks.agg(F.countDistinct("source").alias("sources"), F.max("at").alias("now"))
    excused = F.coalesce(F.col("sources") - F.coalesce("passed", F.lit(0)), F.lit(0))
    closed = F.greatest(F.col("at"), F.when(excused > 0, periods.bound_us(F.col("period")) + idle))
    done = F.when(closed <= F.col("now"), closed)
    if end_of_input:
        done = F.coalesce(done, F.col("now"))
    # totals is one row by construction
    return seen.join(passes, "period", "left").join(F.broadcast(totals)).select("period", done.alias("closed_us"), F.coalesce("passed", F.lit(0)).alias("passed"), excused.alias("excused"), "last")


def corrected(events: DataFrame, once: DataFrame, periods: Periods, keys: list[str], arrival: Column, source: Column, scratch: str, end_of_input: bool = True) -> DataFrame:
    """keys, period_epoch, counted, diverted, closed_at of every closed period: the operator over a bounded input.

    events: all rows, whose stamps are the punctuations; once: first_arrivals() of them. Partials and watermarks are
    written once under ``scratch``, and read by closing and settling."""
    spark = events.sparkSession
    partials(once, periods, keys).write.parquet(f"{scratch}/partials")
    marks(events, periods, arrival, source).write.parquet(f"{scratch}/marks")
    parts, water = spark.read.parquet(f"{scratch}/partials"), spark.read.parquet(f"{scratch}/marks")
    closed = closing_times(parts.select("period").distinct(), water, periods, end_of_input).filter("closed_us is not null").select("period", "closed_us")
    return settle(parts, water, closed, keys, periods)


def closings(events: DataFrame, periods: Periods, event_time: Column, arrival: Column, source: Column) -> DataFrame:
    """When each period with an event closed: period_epoch, closed_at, sources_passed, sources_excused, last_source.

    Null sources are one source. Periods that no source has passed yet are open: closed_at null."""
    rows = events.select(micros(event_time).alias("t"), arrival.alias("_a"), source.alias("_s"))
    seen = rows.filter("t is not null and _a is not null").select(periods.index(F.col("t")).alias("period")).distinct()
    out = closing_times(seen, marks(rows, periods, F.col("_a"), F.col("_s")), periods)
    return out.select((F.col("period") * periods.period_s).alias("period_epoch"), F.timestamp_micros("closed_us").alias("closed_at"), F.col("passed").alias("sources_passed"), F.col("excused").alias("sources_excused"), F.col("last").alias("last_source"))
