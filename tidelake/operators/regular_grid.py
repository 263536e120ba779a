"""Irregular readings onto a regular grid, by intervals.

A reading holds until the next one of its series: a step function, kept as intervals [start, end). Intervals are cut
at the grid's lines; each piece adds its length and its length x value to its cell. A cell's time-weighted mean,
its coverage (the part of it in which the last reading was no older than ``hold``) and whether any reading started
in it all come from one map-side combining aggregate. A silence longer than ``silence_s`` ends the series; cells in
shorter silences come out with no reading, filled with the value that held. Neighbours of a series are found in
blocks of days, so a series with a third of all rows is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.parsing import floor_to, micros
from tidelake.operators.blocked import neighbour

US = 1_000_000
DAY_US = 86_400 * US


def step_intervals(readings: DataFrame, series: dict[str, Column], time: Column, step_s: Column, value: Column, version: list[Column]) -> DataFrame:
    """series, _step (us), _start, _value, _next (start of the next reading, or null): one row a series and instant.

    Of several readings of one instant the greatest ``version`` counts, then the greatest value. Rows with a null
    series key, time or step are no readings; a null value is a reading without a value."""
    rows = readings.select(*[c.alias(k) for k, c in series.items()], (step_s * US).alias("_step"), micros(time).alias("_start"), F.struct(*[v.alias(f"v{i}") for i, v in enumerate(version)], value.cast("double").alias("value")).alias("_best"))
    rows = rows.filter(F.col("_step").isNotNull() & F.col("_start").isNotNull()).dropna(subset=list(series))
    once = rows.groupBy(*series, "_step", "_start").agg(F.max("_best").alias("_best")).withColumn("_value", F.col("_best.value")).drop("_best")
    return neighbour(once, [*series, "_step"], "_start", [], DAY_US, "_after", ahead=True).withColumn("_next", F.col("_after._start")).drop("_after")


def onto_grid(intervals: DataFrame, series: list[str], silence_s: int, hold_s: int | None = None) -> DataFrame:
    """series, slot_epoch, readings (distinct instants in the cell), mean (time-weighted, null without values), coverage (0 to 1), marked ('observed' or 'filled').

    hold_s: how long a reading counts as covering, by default one step. The last cell before a silence or the end is
    filled to its own end and no further."""
    start, step = F.col("_start"), F.col("_step")
    own = floor_to(start, step)
    goes_on = F.col("_next").isNotNull() & (floor_to(F.col("_next"), step) - own <= silence_s * US)
    rows = intervals.withColumn("_end", F.when(goes_on, F.col("_next")).otherwise(own + step))
    hold = step if hold_s is None else F.lit(hold_s * US)
    cells = rows.withColumn("_cell", F.explode(F.sequence(own, floor_to(F.greatest(F.col("_end") - 1, start), step), step)))
    cell_end = F.col("_cell") + step
    length = F.least(F.col("_end"), cell_end) - F.greatest(start, F.col("_cell"))
    fresh = F.greatest(F.least(F.col("_end"), cell_end, start + hold) - F.greatest(start, F.col("_cell")), F.lit(0))
    valued = F.when(F.col("_value").isNotNull(), length)
    pieces = cells.select(*series, "_step", "_cell", (F.col("_cell") == own).cast("bigint").alias("_n"), (valued * F.col("_value")).alias("_vx"), valued.alias("_v"), fresh.alias("_fresh"))
    out = pieces.groupBy(*series, "_step", "_cell").agg(F.sum("_n").alias("readings"), F.try_divide(F.sum("_vx"), F.sum("_v")).alias("mean"), (F.sum("_fresh") / F.col("_step")).alias("coverage"))
    return out.select(*series, (F.col("_cell") / US).cast("bigint").alias("slot_epoch"), "readings", "mean", "coverage", F.when(F.col("readings") > 0, "observed").otherwise("filled").alias("marked"))
