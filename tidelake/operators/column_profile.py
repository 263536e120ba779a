"""Exact profiles of columns by load, and what changed between loads.

Columns are unpivoted into (load, column, value) and counted; everything else is an aggregate of those counts, so
distinct counts, modes and medians are exact. Loads are counted by size first. All but the hot ones are shuffled once,
by load, as rows; counting, ranking and aggregating happen within that partitioning. A hot load is spread over all
tasks instead: its value counts combine map-side, so a value that fills a third of a table leaves each task as one row,
and its median is closed in by bins of magnitude, then by equal parts of the bin that holds the middle, and only what
is left is sorted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins per doubling of magnitude, for medians; drift compares whole doublings. Parts a bin is cut into again.
FINE, PARTS = 16, 4096
#: A load of more rows is spread over all tasks. It changes the speed only, not the result.
HOT_ROWS = 2_000_000


@dataclass(frozen=True)
class Limits:
    """What makes a load stand out. Shares count to a thousandth."""

    rows: int = 30
    values: int = 20
    null_share: float = 0.10
    nonpositive_share: float = 0.08
    dominant_share: float = 0.40
    median_factor: float = 5.0


def magnitude_bin(x: Column) -> Column:
    """A non-decreasing function of x with FINE steps a doubling; 0 for zero, null for null."""
    x = x.cast("double")
    step = F.floor(F.log2(F.abs(x)) * FINE) + 20_000
    return F.when(x > 0, step).when(x < 0, -step).when(x == 0, F.lit(0).cast("bigint"))


def _cells(df: DataFrame, load: list[str], columns: list[str], patterns: dict[str, str] | None) -> DataFrame:
    """load, column_id, num, txt, bad: one row for each row and column of df (which has the load keys as columns)."""
    patterns = patterns or {}
    kinds = dict(df.dtypes)
    rows = []
    for place, c in enumerate(columns):
        numeric = kinds[c].startswith(("decimal", "int", "bigint", "smallint", "tinyint", "double", "float"))
        value = df[c]
        num = value.try_cast("decimal(38,10)") if numeric else F.lit(None).cast("decimal(38,10)")
        txt = F.when(value.isNotNull() & num.isNull(), value.cast("string"))
        bad = F.coalesce(~value.cast("string").rlike(patterns[c]), F.lit(False)) if c in patterns else F.lit(False)
        rows.append(F.struct(F.lit(place).alias("column_id"), num.alias("num"), txt.alias("txt"), bad.alias("bad")))
    return df.select(*load, F.inline(F.array(*rows)))


def _counted(cells: DataFrame, load: list[str]) -> DataFrame:
    return cells.groupBy(*load, "column_id", "num", "txt", "bad").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, load: dict[str, Column], columns: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """Load keys, column_id, num, txt, bad, n: how often each value of each column stands in each load.

    column_id is the column's place in ``columns`` (four bytes in the shuffle instead of a name in each row). Numbers
    (any numeric type) are counted as num decimal(38,10), all else as txt with ``bad`` = breaks the column's pattern.
    A null value has both null. NaN counts as text NaN."""
    return _counted(_cells(_keyed(df, load, columns), list(load), columns, patterns), list(load))


def _keyed(df: DataFrame, load: dict[str, Column], columns: list[str]) -> DataFrame:
    """Load keys and columns only; a column that bears a key's name gives way to the key."""
    return df.select(*[k.alias(name) for name, k in load.items()], *[df[c] for c in columns if c not in load])


def named(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_id as column_name."""
    return df.withColumn("column_name", F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column_id") + 1)).drop("column_id")


def _same(by: list[str], mark: str) -> Column:
    out = F.lit(True)
    for i, k in enumerate(by):
        out = out & F.col(k).eqNullSafe(F.col(f"{mark}{i}"))
    return out


def _narrow(nums: DataFrame, by: list[str], bin_: str, mark: str, ranks: list[str]) -> DataFrame:
    """The one or two bins of each group that hold the middle: by (under marked names), bin, ranks of the middle (_lo, _hi), numbers below the bin, and the bin's ends.

    ranks: grouping columns that carry the ranks and the count below a coarser bin, where there was one."""
    sums = nums.groupBy(*by, *ranks, bin_).agg(F.sum("n").alias("_in"), F.min("num").alias("_low"), F.max("num").alias("_high"))
    along = Window.partitionBy(*by, *ranks).orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_upto", F.sum("_in").over(along))
    if ranks:
        sums = sums.withColumn("_upto", F.col("_upto") + F.col("_below"))
    else:
        whole = F.sum("_in").over(Window.partitionBy(*by))
        sums = sums.withColumns({"_lo": F.floor((whole + 1) / 2), "_hi": F.floor(whole / 2) + 1})
    sums = sums.withColumn("_under", F.col("_upto") - F.col("_in")).filter("_upto >= _lo and _under < _hi")
    return sums.select(*[F.col(k).alias(f"{mark}{i}") for i, k in enumerate(by)], F.col(bin_).alias(f"{mark}bin"), "_lo", "_hi", F.col("_under").alias("_below"), "_low", "_high")


def medians(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column_id, median (double; the mean of the two middle values when their number is even) of the numbers in value counts."""
    by = [*keys, "column_id"]
    nums = counts.filter("num is not null").withColumn("_bin", magnitude_bin(F.col("num")))
    bins = _narrow(nums, by, "_bin", "_b", [])
    part = F.coalesce(F.floor(F.try_divide((F.col("num") - F.col("_low")).cast("double"), (F.col("_high") - F.col("_low")).cast("double")) * PARTS), F.lit(0))
    inner = nums.join(bins, _same(by, "_b") & (F.col("_bin") == F.col("_bbin"))).select(*by, "num", "n", "_bin", "_lo", "_hi", "_below", part.cast("bigint").alias("_part"))
    parts = _narrow(inner, [*by, "_bin"], "_part", "_p", ["_lo", "_hi", "_below"])
    last = inner.drop("_lo", "_hi", "_below").join(parts, _same([*by, "_bin"], "_p") & (F.col("_part") == F.col("_pbin")))
    along = Window.partitionBy(*by, "_bin", "_part").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    found = last.withColumn("_upto", F.sum("n").over(along) + F.col("_below")).withColumn("_before", F.col("_upto") - F.col("n"))
    holds = lambda r: (F.col("_before") < F.col(r)) & (F.col("_upto") >= F.col(r))
    return found.filter(holds("_lo") | holds("_hi")).groupBy(*by).agg(((F.max(F.when(holds("_lo"), F.col("num"))).cast("double") + F.max(F.when(holds("_hi"), F.col("num"))).cast("double")) / 2).alias("median"))


def _figures() -> list[Column]:
    value = F.col("num").isNotNull() | F.col("txt").isNotNull()
    return [
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(~value, F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(F.col("num") <= 0, F.col("n"))), F.lit(0)).alias("nonpositive"),
        F.count_if(value).alias("distinct"),
        F.coalesce(F.max(F.when(value, F.col("n"))), F.lit(0)).alias("top"),
        F.min("num").alias("low"),
        F.max("num").alias("high"),
        F.try_divide(F.sum(F.col("num").cast("double") * F.col("n")), F.sum(F.when(F.col("num").isNotNull(), F.col("n")))).alias("mean"),
        F.min("txt").alias("low_text"),
        F.max("txt").alias("high_text"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("violations"),
    ]


def profile(counts: DataFrame, keys: list[str]) -> DataFrame:
    """One row a load and column: rows, nulls, nonpositive, distinct, top (count of the commonest value), low, high, mean, low_text, high_text, violations, median."""
    by = [*keys, "column_id"]
    mid = medians(counts, keys).select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(by)], "median")
    return counts.groupBy(*by).agg(*_figures()).join(mid, _same(by, "_m"), "left").drop(*[f"_m{i}" for i in range(len(by))])


def _together(keyed: DataFrame, load: list[str], columns: list[str], patterns: dict[str, str] | None) -> DataFrame:
    """profile() of loads that one task may hold: everything happens within one partitioning by load."""
    by = [*load, "column_id"]
    counts = _counted(_cells(keyed.repartition(*load), load, columns, patterns), load)
    held = F.when(F.col("num").isNotNull(), F.col("n")).otherwise(0)
    counts = counts.withColumns({"_upto": F.sum(held).over(Window.partitionBy(*by).orderBy("num").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum(held).over(Window.partitionBy(*by))})
    number, before = F.col("num").isNotNull(), F.col("_upto") - F.col("n")
    at = lambda rank: F.max(F.when(number & (before < rank) & (F.col("_upto") >= rank), F.col("num"))).cast("double")
    return counts.groupBy(*by).agg(*_figures(), ((at(F.floor((F.col("_all") + 1) / 2)) + at(F.floor(F.col("_all") / 2) + 1)) / 2).alias("median"))


def profile_loads(df: DataFrame, load: dict[str, Column], columns: list[str], scratch: Callable[[str], str], patterns: dict[str, str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """profile() of every load of a table: the loads' sizes are counted first, and written under a path that scratch() gives.

    Loads of more than hot_rows rows have their value counts written once and are profiled from these; all others are
    profiled together. Null load keys are a load of their own."""
    spark, keys = df.sparkSession, list(load)
    keyed = _keyed(df, load, columns)
    path = scratch("hot-loads")
    keyed.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows).select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).write.parquet(path)
    hot = spark.read.parquet(path)
    if hot.isEmpty():
        return _together(keyed, keys, columns, patterns)
    counted = scratch("value-counts")
    _counted(_cells(keyed.join(hot, _same(keys, "_h"), "left_semi"), keys, columns, patterns), keys).write.parquet(counted)
    return profile(spark.read.parquet(counted), keys).unionByName(_together(keyed.join(hot, _same(keys, "_h"), "left_anti"), keys, columns, patterns))


def findings(profiles: DataFrame, series: list[str], load: str, step: int, limits: Limits = Limits()) -> DataFrame:
    """profiles' keys and finding, one row for each way a load stands out.

    series: the keys whose loads follow one another; load: the bigint key that numbers them, step apart."""
    by = [*series, "column_id"]
    big = profiles.filter(F.col("rows") >= limits.rows).withColumn("values", F.col("rows") - F.col("nulls"))
    usable = (F.col("values") >= limits.values) & (F.col("median") > 0)
    big = big.withColumn("_usable", usable)
    earlier = F.lag(F.struct(load, "median", "_usable")).over(Window.partitionBy(*by).orderBy(load))
    both = big.withColumn("_earlier", earlier).withColumn("_before", F.when((F.col("_earlier")[load] == F.col(load) - step) & F.col("_earlier._usable"), F.col("_earlier.median")))
    over = lambda part, share, whole: F.col(part) * 1000 > F.col(whole) * round(share * 1000)  # noqa: E731  exact in integers
    found = F.array(
        F.when(over("nulls", limits.null_share, "rows"), F.lit("null_share")),
        F.when(over("nonpositive", limits.nonpositive_share, "values"), F.lit("nonpositive_share")),
        F.when((F.col("values") >= limits.values) & over("top", limits.dominant_share, "values"), F.lit("dominant_value")),
        F.when(F.col("_usable") & (F.greatest("median", "_before") > limits.median_factor * F.least("median", "_before")) & F.col("_before").isNotNull(), F.lit("median_shift")),
    )
    return both.select(*series, load, "column_id", F.explode(F.array_compact(found)).alias("finding"))


def drift(counts: DataFrame, series: list[str], load: str, step: int) -> DataFrame:
    """Population stability index and chi-square of each load's numbers against the load before, over magnitude doublings.

    Shares of an empty bin are taken as half a row's. Loads without a predecessor have no row."""
    by = [*series, "column_id"]
    bins = counts.filter("num is not null").withColumn("_bin", F.floor(magnitude_bin(F.col("num")) / FINE)).groupBy(*by, load, "_bin").agg(F.sum("n").alias("n"))
    now = bins.select(*by, load, "_bin", F.col("n").alias("now"), F.lit(0).cast("bigint").alias("was"))
    old = bins.select(*by, (F.col(load) + step).alias(load), "_bin", F.lit(0).cast("bigint").alias("now"), F.col("n").alias("was"))
    pair = now.unionByName(old).groupBy(*by, load, "_bin").agg(F.sum("now").alias("now"), F.sum("was").alias("was"))
    whole = Window.partitionBy(*by, load)
    pair = pair.withColumns({"all_now": F.sum("now").over(whole), "all_was": F.sum("was").over(whole)}).filter("all_now > 0 and all_was > 0")
    p, q = F.greatest(F.col("now"), F.lit(0.5)) / F.col("all_now"), F.greatest(F.col("was"), F.lit(0.5)) / F.col("all_was")
    expected = lambda side: (F.col("now") + F.col("was")) * F.col(side) / (F.col("all_now") + F.col("all_was"))
    chi = (F.col("now") - expected("all_now")) ** 2 / expected("all_now") + (F.col("was") - expected("all_was")) ** 2 / expected("all_was")
    return pair.groupBy(*by, load).agg(F.round(F.sum((p - q) * F.log(p / q)) + 1e-9, 6).alias("psi"), F.round(F.sum(chi) + 1e-9, 6).alias("chi_square"), F.count("*").alias("bins"))
