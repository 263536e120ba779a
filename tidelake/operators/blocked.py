"""Neighbours in an ordered series without one task per series.

A window over a whole series puts a hot series (one symbol, one Kafka partition) into one task. Here the
series is cut into blocks of its order column; lag and lead run inside a block, and the row across a block's
edge comes from a table with one row a block. That table is shorter by the block's length, so only it is
ordered series by series. Rows and edges are two readers of one and the same exchange: what lies before it is
computed, and shuffled, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.parsing import floor_div


def in_blocks(df: DataFrame, keys: list[str], order: str, block: int) -> DataFrame:
    """Adds ``_block`` and partitions on it and the keys: later grouping by these and more, and beside(), shuffle no more. Rows with a null in either are left out."""
    return df.withColumn("_block", floor_div(F.col(order), block)).dropna(subset=[*keys, "_block"]).repartition(*keys, "_block")


def beside(df: DataFrame, keys: list[str], order: str, values: list[str], block: int, *, before: str | None = None, after: str | None = None, known: tuple[str, str] | None = None) -> DataFrame:
    """Adds, under the names given, a struct of order and values of the previous row of the series (before) and of the next (after), null at its ends.

    known: (column, name): the column's last value that is not null in any earlier row. Order must be a bigint without
    ties inside a series; rows with a null key or order are left out. ``block`` is a length in units of order; it changes the speed only, not the result. An empty input gives an empty
    result. A df that in_blocks() has partitioned is not shuffled again."""
    base = df if "_block" in df.columns else in_blocks(df, keys, order, block)
    by, item, place = [*keys, "_block"], F.struct(order, *values), F.col(order)
    inside, along = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*keys).orderBy("_block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    # Both readers ask for every column, the rows in a condition that always holds: their exchanges are alike, and made once.
    every = F.xxhash64(*base.columns)
    edge = [F.max(every).alias("_whole")]
    near, across = {}, {}
    for name, ahead in ((before, False), (after, True)):
        if name:
            edge.append((F.min(place) if ahead else F.max(place)).alias(f"_e_{name}") if not values else (F.min_by if ahead else F.max_by)(item, place).alias(f"_e_{name}"))
            there = F.col(f"_e_{name}") if values else F.struct(F.col(f"_e_{name}").alias(order))
            near[name], across[name] = (F.lead if ahead else F.lag)(item).over(inside), (F.lead if ahead else F.lag)(there).over(along)
    if known:
        edge.append(F.max_by(F.col(known[0]), F.when(F.col(known[0]).isNotNull(), place)).alias("_e_known"))
        near[known[1]] = F.last(known[0], ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        across[known[1]] = F.last("_e_known", ignorenulls=True).over(earlier)
    edges = base.groupBy(*by).agg(*edge).filter("_whole is not null").select(*[F.col(k).alias(f"_x{i}") for i, k in enumerate(by)], *[c.alias(f"_x_{n}") for n, c in across.items()])
    same = every <= F.lit((1 << 63) - 1)
    for i, k in enumerate(by):
        same = same & (F.col(k) == F.col(f"_x{i}"))
    joined = base.withColumns({f"_n_{n}": c for n, c in near.items()}).join(edges, same, "left")
    return joined.withColumns({n: F.coalesce(f"_n_{n}", f"_x_{n}") for n in near}).select(*[c for c in base.columns if c != "_block"], *near)


def neighbour(df: DataFrame, keys: list[str], order: str, values: list[str], block: int, name: str, ahead: bool = False) -> DataFrame:
    """beside() in one direction: adds ``name``, a struct of order and values of the previous (or, if ahead, next) row."""
    return beside(df, keys, order, values, block, **{"after" if ahead else "before": name})
