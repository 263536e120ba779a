"""MERGE on plain DataFrames: keyed upsert with a guard, as one full outer join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Guard = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def not_older(column: str) -> Guard:
    """The source row may overwrite if its column is at least the target's."""
    return lambda s, t: s(column) >= t(column)


def one_row_per_key(source: DataFrame, keys: list[str]) -> DataFrame:
    """The source, failing at run time if any key without nulls stands twice in it (MERGE's cardinality rule)."""
    packed = source.select(*[source[k].alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*[source[c].alias(f"c{i}") for i, c in enumerate(source.columns)]).alias("r"))
    ks = [f"k{i}" for i in range(len(keys))]
    nulls = packed.filter(" or ".join(f"{k} is null" for k in ks)).select("r")
    once = packed.dropna(subset=ks).groupBy(*ks).agg(F.count("*").alias("n"), F.any_value("r").alias("r"))
    checked = once.select(F.when(F.col("n") == 1, F.col("r")).otherwise(F.raise_error(F.lit("merge: more than one source row for a key"))).alias("r"))
    return checked.unionAll(nulls).select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(source.columns)])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], *, guard: Guard | None = None, set_columns: dict[str, Guard] | list[str] | None = None, check: bool = True) -> DataFrame:
    """The target after merging the source.

    guard: when a matched row may be overwritten (a null answer means no). set_columns: the columns that are
    overwritten, all by default, or expressions of (source, target). Unmatched source rows are inserted whole. Null
    keys match nothing. Columns the source lacks keep the target's value, and are null in inserted rows."""
    source = one_row_per_key(source, keys) if check else source
    names = target.columns
    have = [c for c in names if c in source.columns]
    t = target.select(*keys, F.struct(*names).alias("_t"))
    s = source.select(*keys, F.struct(*have).alias("_s"))
    s_of, t_of = (lambda c: F.col(f"_s.{c}")), (lambda c: F.col(f"_t.{c}"))
    if set_columns is None:
        set_columns = [c for c in have if c not in keys]
    setters = {c: (lambda s, _, c=c: s(c)) for c in set_columns} if isinstance(set_columns, list) else set_columns
    allowed = F.coalesce(guard(s_of, t_of), F.lit(False)) if guard else F.lit(True)
    both = t.join(s, keys, "full_outer")
    out = []
    for c in names:
        kind = target.schema[c].dataType
        fresh = s_of(c).cast(kind) if c in have else F.lit(None).cast(kind)
        changed = setters[c](s_of, t_of).cast(kind) if c in setters else t_of(c)
        out.append(F.when(F.col("_t").isNull(), fresh).when(F.col("_s").isNull(), t_of(c)).when(allowed, changed).otherwise(t_of(c)).alias(c))
    return both.select(*out)
