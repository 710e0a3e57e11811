"""Running aggregates per key that no task computes for a whole key.

A plain window sends every row of a key to one task. Here the order of a key's
rows is split into levels, as a date is into days and seconds: the first
column sorts first, the second within the first, and so on. Totals per level
are partial aggregations; at each level only the totals of siblings are put
in order, and a row adds what lies before its part to what lies before it within its part.
The result is a function of the data alone: nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    """Sum of two totals, of which either may be missing."""
    return F.coalesce(a + b, a, b)


def later(a: Column, b: Column) -> Column:
    """The greater of two values, of which either may be missing."""
    return F.greatest(a, b)


def running(df: DataFrame, keys: Sequence[str], levels: Sequence[Column], order: Sequence[Column],
            values: dict[str, Column], agg: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> DataFrame:
    """``df`` with each of ``values`` aggregated over the rows of its key up to and including each row.

    NULL keys are one key. ``levels`` sort ascending, NULLs first, and must agree with ``order``, the
    total order of the rows within the last level. ``agg`` and ``combine`` are a pair such as
    ``F.sum`` and :func:`add`, or ``F.max`` and :func:`later`. No task holds more than the rows of one part of the last level, or
    one total per part of one level.
    """
    names = [f"_rl{i}" for i in range(len(levels))]
    rows = df.withColumns({n: c for n, c in zip(names, levels)} | {f"_rv_{v}": c for v, c in values.items()})
    totals = [rows.groupBy(*keys, *names).agg(*[agg(F.col(f"_rv_{v}")).alias(f"_rt_{v}") for v in values])]
    for i in range(len(levels) - 1, 0, -1):
        totals.insert(0, totals[0].groupBy(*keys, *names[:i]).agg(
            *[agg(F.col(f"_rt_{v}")).alias(f"_rt_{v}") for v in values]))

    def joined(left: DataFrame, offsets: DataFrame, depth: int) -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same = same & left[k].eqNullSafe(F.col(f"_ro_{k}"))
        for n in names[:depth]:
            same = same & left[n].eqNullSafe(F.col(f"_ro{n}"))
        return left.join(offsets, same).drop(*[f"_ro_{k}" for k in keys], *[f"_ro{n}" for n in names[:depth]])

    offsets = None
    for i, table in enumerate(totals):
        earlier = (Window.partitionBy(*keys, *names[:i]).orderBy(F.col(names[i]).asc_nulls_first())
                   .rowsBetween(Window.unboundedPreceding, -1))
        table = table.select(*keys, *names[:i + 1], *[agg(F.col(f"_rt_{v}")).over(earlier).alias(f"_rb_{v}") for v in values])
        if offsets is not None:
            table = joined(table, offsets, i).withColumns(
                {f"_rb_{v}": combine(F.col(f"_rp_{v}"), F.col(f"_rb_{v}")) for v in values})
        offsets = table.select(*[F.col(k).alias(f"_ro_{k}") for k in keys], *[F.col(n).alias(f"_ro{n}") for n in names[:i + 1]],
                               *[F.col(f"_rb_{v}").alias(f"_rp_{v}") for v in values])
    here = (Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = rows.withColumns({f"_rv_{v}": agg(F.col(f"_rv_{v}")).over(here) for v in values})
    out = joined(local, offsets, len(levels))
    return out.select(*df.columns, *[combine(F.col(f"_rp_{v}"), F.col(f"_rv_{v}")).alias(v) for v in values])


def row_numbers(df: DataFrame, keys: Sequence[str], levels: Sequence[Column], order: Sequence[Column], name: str) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY levels, order)`` as ``name``, by :func:`running`."""
    counted = running(df, keys, levels, order, {name: F.lit(1)}, F.sum, add)
    return counted.withColumn(name, F.col(name).cast("int"))
