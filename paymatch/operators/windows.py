"""Time windows and per-key ranking operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paymatch.functions import ts_lit
from paymatch.sources.layout import within


def time_window(df: DataFrame, col: str, start: str, end: str) -> DataFrame:
    """Half-open ``start <= col < end`` (P4). Literal bounds push down to the scan; of a
    table laid out by the day or month of ``col`` only those of the window are read."""
    return within(df, col, ts_lit(start), ts_lit(end)).where((F.col(col) >= ts_lit(start)) & (F.col(col) < ts_lit(end)))


def number_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   name: str, part: Column, part_order: Column) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order)`` as ``name``.

    A plain window sends every row of a key to one task. Here a key's rows are
    numbered part by part: ``part`` is a value that the order sorts by first
    (such as the day of its first timestamp), ``part_order`` sorts the column
    ``_rn_part`` the same way. Rows are numbered within (key, part), and the
    rows of the key's earlier parts, counted by a partial aggregation, are
    added. No task holds more than one part of a key and one count per part;
    the plan is the same at every size and a function of the data alone.

    ``order`` must make the rows of a key totally ordered (ties would be
    numbered arbitrarily, as in any row_number).
    """
    parted = df.withColumn("_rn_part", part)
    counts = parted.groupBy(*keys, "_rn_part").agg(F.count(F.lit(1)).alias("_rn_n"))
    before = Window.partitionBy(*keys).orderBy(part_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.coalesce(F.sum("_rn_n").over(before), F.lit(0)).alias("_rn_offset"),
                            F.col("_rn_part").alias("_rn_opart"),
                            *[F.col(k).alias(f"_rn_k{i}") for i, k in enumerate(keys)])
    local = parted.withColumn("_rn_local", F.row_number().over(
        Window.partitionBy(*keys, "_rn_part").orderBy(*order)))
    same = F.col("_rn_part").eqNullSafe(F.col("_rn_opart"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_rn_k{i}"))
    number = (F.col("_rn_local") + F.col("_rn_offset")).cast("int").alias(name)
    return local.join(offsets, same, "inner").select(*df.columns, number)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                ties: str = "one") -> DataFrame:
    """First row(s) per key: ``row_number() = 1`` or, with ties, ``rank() = 1``.

    The filter sits directly on the rank, so Catalyst inserts a partial
    ``WindowGroupLimit`` before the shuffle: each map task forwards only its
    local leaders, and a hot key cannot flood one reducer (ties aside).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    fn = F.rank() if ties == "all" else F.row_number()
    return df.withColumn("_top_rank", fn.over(w)).where(F.col("_top_rank") == 1).drop("_top_rank")
