"""A global order written once: rows in key order, and their numbers within groups.

Rows are dealt by ranges of their keys, so a group with a third of all rows is
spread over as many partitions as its share. Equal rows are dealt by a running
number as well, so even those do not fill one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paymatch.llm.store import save

#: Bits of ``place`` below the number of the partition.
_LOCAL = 33


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_order(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` as a written table with ``place`` (long): unique, and ascending as the keys do (nulls first)."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = (tied.repartitionByRange(partitions_of(rows), *keys, "_tie")
             .sortWithinPartitions(*keys, "_tie").drop("_tie"))
    return save(dealt.withColumn("place", F.monotonically_increasing_id()), name)


def stretches(ordered: DataFrame, group: list[str]) -> DataFrame:
    """Per group and range of an ordered table (the group leading its keys): ``part``, ``first`` (place of
    its first row there), ``before`` (rows in earlier ranges) and ``n`` (rows of the group).

    At most one row per range and one per group: a window over it holds a row per range.
    """
    counted = ordered.groupBy(*group, F.shiftright("place", _LOCAL).alias("part")).agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("_here"))
    all_parts = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = all_parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(*group, "part", "first", F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("before"),
                          F.sum("_here").over(all_parts).alias("n"))


def numbered(ordered: DataFrame, group: list[str], found: DataFrame) -> DataFrame:
    """Rows of ``ordered`` with all columns of ``found`` (:func:`stretches`) and ``at``, from 0 within the group.

    Joined on (group, range), where no key holds more than a range's rows.
    """
    renamed = found.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
                           *[c for c in found.columns if c not in group])
    same = F.shiftright(F.col("place"), _LOCAL) == F.col("part")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = ordered.join(renamed, same)
    return (joined.withColumn("at", F.col("place") - F.col("first") + F.col("before"))
            .drop(*[f"_g{i}" for i in range(len(group))], "part", "first", "before"))
