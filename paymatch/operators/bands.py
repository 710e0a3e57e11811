"""Band join: rows whose values lie in each other's intervals, without a nested loop.

A band is cut into buckets of a fixed width. A left row lies in one bucket, a right
row is dealt to every bucket that its interval touches (two or three, if
the width is that of the interval), and the two meet by equality of all their
buckets; the exact bounds are checked on the pairs. As each left row has one bucket,
no pair comes twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.operators.joins import skew_join


@dataclass(frozen=True)
class Band:
    """``low <= value <= high`` on whole numbers: ``value`` of the left side, the others of the right side."""

    value: Column
    low: Column
    high: Column
    width: int

    def __post_init__(self):
        if self.width < 1:
            raise ValueError("a band needs a width of at least 1")


def _bucket(c: Column, width: int) -> Column:
    return F.floor(c / F.lit(width)).cast("long")


def band_join(left: DataFrame, right: DataFrame, bands: Sequence[Band]) -> DataFrame:
    """Pairs of rows that lie in all ``bands``, with the columns of both sides (no name may be on both).

    NULL values and bounds match nothing. A bucket that holds very many rows is split at run time (``skew_join``); callers
    reduce equal rows of either side to one first, so that a frequent value costs one row.
    """
    if not bands:
        raise ValueError("band_join needs bands")
    values, lows, highs = [], [], []
    for i, b in enumerate(bands):
        left = left.withColumn(f"_bv{i}", b.value.cast("long"))
        right = right.withColumn(f"_bl{i}", b.low.cast("long")).withColumn(f"_bh{i}", b.high.cast("long"))
        values, lows, highs = [*values, f"_bv{i}"], [*lows, f"_bl{i}"], [*highs, f"_bh{i}"]
        right = right.where(F.col(f"_bl{i}") <= F.col(f"_bh{i}"))
        right = right.withColumn(f"_bb{i}", F.explode(F.sequence(_bucket(F.col(f"_bl{i}"), b.width),
                                                                 _bucket(F.col(f"_bh{i}"), b.width))))
    key = F.concat_ws(":", *[_bucket(F.col(v), b.width).cast("string") for v, b in zip(values, bands)])
    left = left.where(" AND ".join(f"{v} IS NOT NULL" for v in values)).withColumn("_bk", key)
    right = right.withColumn("_bkr", F.concat_ws(":", *[F.col(f"_bb{i}").cast("string") for i in range(len(bands))]))
    met = skew_join(left, right, "_bk", "_bkr", "inner")
    for v, low, high in zip(values, lows, highs):
        met = met.where(F.col(v).between(F.col(low), F.col(high)))
    return met.drop("_bk", "_bkr", *values, *lows, *highs, *[f"_bb{i}" for i in range(len(bands))])
