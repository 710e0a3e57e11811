"""Distinct counts as bitmaps that merge, so that coarser counts need no second look at the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.operators.running import add, running

#: Bits of the hash that each of two levels of the numbering goes by.
LEVEL_BITS = 12


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct values of a column, numbered from 1 without gaps as ``name`` (a dictionary).

    NULL has no number. Values are numbered in the order of their hash by :func:`running`: no
    task sees more than the values of one of 2^24 parts, and the numbers are a function of the values alone.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    digest = F.xxhash64(column)
    levels = [F.shiftrightunsigned(digest, 64 - LEVEL_BITS),
              F.shiftrightunsigned(digest, 64 - 2 * LEVEL_BITS).bitwiseAND((1 << LEVEL_BITS) - 1)]
    return running(values, [], levels, [F.col(column)], {name: F.lit(1)}, F.sum, add)


def bitmaps(df: DataFrame, keys: Sequence[str], number: str, values: Sequence[Column] = ()) -> DataFrame:
    """Per key and block of 32,768 numbers (``_block``) the set of ``number`` as a bitmap of 4 KB (``_bits``), and ``values``."""
    return df.groupBy(*keys, F.bitmap_bucket_number(number).alias("_block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"), *values)


def merged_counts(maps: DataFrame, keys: Sequence[str], grains: Sequence[Sequence[str]], name: str,
                  sums: Sequence[str] = ()) -> DataFrame:
    """Distinct counts (``name``) and ``sums`` at several subsets of ``keys``, from :func:`bitmaps` alone.

    Each row's ``grain`` lists the keys that it is grouped by, comma-joined; the other keys are NULL. Bitmaps
    of a block are united first, so a number that several keys hold counts once.
    """
    sets = [[F.col(k) for k in grain] + [F.col("_block")] for grain in grains]
    united = maps.groupingSets(sets, *[F.col(k) for k in keys], F.col("_block")).agg(
        F.grouping_id().alias("_grain"), F.bitmap_or_agg("_bits").alias("_bits"), *[F.sum(s).alias(s) for s in sums])
    label = F.lit(None).cast("string")
    for grain in grains:
        # one bit a key, the last one (the block) always grouped by
        code = sum(1 << (len(keys) - i) for i, k in enumerate(keys) if k not in grain)
        label = F.when(F.col("_grain") == code, ",".join(grain)).otherwise(label)
    return united.withColumn("grain", label).groupBy("grain", *keys).agg(
        F.sum(F.bitmap_count("_bits")).cast("long").alias(name), *[F.sum(s).alias(s) for s in sums])
