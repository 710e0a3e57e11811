"""Sharding by histogram sort.

All rows are put in one order (by text hash, then doc_id, so that equal texts
lie side by side) and cut into shards of near equal bytes. The cuts come from
refined histograms of a narrow (key, bytes) table, so rows are exchanged once,
straight to their part of a shard. A cut that falls among equal texts moves to
the nearer end of them where that moves at most ``SLACK`` of a shard's bytes;
else it parts them by doc_id, so one hot text never fills a shard beyond its
share. Within a shard rows are sorted and numbered in stretches of its key
range, cut again wherever one weighs more than twice ``STRETCH``, so no task
holds a whole shard or a whole hot text. DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paymatch.llm.histogram import KEY, find_cuts
from paymatch.llm.store import drop, save

SHARDS = 40
OVERHEAD = 16
#: Share of a shard's bytes that a cut may move so that equal texts stay together.
SLACK = 0.01
#: Bytes of a stretch that is sorted and numbered by itself.
STRETCH = 32 << 20
#: Least number of stretches that a crowded one is cut into.
FANOUT = 16


def size_of(text: Column) -> Column:
    """Bytes of the text in UTF-8 (null: none) and of a row's frame."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def key_of(text: Column, doc_id: Column) -> Column:
    """126 bits in order: 62 of the text's hash (null as empty), 64 of the doc_id (null first)."""
    high = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2).cast(KEY) * F.lit(str(1 << 64)).cast(KEY)
    low = F.coalesce(doc_id.cast("long").cast(KEY) + F.lit(str(1 << 63)).cast(KEY), F.lit(0).cast(KEY))
    return (high.cast(KEY) + low).cast(KEY)


def shards(docs: DataFrame, count: int = SHARDS, tolerance: float = 0.0, keep: list[str] | None = None,
           stretch: int = STRETCH) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, else all) with ``shard``, ``slot`` and ``size``.

    ``size`` is the bytes of the text and ``OVERHEAD``; each cut between shards is
    within one row of equal bytes (plus ``tolerance`` bytes, which saves rounds, and
    ``SLACK`` of a shard where that keeps equal texts together).
    ``slot`` counts from 0 in each shard, in key order. Null texts count as
    empty, null ids come first among equal texts, rows equal in text and id
    stay in one shard. Columns of ``docs`` with these three names are replaced.
    No rows give no rows; with fewer rows than shards some shards are empty.
    ``stretch`` bounds the bytes that are sorted together; rows equal in text and
    id are one stretch at least. It has no effect on the result.
    """
    text = F.col("text").cast("string")
    base = docs.drop("shard", "slot", "size")
    narrow = save(base.select(F.lit("all").alias("group"), key_of(text, F.col("doc_id")).alias("key"),
                              size_of(text).alias("weight")), "shard-keys")
    total = narrow.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    cuts = find_cuts(narrow, {"all": [total * i / count for i in range(1, count)]}, tolerance)["all"]
    cuts = _between_texts(narrow, cuts, SLACK * total / count)
    levels, counted = _stretches(narrow.withColumnRenamed("key", "_key"), cuts, stretch)
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = save(counted.select("shard", "_part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before")),
                   "shard-offsets")
    drop(narrow)
    # the rows travel as one column, so no name of theirs can clash
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or base.columns) if c in base.columns]).alias("row")
    keyed = base.select(row, size_of(text).alias("size"), key_of(text, F.col("doc_id")).alias("_key"))
    placed = _placed(keyed, cuts, levels).join(offsets, ["shard", "_part"])
    slot = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_key")) - 1 + F.col("_before")
    return placed.withColumn("slot", slot.cast("long")).select("row.*", "size", "shard", "slot")


def _between_texts(narrow: DataFrame, cuts: list[int], slack: float) -> list[int]:
    """``cuts``, those among equal texts moved to the nearer end of these if that moves at most ``slack`` bytes."""
    if not cuts:
        return cuts
    group = F.expr(f"key div cast('{1 << 64}' as {KEY})")
    weights = []
    for c in cuts:
        own, below = group == F.lit(c >> 64), F.col("key") < F.lit(str(c)).cast(KEY)
        weights += [F.sum(F.when(own & below, F.col("weight"))), F.sum(F.when(own & ~below, F.col("weight")))]
    # one row, two sums a cut
    sums = [w or 0 for w in narrow.where(group.isin(sorted({c >> 64 for c in cuts}))).agg(*weights).first()]
    moved = []
    for c, below, above in zip(cuts, sums[::2], sums[1::2]):
        start = c >> 64 << 64
        if 0 < min(below, above) <= slack:
            c = start if below <= above else start + (1 << 64)
        moved.append(c)
    return moved


def _stretches(narrow: DataFrame, cuts: list[int], stretch: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of stretches and the rows in each (columns shard, _part and rows).

    A shard starts as one stretch. Each level cuts the stretches above twice ``stretch`` bytes evenly
    between their least and greatest keys; it has a row for each of them, so at most one per
    twice ``stretch`` bytes of input. The extent shrinks to the rows found, so texts and ids that
    cluster are parted within a few levels.
    """
    levels: list[DataFrame] = []
    while True:
        counted = save(_placed(narrow, cuts, levels).groupBy("shard", "_part").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("weight"),
            F.min("_key").alias("low"), F.max("_key").alias("high")), "shard-stretches")
        parts = F.greatest(F.lit(FANOUT), F.ceil(F.col("weight") / stretch)).cast("long")
        crowded = save(counted.where((F.col("weight") > 2 * stretch) & (F.col("low") < F.col("high"))).select(
            "shard", "_part", F.col("low").alias("_from"),
            (((F.col("high") - F.col("low")).cast("double") / parts).cast(KEY) + 1).cast(KEY).alias("_width")),
            "shard-crowded")
        if crowded.isEmpty():
            return levels, counted
        levels.append(crowded)


def _placed(rows: DataFrame, cuts: list[int], levels: list[DataFrame]) -> DataFrame:
    """``rows`` with the shard of their ``_key`` and their stretch of it (``_part``, the least key it can hold)."""
    above = [F.when(F.col("_key") >= F.lit(str(c)).cast(KEY), 1).otherwise(0) for c in cuts]
    placed = rows.withColumn("shard", reduce(lambda a, b: a + b, above, F.lit(0)).cast("int"))
    placed = placed.withColumn("_part", F.lit("0").cast(KEY))
    for level in levels:
        inner = F.expr(f"cast(_from + ((_key - _from) div _width) * _width as {KEY})")
        placed = (placed.join(level, ["shard", "_part"], "left")
                  .withColumn("_part", F.coalesce(inner, F.col("_part"))).drop("_from", "_width"))
    return placed
