"""Cut points of weighted keys by refined histograms.

Given rows (group, key, weight) and target weights per group, find the keys at
which the running weight in key order comes nearest to each target. Each round
counts exact weights below evenly spaced probes inside the interval that still
holds each cut, and goes on within the one bin where the target falls, until
the bin is a single key or weighs no more than the tolerance. Rows never move;
a round returns at most ``PROBES`` partial sums to the driver, however many
rows there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBES = 16384
KEY = "decimal(38,0)"


@dataclass
class _Search:
    """One target: the cut lies in ``low..high``; ``below`` weighs less than ``low``."""

    group: str
    target: float
    low: int
    high: int
    below: int = 0
    cut: int | None = None


def find_cuts(rows: DataFrame, targets: dict[str, list[float]], tolerance: float = 0.0) -> dict[str, list[int]]:
    """Cuts per group, in the order of ``targets``; rows with ``key < cut`` lie below it.

    ``rows``: columns group (string), key (decimal(38,0), not null) and weight
    (long, at least 0). A group without rows has all its cuts at 0. With
    ``tolerance`` 0 the result depends on the rows alone, not on their order
    or partitions; equal keys are never parted.
    """
    extent = {r[0]: (int(r[1]), int(r[2])) for r in
              rows.where(F.col("group").isin(*targets)).groupBy("group")
              .agg(F.min("key"), F.max("key")).collect()} if targets else {}
    searches = [_Search(g, t, *extent[g]) for g, ts in targets.items() if g in extent for t in ts]
    while any(s.cut is None for s in searches):
        _round(rows, [s for s in searches if s.cut is None], tolerance)
    cuts: dict[str, list[int]] = {g: [] if g in extent else [0] * len(ts) for g, ts in targets.items()}
    for s in searches:
        cuts[s.group].append(s.cut)
    return cuts


def _round(rows: DataFrame, searches: list[_Search], tolerance: float) -> None:
    spans = sorted({(s.group, s.low, s.high) for s in searches})
    probes = max(8, PROBES // len(spans))
    numbered = [(i, g, Decimal(low), Decimal(high), Decimal(-(-(high - low + 1) // probes)))
                for i, (g, low, high) in enumerate(spans)]
    table = rows.sparkSession.createDataFrame(numbered, f"span int, g string, low {KEY}, high {KEY}, width {KEY}")
    # as many rows as open intervals: one per target at most
    inside = rows.join(F.broadcast(table), (F.col("group") == F.col("g")) & F.col("key").between(
        F.col("low"), F.col("high")))
    counted = (inside.groupBy("span", F.expr("(key - low) div width").alias("bin"))
               .agg(F.sum("weight").alias("weight"), F.min("key").alias("low"), F.max("key").alias("high")))
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for r in counted.collect():
        bins.setdefault(r.span, []).append((int(r.low), int(r.high), int(r.weight)))
    number = {s: i for i, s in enumerate(spans)}
    for s in searches:
        _narrow(s, sorted(bins[number[s.group, s.low, s.high]]), tolerance)


def _narrow(s: _Search, bins: list[tuple[int, int, int]], tolerance: float) -> None:
    """Go on in the bin where the running weight passes the target."""
    for low, high, weight in bins:
        if s.below + weight > s.target:
            if low == high or weight <= tolerance:
                nearer_above = s.below + weight - s.target < s.target - s.below
                s.cut = high + 1 if nearer_above else low
            s.low, s.high = low, high
            return
        s.below += weight
    s.cut = bins[-1][1] + 1
