"""Generic DataFrame operators, reusable outside the audit."""

from paymatch.operators.bands import Band, band_join
from paymatch.operators.bitmaps import bitmaps, dense_ids, merged_counts
from paymatch.operators.fx import attach_rate, convert, rate_conflicts, rate_lookup
from paymatch.operators.joins import (
    lookup_flag,
    missing_in,
    present_in,
    salted_key,
    skew_join,
    skew_joins,
)
from paymatch.operators.running import add, later, row_numbers, running
from paymatch.operators.windows import (
    number_per_key,
    time_window,
    top_per_key,
)

__all__ = [
    "Band",
    "band_join",
    "bitmaps",
    "dense_ids",
    "merged_counts",
    "add",
    "later",
    "row_numbers",
    "running",
    "attach_rate",
    "convert",
    "rate_conflicts",
    "rate_lookup",
    "lookup_flag",
    "missing_in",
    "present_in",
    "salted_key",
    "skew_join",
    "skew_joins",
    "number_per_key",
    "time_window",
    "top_per_key",
]
