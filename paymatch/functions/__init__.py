"""Scalar column helpers, all built from ``pyspark.sql.functions``.

Each returns a Column, so it stays inside whole-stage codegen; no UDFs.
"""

from paymatch.functions.columns import (
    flag,
    month_label,
    month_label_upper,
    money,
    reference_digits,
    text_date,
    ts_lit,
    date_before,
    trunc_text,
    to_text,
    minute_text,
    day_text,
)

__all__ = [
    "flag",
    "month_label",
    "month_label_upper",
    "money",
    "reference_digits",
    "text_date",
    "ts_lit",
    "date_before",
    "trunc_text",
    "to_text",
    "minute_text",
    "day_text",
]
