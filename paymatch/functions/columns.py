"""Column expressions for the reference dialect's scalar functions.

The reference is warehouse SQL; a few of its functions behave differently
reference behaviour down with built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, TimestampNTZType

MONEY = DecimalType(15, 2)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ts_lit(text: str) -> Column:
    """Zone-less timestamp literal (the sources are ``timestamp_ntz``)."""
    return F.lit(text).cast(TimestampNTZType())


def money(col: str | Column) -> Column:
    """``::numeric(15,2)``: rounds half away from zero, like the reference."""
    return _c(col).cast(MONEY)


def trunc_text(col: str | Column, n: int) -> Column:
    """``::varchar(n)`` truncates in the reference; Spark's cast does not."""
    return F.substring(_c(col), 1, n)


def to_text(col: str | Column) -> Column:
    return _c(col).cast("string")


def text_date(col: str | Column) -> Column:
    """``TO_DATE(text, 'YYYY-MM-DD')`` on text that may carry a time part.

    The reference reads the leading date and ignores the rest; Spark's
    ``to_date`` with a pattern raises on the extra text under ANSI mode.
    """
    return F.substring(_c(col), 1, 10).cast("date")


def month_label(col: str | Column) -> Column:
    """``TO_CHAR(d, 'Mon-YY')`` → ``Jan-22``."""
    return F.date_format(_c(col), "MMM-yy")


def month_label_upper(col: str | Column) -> Column:
    """``TO_CHAR(ts, 'MON-YY')`` → ``JAN-22``."""
    return F.upper(F.date_format(_c(col), "MMM-yy"))


def day_text(col: str | Column) -> Column:
    """``TO_CHAR(ts, 'YYYY-MM-DD')``."""
    return F.date_format(_c(col), "yyyy-MM-dd")


def minute_text(col: str | Column) -> Column:
    """``TO_CHAR(ts, 'YYYY-MM-DD HH24:MI')``."""
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm")


def date_before(col: str | Column, ts_text: str) -> Column:
    """``col::date < timestamp``: the date is promoted to midnight."""
    return F.to_date(_c(col)).cast(TimestampNTZType()) < ts_lit(ts_text)


def reference_digits(col: str | Column) -> Column:
    """``REGEXP_REPLACE(text, '[^0-9]+', '')``: every digit, concatenated.

    "Invoice 1969107 - retry 2" gives "19691072" (quirk K4); text without
    digits gives the empty string; NULL stays NULL.
    """
    return F.regexp_replace(_c(col), "[^0-9]+", "")


def flag(cond: Column) -> Column:
    """``CASE WHEN cond THEN 1 ELSE 0 END``; a NULL condition gives 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))
