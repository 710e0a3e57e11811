"""Tables laid out by day or month, so that a time window reads only its own periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Time column that each large table is laid out by. ---
PERIOD_COLUMNS = {"api_invoiceitem": "object_updated", "api_invoice": "paid", "billing_payment": "object_created"}
GRAINS = ("day", "month")


def period_name(column: str, grain: str) -> str:
    """Name of the partition column that holds the first day of the period of ``column``."""
    return f"_{grain}_{column}"


def period(value: Column, grain: str) -> Column:
    """First day of the period of a time."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {', '.join(GRAINS)}, not {grain!r}")
    return F.to_date(value) if grain == "day" else F.trunc(F.to_date(value), grain)


def write_by_period(df: DataFrame, path: str, column: str, grain: str = "day", mode: str = "append") -> None:
    """Write ``df`` partitioned by the day or month of ``column`` (NULL: a partition of its own).

    Rows are rebalanced by period at run time: small periods share tasks, and one that
    holds a third of all rows is split into as many tasks and files as its size asks for.
    """
    name = period_name(column, grain)
    dated = df.withColumn(name, period(F.col(column), grain))
    dated.hint("rebalance", name).write.mode(mode).partitionBy(name).parquet(path)


def within(df: DataFrame, column: str, start: Column, end: Column) -> DataFrame:
    """``df`` cut to the periods that rows with ``start <= column < end`` lie in, if it is laid out by ``column``."""
    for grain in GRAINS:
        name = period_name(column, grain)
        if name in df.columns:
            df = df.where((F.col(name) >= period(start, grain)) & (F.col(name) <= period(end, grain)))
    return df


def whole_rows(df: DataFrame) -> DataFrame:
    """``df`` without the columns that a layout added."""
    return df.drop(*[c for c in df.columns if c.startswith(tuple(f"_{g}_" for g in GRAINS))])
