"""Currency conversion with a daily rate table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.functions import money, trunc_text


def rate_lookup(rates: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The reference's rate lookup: distinct (code::varchar(5), day, rate::numeric(15,2)).

    The rate is rounded to two decimals *before* any division (trap T5).
    With a window, only days that facts inside it can look up are kept.
    """
    out = rates.select(trunc_text("currency", 5).alias("fx_iso"),
                       F.col("date").cast("date").alias("fx_date"),
                       money("rate").alias("fx_rate"))
    if start is not None:
        out = out.where(F.col("fx_date") >= F.to_date(F.lit(start)))
    if end is not None:
        out = out.where(F.col("fx_date") <= F.to_date(F.lit(end)))
    return out.distinct()


def rate_conflicts(rates: DataFrame) -> DataFrame:
    """Currency days with more than one rate: each would repeat the facts that look it up."""
    return rate_lookup(rates).groupBy("fx_iso", "fx_date").agg(F.count(F.lit(1)).alias("rates")).where("rates > 1")


def attach_rate(df: DataFrame, currency_id: str, ts: str, currencies: DataFrame,
                rates: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Left-join the currency code and the exact-day rate as ``fx_rate``.

    Both sides are small dimensions, which Spark broadcasts by their size in
    bytes. One that outgrows the threshold is joined by plain exchanges on both
    sides, so a currency that holds most facts is split at run time.
    A (currency, day) with two different rates duplicates the fact row, as
    in the reference.
    """
    cur = currencies.select(F.col("id").alias("_cur_id"), F.col("iso").alias("_cur_iso"))
    lk = rate_lookup(rates, start, end)
    j = df.join(cur, df[currency_id] == cur["_cur_id"], "left")
    j = j.join(lk, (j["_cur_iso"] == lk["fx_iso"]) & (F.to_date(j[ts]) == lk["fx_date"]), "left")
    return j.drop("_cur_id", "_cur_iso", "fx_iso", "fx_date")


def convert(amount: Column, rate: Column, on_zero: str = "null") -> Column:
    """``amount / rate``; a rate of 0.00 gives NULL (``on_zero='null'``) or raises."""
    if on_zero == "error":
        return amount / rate
    return F.try_divide(amount, rate)
