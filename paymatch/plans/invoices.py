"""Invoice-side plans: charge/refund totals in USD (C3) and item drill-downs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, TimestampNTZType

from paymatch.functions import minute_text, money, to_text, ts_lit
from paymatch.operators import attach_rate, convert, present_in, skew_join, time_window
from paymatch.params import REFUND_PURPOSE, ReconParams
from paymatch.sources import AuditSources
from paymatch.sources.layout import whole_rows, within

SUM_TYPE = DecimalType(38, 2)
# Sums of one rate before they are divided: wider ones would leave the quotient fewer digits.
RATE_SUM_TYPE = DecimalType(25, 2)
ITEM_DAY = "updated_day"


def item_totals(src: AuditSources, p: ReconParams) -> DataFrame:
    """Charges and refunds per (invoice, owner, rate) over the query window,
    local and converted, not yet rounded. Both grains of C3 follow from it. The
    amounts of one rate are summed first and divided once.

    Items are aggregated *before* the join to invoices (map-side partial
    aggregation), so an invoice with a huge number of items costs one row
    per owner and rate in the join."""
    items = time_window(src.invoice_item, "object_updated", p.query_start, p.query_end)
    items = items.where(F.col("amount").isNotNull() & F.col("invoice_id").isNotNull())
    items = attach_rate(items, "currency_id", "object_updated", src.currency, src.fx_rates,
                        p.query_start, p.query_end)
    return _converted(items.groupBy("invoice_id", "object_owner_id", "fx_rate").agg(*_item_sums()), p)


def _item_sums() -> list[Column]:
    refund = F.col("object_purpose") == REFUND_PURPOSE
    charge = F.col("object_purpose") != REFUND_PURPOSE
    amount = F.col("amount")
    return [F.sum(F.when(charge, amount)).alias("_charge"), F.sum(F.when(refund, -amount)).alias("_refund")]


def item_partials(items: DataFrame) -> DataFrame:
    """Local sums per (update day, invoice, owner, currency) of items laid out by day or month. They hold no
    rate, so a corrected rate table changes none of them."""
    layout = [c for c in items.columns if c not in whole_rows(items).columns]
    items = items.where(F.col("amount").isNotNull() & F.col("invoice_id").isNotNull())
    return items.groupBy(*layout, F.to_date("object_updated").alias(ITEM_DAY), "invoice_id", "object_owner_id", "currency_id").agg(*_item_sums())


def merged_item_totals(partials: DataFrame, src: AuditSources, p: ReconParams) -> DataFrame:
    """:func:`item_totals` from daily partials; the query window must consist of whole days."""
    for bound in (p.query_start, p.query_end):
        if not bound.endswith(" 00:00:00"):
            raise ValueError(f"daily partials need a window of whole days, not {bound}")
    day = F.col(ITEM_DAY)
    days = within(partials, "object_updated", ts_lit(p.query_start), ts_lit(p.query_end)).where((day >= F.to_date(ts_lit(p.query_start))) & (day < F.to_date(ts_lit(p.query_end))))
    priced = attach_rate(days, "currency_id", ITEM_DAY, src.currency, src.fx_rates, p.query_start, p.query_end)
    return _converted(priced.groupBy("invoice_id", "object_owner_id", "fx_rate").agg(
        *[F.sum(c).cast(RATE_SUM_TYPE).alias(c) for c in ("_charge", "_refund")]), p)


def _converted(sums: DataFrame, p: ReconParams) -> DataFrame:
    return sums.select(
        "invoice_id", "object_owner_id", "_charge", "_refund",
        convert(F.col("_charge"), F.col("fx_rate"), p.on_zero_rate).alias("_conv_charge"),
        convert(F.col("_refund"), F.col("fx_rate"), p.on_zero_rate).alias("_conv_refund"))


def invoice_totals(src: AuditSources, p: ReconParams, items: DataFrame, by_owner: bool = False) -> DataFrame:
    """Charges and refunds per paid invoice, local and converted to USD.

    Grain (invoice_id, paid) — plus object_owner_id with ``by_owner`` (V2).
    The reference sums per (invoice, paid, item update) and then sums those
    sums; the sums of ``items`` (:func:`item_totals`) give the same rows
    (R6). The rounding cast to numeric(15,2) applies to the final sum only.
    """
    # Summing after the join keeps a duplicated invoice row exact (its item
    # sums count twice, as in the reference's join); the sum runs on data the
    # join already partitioned by invoice_id, so it adds no shuffle.
    invoices = (time_window(src.invoice, "paid", p.query_start, p.query_end)
                .select(F.col("id").alias("_inv_id"), "paid"))
    j = items.join(invoices, items["invoice_id"] == invoices["_inv_id"], "inner")
    return j.groupBy("invoice_id", "paid", *(["object_owner_id"] if by_owner else [])).agg(
        F.sum("_charge").cast(SUM_TYPE).alias("invcharge"),
        F.sum("_refund").cast(SUM_TYPE).alias("invrefund"),
        money(F.sum("_conv_charge")).alias("converted_invcharge"),
        money(F.sum("_conv_refund")).alias("converted_invrefund"),
    )


def item_dates(src: AuditSources) -> DataFrame:
    """Per invoice, over items with an amount: latest update (``_upd_max``)
    and first creation (``_created_min``).

    The three item drill-downs (D2-D4) read the whole item table with no
    window; one aggregation serves all three, so the largest table is
    scanned once, and partial aggregation absorbs a busy invoice.
    ``max(to_char(ts))`` equals ``to_char(max(ts))`` because the text format
    orders like the timestamp, so the aggregate runs on the timestamp.
    """
    has_amount = F.col("amount").isNotNull()
    return src.invoice_item.groupBy("invoice_id").agg(
        F.max(F.when(has_amount, F.col("object_updated"))).alias("_upd_max"),
        F.min(F.when(has_amount, F.col("object_created"))).alias("_created_min"))


def payment_dates(src: AuditSources, p: ReconParams) -> DataFrame:
    """Distinct (invoice, creation) of all payments, and whether one of them has a non-special
    method (``_other``, NULL if no method is known): one scan and one exchange serve D2 and D4."""
    other = ~F.col("payment_method_id").isin(p.special_method)
    return src.payment_for_check.groupBy("invoice_id", "object_created").agg(F.max(other).alias("_other"))


def invoice_payment_dates(p: ReconParams, universe: DataFrame, dates: DataFrame, payments: DataFrame) -> DataFrame:
    """Per invoice of ``universe`` and payment date, latest item update as text.

    Inner joins of the universe to items and to non-special payments; the
    max over items is the same for every payment row, so items are reduced
    to one row per invoice before joining (a busy invoice's payment dates
    are split, see ``skew_join``).
    """
    latest = dates.select("invoice_id", F.col("_upd_max").alias("_ts"))
    latest = present_in(latest, to_text(latest["invoice_id"]), universe, "invoice_id")
    pay = payments.where("_other").select(F.col("invoice_id").alias("_bp_id"), "object_created")
    j = skew_join(pay, latest.hint("shuffle_hash"), "_bp_id", "invoice_id", "inner")
    return j.select(to_text("invoice_id").alias("invoice_id"),
                    F.col("object_created").alias("date_info_billing_date"),
                    minute_text("_ts").alias("date_info_invoice_date"))


def first_item_cutoff(p: ReconParams, processor: DataFrame, dates: DataFrame) -> DataFrame:
    """D3: first item creation per processor-matched invoice, and a cut-off flag."""
    first = dates.select("invoice_id", F.col("_created_min").alias("_ts"))
    first = present_in(first, to_text(first["invoice_id"]), processor, "invoice_id")
    text = minute_text("_ts")
    return first.select(
        to_text("invoice_id").alias("invoice_id"),
        text.alias("first_created_date"),
        F.when(F.substring(text, 1, 10).cast("date") <= F.to_date(F.lit(p.first_item_cutoff)), 1)
        .otherwise(0).alias("before_2019"),
    )


def late_update_flag(p: ReconParams, processor: DataFrame, dates: DataFrame, payments: DataFrame) -> DataFrame:
    """Per processor invoice number, is the latest item update after a payment?

    The reference joins every payment row and keeps DISTINCT flags. The set
    of flags is decided by the earliest and latest payment alone: 1 occurs
    iff the update day is after the earliest payment, 0 iff there is no
    payment, no update day, or a payment at or after it. So payments are
    reduced to (min, max) per invoice — no fan-out, no hot group.
    """
    latest, pay = dates, payments
    if p.late_update_invoice is not None:
        latest = latest.where(F.col("invoice_id") == p.late_update_invoice)
        pay = pay.where(F.col("invoice_id") == p.late_update_invoice)
    if p.billing_floor is not None:
        pay = pay.where(F.col("object_created") >= ts_lit(p.billing_floor))
    latest = latest.select(
        to_text("invoice_id").alias("_inv_k"),
        F.to_date(F.substring(minute_text("_upd_max"), 1, 10)).cast(TimestampNTZType()).alias("_upd"))
    span = (pay.groupBy(to_text("invoice_id").alias("_bp_k"))
            .agg(F.min("object_created").alias("_first"), F.max("object_created").alias("_last")))
    ids = processor.select("invoice_id").distinct()
    j = (ids.join(latest, ids["invoice_id"] == latest["_inv_k"], "left")
         .join(span, ids["invoice_id"] == span["_bp_k"], "left"))
    one = F.coalesce(F.col("_upd") > F.col("_first"), F.lit(False))
    zero = F.col("_first").isNull() | F.col("_upd").isNull() | (F.col("_upd") <= F.col("_last"))
    flags = F.filter(F.array(F.when(one, F.lit(1)), F.when(zero, F.lit(0))), lambda x: x.isNotNull())
    return j.select("invoice_id", F.explode(flags).alias("later_than_updated"))
