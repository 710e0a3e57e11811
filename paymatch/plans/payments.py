"""Payment-side plans: per-invoice payment summaries (C4, C5) and the payment check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from paymatch.functions import money, to_text
from paymatch.operators import (attach_rate, convert, present_in, row_numbers, time_window, top_per_key)
from paymatch.params import CHARGE_CATEGORIES, ReconParams
from paymatch.sources import AuditSources
from paymatch.sources.layout import whole_rows

SUM_TYPE = DecimalType(38, 2)
# Sums of one rate before they are divided: wider ones would leave the quotient fewer digits.
RATE_SUM_TYPE = DecimalType(25, 2)
PARTIAL_KEYS = ["invoice_id", "payment_method_id", "currency_id", "object_created", "object_updated"]


def newest_first() -> list:
    return [F.col("object_created").desc_nulls_first(), F.col("object_updated").desc_nulls_first()]


def payment_partials(pay: DataFrame) -> DataFrame:
    """Payments de-duplicated without their id (K9): a row per (invoice, method, currency, created, updated) and
    amount. A copy shares its creation time, so rows of whole days or months (of a layout by them) merge by union.
    They are summed once, per rate (:func:`payment_groups`): a sum here would move nearly all of them again."""
    pay = pay.where(F.col("payment_method_id").isNotNull())
    layout = [c for c in pay.columns if c not in whole_rows(pay).columns]
    rows = pay.select(*PARTIAL_KEYS, *layout, "amount").distinct()
    return rows.select(*PARTIAL_KEYS, *layout, F.col("amount").cast(RATE_SUM_TYPE).alias("_sum"))


def payment_sums(src: AuditSources, p: ReconParams, partials: DataFrame | None = None) -> DataFrame:
    """Payments created in the query window, de-duplicated without their id
    (K9) and priced.

    Rows with a NULL method are in no summary and are dropped first. Copies are removed on the raw columns, so rates are looked up
    for what is left; copies are reduced map-side. ``partials`` are those of
    :func:`payment_partials`, if they are kept by day."""
    if partials is not None:
        sums = time_window(partials, "object_created", p.query_start, p.query_end)
    else:
        sums = payment_partials(whole_rows(time_window(src.payment, "object_created", p.query_start, p.query_end)))
    # The rate day is the *update* day, which may fall outside the window.
    priced = attach_rate(sums, "currency_id", "object_updated", src.currency, src.fx_rates)
    special = F.col("payment_method_id").isin(p.special_method)
    return priced.select(special.alias("is_special"), *[k for k in PARTIAL_KEYS if k != "currency_id"], "fx_rate", "_sum")


def payment_groups(sums: DataFrame, p: ReconParams, by_method: bool = False) -> DataFrame:
    """Payments per (method is special, invoice, created, updated), with ``by_method`` per
    method as well (the drill-downs read it from C4). C4 is ``is_special`` false, C5 true."""
    keys = ["is_special", "invoice_id", "object_created", "object_updated",
            *(["payment_method_id"] if by_method else [])]
    # The amounts of one rate are summed first and divided once.
    per_rate = sums.groupBy(*keys, "fx_rate").agg(F.sum("_sum").cast(RATE_SUM_TYPE).alias("_sum"))
    return per_rate.groupBy(*keys).agg(
        F.sum("_sum").cast(SUM_TYPE).alias("amount"),
        money(F.sum(convert(F.col("_sum"), F.col("fx_rate"), p.on_zero_rate))).alias("amount_converted"))


def of_method(groups: DataFrame, special: bool) -> DataFrame:
    """The payment groups of the special method, or of all others."""
    return groups.where(F.col("is_special") == F.lit(special)).drop("is_special")


def payment_summary(groups: DataFrame) -> DataFrame:
    """The payment groups numbered newest first per invoice
    (``billing_row``). Ties on ``object_created`` are broken by
    ``object_updated`` (K10); NULLs sort first in DESC as in the reference
    dialect (T1). The numbering goes by days and by the seconds of a day, so an
    invoice with millions of payment groups on one day is spread over many tasks."""
    order = newest_first() + ([F.col("payment_method_id")] if "payment_method_id" in groups.columns else [])
    created = F.col("object_created")
    second = F.hour(created) * 3600 + F.minute(created) * 60 + F.second(created).cast("int")
    # negative, as the newest come first
    levels = [F.negative(F.unix_date(F.to_date(created))), F.negative(second)]
    numbered = row_numbers(groups, ["invoice_id"], levels, order, "billing_row")
    method = [c for c in ("payment_method_id",) if c in groups.columns]
    return numbered.select("invoice_id", "object_created", "object_updated", *method, "billing_row",
                           "amount", "amount_converted")


def latest_payment(groups: DataFrame) -> DataFrame:
    """``billing_row = 1``: the newest payment group per invoice.

    Written as a row_number filtered to 1, so Spark plans a partial
    WindowGroupLimit before the shuffle (map-side top-1).
    """
    return (top_per_key(groups, ["invoice_id"], newest_first())
            .withColumn("billing_row", F.lit(1))
            .select("invoice_id", "object_created", "object_updated", "billing_row",
                    "amount", "amount_converted"))


def clean_invoice_numbers(processor: DataFrame) -> DataFrame:
    """Invoice numbers of processor charge/refund rows that are neither retries nor short numbers."""
    return (processor.where((F.col("net_suite") == 0) & (F.col("invoices_retry") == 0)
                            & F.col("reporting_category").isin(*CHARGE_CATEGORIES))
            .select("invoice_id"))


def payment_check(src: AuditSources, p: ReconParams, processor: DataFrame) -> DataFrame:
    """Payment dates of payments whose id (quirk K5) is a clean invoice number.

    Keys are compared as text (trap T2): invoice numbers come from free text
    and may be empty or longer than a BIGINT.
    """
    pay = src.payment_for_check
    if p.payment_check_on is None:
        return pay.where(F.lit(False)).select("invoice_id", F.col("object_created").alias("billing_created"), "amount")
    key = "id" if p.payment_check_on == "id" else "invoice_id"
    hit = present_in(pay, to_text(pay[key]), clean_invoice_numbers(processor), "invoice_id")
    return hit.select("invoice_id", F.col("object_created").alias("billing_created"), "amount").distinct()
