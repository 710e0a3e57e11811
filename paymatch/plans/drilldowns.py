"""Drill-downs the reference keeps in comments.

D5-D10 start from the invoices that have totals (C3) but neither a
processor row nor a non-special payment. In the reference that set is
"backward-direction rows with no processor match, whose latest payment has a NULL
method"; the payment summary excludes NULL methods, so a NULL method means
"no payment summary row at all", and the set is two anti joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paymatch.functions import date_before, flag, to_text, ts_lit
from paymatch.operators import missing_in, present_in, skew_join
from paymatch.params import ReconParams
from paymatch.sources import AuditSources
from paymatch.sources.layout import whole_rows


def invoice_universe(processor: DataFrame, totals: DataFrame, payments: DataFrame) -> DataFrame:
    """Every invoice id seen on any side, as text (UNION, distinct)."""
    return (processor.where(F.col("net_suite") == 0).select("invoice_id")
            .unionByName(totals.select(to_text("invoice_id").alias("invoice_id")))
            .unionByName(payments.select(to_text("invoice_id").alias("invoice_id")))
            .distinct())


def unmatched_invoices(totals: DataFrame, processor: DataFrame, payments: DataFrame) -> DataFrame:
    """Invoice ids with totals, no processor row and no payment summary row."""
    ids = totals.select("invoice_id").distinct()
    ids = missing_in(ids, to_text(ids["invoice_id"]), processor, "invoice_id")
    return missing_in(ids, ids["invoice_id"], payments, "invoice_id")


def unmatched_flags(p: ReconParams, unmatched: DataFrame, checks: DataFrame) -> DataFrame:
    """The date flags that D5, D6 and D8 carry per unmatched invoice and invoice
    check row: before_2021, paid_before and paid_after (paid after the query
    window's end); all 0 without a check row."""
    created, paid = F.col("invoice_created"), F.col("invoice_paid")
    j = unmatched.join(checks, unmatched["invoice_id"] == checks["id"], "left")
    return j.select("invoice_id", flag(date_before(created, p.source_start)).alias("before_2021"),
                    flag(date_before(paid, p.query_start)).alias("paid_before"),
                    flag(F.to_date(paid) > ts_lit(p.query_end)).alias("paid_after"))


def unmatched_payments(src: AuditSources, unmatched: DataFrame) -> DataFrame:
    """D5 "Check 1": all payment rows of the unmatched invoices."""
    pay = whole_rows(src.payment_for_check)
    return present_in(pay, pay["invoice_id"], unmatched, "invoice_id")


def unmatched_items(src: AuditSources, unmatched: DataFrame) -> DataFrame:
    """D6 "Check 2": all invoice item rows of the unmatched invoices."""
    items = whole_rows(src.invoice_item)
    return present_in(items, items["invoice_id"], unmatched, "invoice_id")


def unmatched_transactions(src: AuditSources, items: DataFrame) -> DataFrame:
    """Transactions referenced by those items."""
    txn = src.transaction
    return present_in(txn, txn["id"], items, "transaction_id")


def unmatched_totals(totals: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Invoice totals (C3) of the unmatched invoices."""
    return present_in(totals, totals["invoice_id"], unmatched, "invoice_id")


def unmatched_invoice_paid(totals: DataFrame) -> DataFrame:
    """Distinct (invoice, paid) of D8."""
    return totals.select("invoice_id", "paid").distinct()


def unmatched_owners(src: AuditSources, items: DataFrame, overrides: DataFrame) -> DataFrame:
    """Owners behind those transactions, with override and entry point."""
    txn = present_in(src.transaction, src.transaction["id"], items, "transaction_id")
    users = src.auth_user.select(F.col("id").alias("_au_id"))
    ovr = overrides.select(F.col("object_owner_id").alias("_o_owner"), "company_name_override",
                           "partner_platform")
    # A busy owner's transactions are split over several tasks.
    owners = users.join(ovr, users["_au_id"] == ovr["_o_owner"], "left").drop("_o_owner")
    j = skew_join(txn.select("object_owner_id", "entry_point"), owners, "object_owner_id", "_au_id", "inner")
    return j.select("object_owner_id", "company_name_override", "partner_platform",
                    "entry_point").distinct()
