"""Matches beyond the equality of invoice numbers: fuzzy candidates for rows that
matched nothing (C1's bounds), candidates from every number of a description
(F11, K4), and receipts allocated to charges so that each amount counts once (C9, K7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from paymatch.functions import text_date, to_text
from paymatch.operators import Band, add, band_join, later, missing_in, running, salted_key, skew_join
from paymatch.params import CHARGE_CATEGORIES, RECEIPT_CATEGORY, ReconParams

#: Longest month, in days: an upper bound of the date window's width.
LONGEST_MONTH = 31
#: Bits of the finer levels of a running total over cents: 65,536 positions a part.
POSITION_BITS = 16
#: Owners per part in the order of an invoice's charges.
OWNER_BITS = 12
AMOUNT = DecimalType(38, 2)


def cents(c: str | Column) -> Column:
    return ((F.col(c) if isinstance(c, str) else c) * 100).cast("long")


def fuzzy_candidates(p: ReconParams, processor: DataFrame, invoice_totals: DataFrame) -> DataFrame:
    """Invoices that a charge or refund without an invoice may belong to, by amount and date.

    A candidate's charges in USD differ from the row's gross by ``p.fuzzy_tolerance`` at most, and the
    row's day lies between ``p.fuzzy_min_days`` days and ``p.fuzzy_max_months`` months after the invoice
    was paid. Returns per row with a candidate how many there are and the nearest (by amount, days, number).

    Rows of one amount and day, and invoices of one amount and day, are one row each in
    the band join, so a frequent price costs its days and not its rows.
    """
    rows = processor.where(F.col("reporting_category").isin(*CHARGE_CATEGORIES) & F.col("gross").isNotNull()
                           & F.col("created_utc").isNotNull())
    key = salted_key("invoice_id", "balance_transaction_id", "created_utc", blank=True)
    rows = missing_in(rows, key, invoice_totals.select(to_text("invoice_id").alias("invoice_id")), "invoice_id")
    rows = rows.withColumn("_cents", cents("gross")).withColumn("_day", F.unix_date(text_date("created_utc")))
    asked = rows.select("_cents", "_day").where(F.col("_day").isNotNull()).distinct()
    paid = F.to_date("paid")
    invoices = (invoice_totals.where(F.col("converted_invcharge").isNotNull() & F.col("paid").isNotNull())
                .select(cents("converted_invcharge").alias("_inv_cents"), paid.alias("_paid"), "invoice_id")
                .groupBy("_inv_cents", "_paid").agg(F.count(F.lit(1)).alias("_n"), F.min("invoice_id").alias("_first")))
    slack = int(p.fuzzy_tolerance * 100)
    window = p.fuzzy_max_months * LONGEST_MONTH + abs(p.fuzzy_min_days) + 1
    met = band_join(asked, invoices, [
        Band(F.col("_cents"), F.col("_inv_cents") - slack, F.col("_inv_cents") + slack, max(1, 2 * slack)),
        Band(F.col("_day"), F.unix_date(F.date_add("_paid", p.fuzzy_min_days)),
             F.unix_date(F.add_months("_paid", p.fuzzy_max_months)), window)])
    one = Window.partitionBy("_cents", "_day")
    met = (met.withColumn("amount_gap", F.abs(F.col("_cents") - F.col("_inv_cents")))
           .withColumn("day_gap", F.abs(F.col("_day") - F.unix_date("_paid"))))
    found = (met.withColumn("candidates", F.sum("_n").over(one))
             .withColumn("_rank", F.row_number().over(one.orderBy("amount_gap", "day_gap", "_first"))).where("_rank = 1")
             .select(F.concat_ws(":", "_cents", "_day").alias("_found"), "candidates",
                     F.col("_first").alias("nearest_invoice_id"), "amount_gap", "day_gap"))
    out = skew_join(rows, found, F.concat_ws(":", "_cents", "_day"), "_found", "inner")
    return out.select("balance_transaction_id", "description", "reporting_category", "created_utc", "gross", "candidates",
                      "nearest_invoice_id", (F.col("amount_gap").cast(AMOUNT) / 100).cast(AMOUNT).alias("amount_gap"), "day_gap")


def reference_candidates(processor: DataFrame, invoice: DataFrame) -> DataFrame:
    """Every processor row with the known invoices among the numbers of its description.

    The audit glues all digits of a description together, which loses the invoice of a retry ("Invoice 1969107 -
    retry 2"). Here each run of digits is looked up on its own in an inverted index of
    the distinct descriptions; of several known ones the longest is the candidate, then the first. Numbers
    that very many descriptions share (such as the count of a retry) are split at run time.
    """
    texts = processor.select("description").where(F.col("description").isNotNull()).distinct()
    runs = texts.select("description", F.posexplode(F.regexp_extract_all("description", F.lit("([0-9]+)"))).alias("at", "run"))
    known = invoice.select(to_text("id").alias("_number")).where(F.col("_number").isNotNull()).distinct()
    hits = skew_join(runs, known, "run", "_number", "inner")
    one = Window.partitionBy("description")
    found = (hits.withColumn("known_numbers", F.count(F.lit(1)).over(one))
             .withColumn("_rank", F.row_number().over(one.orderBy(F.length("run").desc(), "at"))).where("_rank = 1")
             .select(F.col("description").alias("_text"), "known_numbers", F.col("run").alias("_best")))
    out = skew_join(processor, found, salted_key("description", "balance_transaction_id", "created_utc"), "_text", "left")
    candidate = F.col("_best")
    return out.select("balance_transaction_id", "description", "reporting_category", "created_utc", "gross", "invoice_id",
                      F.coalesce("known_numbers", F.lit(0)).cast("long").alias("known_numbers"),
                      candidate.alias("candidate_invoice_id"),
                      (candidate.isNotNull() & ~candidate.eqNullSafe(F.col("invoice_id"))).alias("recovered"))


def receipts(processor: DataFrame) -> DataFrame:
    """Clean charges of the processor, one row per invoice number and transaction."""
    rows = processor.where((F.col("reporting_category") == RECEIPT_CATEGORY) & (F.col("invoices_retry") == 0)
                           & (F.col("net_suite") == 0) & (F.col("invoice_id") != ""))
    return (rows.groupBy("invoice_id", "created_utc", "balance_transaction_id").agg(F.sum("gross").alias("amount"))
            .where(F.col("amount") > 0))


def _intervals(rows: DataFrame, levels: list[Column], order: list[Column]) -> DataFrame:
    """Each amount as the stretch ``lo..hi`` (in cents) that it takes of its invoice's total."""
    summed = running(rows.withColumn("_c", cents("amount")), ["invoice_id"], levels, order, {"hi": F.col("_c")}, F.sum, add)
    return summed.withColumn("lo", F.col("hi") - F.col("_c"))


def charge_intervals(totals_by_owner: DataFrame) -> DataFrame:
    """Charges in USD per invoice, paid date and owner, end to end by date and owner."""
    charges = (totals_by_owner.where(F.col("converted_invcharge") > 0)
               .select(to_text("invoice_id").alias("invoice_id"), "paid", "object_owner_id",
                       F.col("converted_invcharge").alias("amount")))
    return _intervals(charges, [F.col("paid"), F.shiftright("object_owner_id", OWNER_BITS)],
                      [F.col("object_owner_id").asc_nulls_first()])


def receipt_intervals(processor: DataFrame) -> DataFrame:
    """Receipts per invoice number, end to end by time and transaction."""
    return _intervals(receipts(processor), [F.col("created_utc")], [F.col("balance_transaction_id").asc_nulls_first()])


def _edges(intervals: DataFrame, name: str) -> DataFrame:
    """(invoice, position, and the position again where an interval begins) of both ends of every interval."""
    both = F.array(F.struct(F.col("lo").alias("at"), F.col("lo").alias(name)),
                   F.struct(F.col("hi").alias("at"), F.lit(None).cast("long").alias(name)))
    return intervals.select("invoice_id", F.inline(both))


def recon_allocated(charges: DataFrame, receipts: DataFrame) -> DataFrame:
    """Processor receipts allocated to invoice charges, first in, first out.

    The reconciliation repeats an invoice's amounts for every row that it is joined to (K7). Here charges
    (:func:`charge_intervals`) and receipts (:func:`receipt_intervals`) lie end to end along the invoice, and each
    stretch between two neighbouring edges is one row: the amount that this receipt pays of this charge. A charge
    without a receipt, or a receipt without a charge, has NULLs on the other side, so the rows of a charge or of a
    receipt add up to its amount. Amounts that are NULL or not positive are left out.

    An invoice with m charges and n receipts gives m + n rows at most; no pairs are made, and an invoice of any size
    is spread over tasks (:func:`paymatch.operators.running`).
    """
    # an end is mostly the next one's beginning
    edges = (_edges(charges, "charge").unionByName(_edges(receipts, "receipt"), allowMissingColumns=True)
             .groupBy("invoice_id", "at").agg(F.max("charge").alias("_charge"), F.max("receipt").alias("_receipt")))
    # where the last charge and the last receipt begin that lie at or before each edge
    levels = [F.shiftright("at", 2 * POSITION_BITS), F.shiftright("at", POSITION_BITS)]
    held = running(edges, ["invoice_id"], levels, [F.col("at")],
                   {"charge": F.col("_charge"), "receipt": F.col("_receipt")}, F.max, later)
    for side, found in (("charge", charges.select("paid", "object_owner_id", "invoice_id", "lo", "hi")),
                        ("receipt", receipts.select("created_utc", "balance_transaction_id", "invoice_id", "lo", "hi"))):
        found = found.withColumnsRenamed({"invoice_id": f"_{side}_of", "lo": f"_{side}_lo", "hi": f"_{side}_hi"})
        held = held.join(found, (F.col("invoice_id") == F.col(f"_{side}_of")) & (F.col(side) == F.col(f"_{side}_lo"))
                         & (F.col(f"_{side}_hi") > F.col("at")), "left")
    end = F.least("_charge_hi", "_receipt_hi")
    return held.where(end.isNotNull()).select(
        "invoice_id", "paid", "object_owner_id", "created_utc", "balance_transaction_id",
        ((end - F.col("at")).cast(AMOUNT) / 100).cast(AMOUNT).alias("allocated"))
