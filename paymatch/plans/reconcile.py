"""Two-way reconciliation: processor → invoices (C9a), invoices → processor
(C9b), their union (C9) and the flag report (C10).

The reference left-joins each driving row to five per-invoice tables and
sums over the joined rows. Two of those tables hold several rows per
invoice (invoice totals per owner/paid date; the payment check), so an
invoice's amounts are repeated once per combination (quirk K7). Emitting
those combinations is quadratic on a busy invoice. Instead every right side
is reduced to one row per invoice (or per invoice and output key) carrying
its row count, and the sums are multiplied by the counts: the same numbers,
exactly, in linear work.

Plan shape per direction: pre-aggregate the driving side on its own output
keys (partial aggregation absorbs hot keys and copies), then one left join
to a per-invoice profile that stacks all counted and summed lookup sides (one
shuffle, one join, split at run time when an invoice number is busy). The top
processor row, the one side that is not a sum, is a table of its own that only
the backward direction joins. Each result row is already unique on the output
keys, so no final aggregation is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType

from paymatch.functions import date_before, flag, month_label, to_text
from paymatch.operators import bitmaps, dense_ids, merged_counts, salted_key, skew_join, skew_joins, top_per_key
from paymatch.params import PREAUTH_TEXT, ReconParams

SUM_TYPE = DecimalType(38, 2)
COUNT_TYPE = DecimalType(38, 0)
MEASURES = ["customer_facing_amount", "gross", "net", "usd_invcharge", "usd_invrefund",
            "billing_amount", "braintree_amount"]
FLAG_KEYS = ["strp_flag", "inv_flag", "billing_flag", "braintree_flag", "before_2021",
             "paid_before", "pre_auth", "invoices_retry", "net_suite"]
SUMMARY_KEYS = ["month", "category", "reporting_category", "invoice_id", "description"] + FLAG_KEYS
REPORT_KEYS = ["month", "category", "reporting_category"] + FLAG_KEYS
# Grains of the coarser reports: the report's own, and subsets of its keys.
ROLLUP_GRAINS = (REPORT_KEYS, ["month", "category"], ["category", "strp_flag", "inv_flag"], ["month"], [])


@dataclass
class ReconInputs:
    """The intermediate tables both directions read."""

    invoice_totals: DataFrame   # C3 (V1 grain, or V2 grain with object_owner_id)
    payments_other: DataFrame   # C4 with billing_row = 1
    payments_special: DataFrame  # C5 with billing_row = 1
    processor: DataFrame        # C6
    invoice_check: DataFrame    # C7
    payment_check: DataFrame    # C8


def _matchable(key: Column) -> Column:
    """NULL and empty keys can never equal an invoice number."""
    return key.isNotNull() & (key != "")


def invoice_profile(inp: ReconInputs, p: ReconParams) -> DataFrame:
    """The counts and amounts that the two directions look up, one row per invoice key.

    The check, payment-check and latest-payment sides are stacked
    (``unionByName``) and reduced by a single hash aggregation — one
    partial-aggregated shuffle, so a busy invoice is pre-reduced map-side —
    instead of four separately shuffled join partners:

    * invoice check (C7): row counts per (before_2021, paid_before), since
      those two flags are output keys (up to four combinations);
    * payment check (C8): row count — its only visible effect is fan-out;
    * latest method-3 / other payment (C5/C4, ``billing_row = 1``): amount.
    """
    def key(c: str) -> Column:
        return to_text(c).alias("_k")

    parts = [
        inp.invoice_check.select(
            key("id"), F.lit(1).alias("_src"),
            flag(date_before("invoice_created", p.source_start)).alias("_b21"),
            flag(date_before("invoice_paid", p.query_start)).alias("_pb")),
        inp.payment_check.select(key("invoice_id"), F.lit(2).alias("_src")),
        inp.payments_special.select(key("invoice_id"), F.lit(3).alias("_src"),
                                    F.col("amount_converted").alias("_amt")),
        inp.payments_other.select(key("invoice_id"), F.lit(4).alias("_src"),
                                  F.col("amount_converted").alias("_amt")),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    stacked = stacked.where(_matchable(F.col("_k")))
    src = F.col("_src")

    def ic(b21: int, pb: int) -> Column:
        return F.count(F.when((src == 1) & (F.col("_b21") == b21) & (F.col("_pb") == pb), 1))

    return stacked.groupBy("_k").agg(
        ic(0, 0).alias("_ic00"), ic(0, 1).alias("_ic01"), ic(1, 0).alias("_ic10"), ic(1, 1).alias("_ic11"),
        F.count(F.when(src == 2, 1)).alias("_n_bc"),
        F.max(F.when(src == 3, True)).alias("_bt_hit"), F.sum(F.when(src == 3, F.col("_amt"))).alias("_bt"),
        F.max(F.when(src == 4, True)).alias("_bp_hit"), F.sum(F.when(src == 4, F.col("_amt"))).alias("_bp"),
    )


def top_processor(processor: DataFrame) -> DataFrame:
    """Per invoice number the processor row with the highest gross.

    Order: gross DESC NULLS FIRST (T1), then balance transaction id, net,
    amount, description (K10). A rank filtered to 1, so each map task sends on
    only its own best row per invoice.
    """
    rows = processor.select(to_text("invoice_id").alias("_k"), "gross", "net", "customer_facing_amount",
                            "description", "balance_transaction_id").where(_matchable(F.col("_k")))
    order = [F.col("gross").desc_nulls_first(), *(F.col(c).asc_nulls_first() for c in (
        "balance_transaction_id", "net", "customer_facing_amount", "description"))]
    top = top_per_key(rows, ["_k"], order)
    return top.select("_k", F.lit(True).alias("_t_hit"), F.col("gross").alias("_t_gross"), F.col("net").alias("_t_net"),
                      F.col("customer_facing_amount").alias("_t_cfa"), F.col("description").alias("_t_desc"))


def _check_rows() -> Column:
    """The invoice-check rows an invoice joins: (before_2021, paid_before, count)
    per non-empty combination, or one all-zero row standing for the NULL row
    a left join without a match produces."""
    variants = F.array(*[
        F.struct(F.lit(b).alias("before_2021"), F.lit(q).alias("paid_before"),
                 F.coalesce(F.col(f"_ic{b}{q}"), F.lit(0)).alias("_n_ic"))
        for b in (0, 1) for q in (0, 1)])
    present = F.filter(variants, lambda v: v["_n_ic"] > 0)
    none = F.array(F.struct(F.lit(0).alias("before_2021"), F.lit(0).alias("paid_before"),
                            F.lit(1).cast("long").alias("_n_ic")))
    return F.when(F.size(present) > 0, present).otherwise(none)


def _join_sides(left: DataFrame, key: Column, profile: DataFrame, other: DataFrame, other_key: str) -> DataFrame:
    """``left`` with its invoice's profile and one more side, a row per kind of check row."""
    out = skew_joins(left, key, [(profile.withColumnRenamed("_k", "_pk"), "_pk"), (other, other_key)])
    return per_check_row(out.drop("_pk", other_key))


def per_check_row(joined: DataFrame) -> DataFrame:
    """A row per kind of check row that the invoice of a joined row has."""
    return joined.select("*", F.inline(_check_rows()))


def _number(c: Column) -> Column:
    """A row count as a decimal, so products of counts cannot overflow."""
    return c.cast(COUNT_TYPE)


def _typed(c: Column, name: str) -> Column:
    return c.cast(SUM_TYPE).alias(name)


def forward(inp: ReconInputs, p: ReconParams, by_owner: bool = False,
            profile: DataFrame | None = None) -> DataFrame:
    """C9a, forward direction: every processor row against the invoice side.

    Processor rows are first aggregated on their own output keys, then joined
    to the invoice profile and to the invoice totals (per owner in V2 — the
    owner is an output key there, so that join's fan-out is the output).
    """
    profile = profile if profile is not None else invoice_profile(inp, p)
    inv = invoice_side(inp, by_owner).withColumnRenamed("_k", "_ik")
    return forward_rows(_join_sides(processor_side(inp), processor_key(), profile, inv, "_ik"), p, by_owner)


def processor_side(inp: ReconInputs) -> DataFrame:
    """Processor rows aggregated on the forward direction's own output keys."""
    return inp.processor.groupBy("stripe_month", "reporting_category", "invoice_id", "description",
                                 "invoices_retry", "net_suite").agg(
        F.count(F.lit(1)).alias("_n_s"),
        F.sum("customer_facing_amount").alias("_cfa"),
        F.sum("gross").alias("_gross"), F.sum("net").alias("_net"))


def processor_key() -> Column:
    """Rows without an invoice number, or with an empty one, match nothing: they
    are spread by a salt instead of meeting in one task."""
    return salted_key("invoice_id", "description", "stripe_month", blank=True)


def invoice_side(inp: ReconInputs, by_owner: bool) -> DataFrame:
    """Invoice totals per invoice key ``_k`` (and owner), as the forward direction looks them up."""
    keys = ["_k"] + (["object_owner_id"] if by_owner else [])
    return (inp.invoice_totals.withColumn("_k", to_text("invoice_id")).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_n_inv"),
                 F.sum("converted_invcharge").alias("_inv_charge"),
                 F.sum("converted_invrefund").alias("_inv_refund")))


def forward_rows(j: DataFrame, p: ReconParams, by_owner: bool) -> DataFrame:
    """Output rows of the forward direction from its joined sides."""
    n_s, n_ic = _number(F.col("_n_s")), _number(F.col("_n_ic"))
    m_bc = _number(F.greatest(F.col("_n_bc"), F.lit(1)))
    m_inv = _number(F.greatest(F.coalesce(F.col("_n_inv"), F.lit(0)), F.lit(1)))
    per_s_row = (m_inv * n_ic * m_bc).cast(COUNT_TYPE)          # joined rows per processor row
    per_inv_row = (n_s * n_ic * m_bc).cast(COUNT_TYPE)  # joined rows per invoice-total row
    rows = (n_s * per_s_row).cast(COUNT_TYPE)
    return j.select(
        F.col("stripe_month").alias("month"),
        F.lit(p.labels["forward"]).alias("category"),
        "reporting_category", "invoice_id", "description",
        flag(F.col("invoice_id").isNotNull()).alias("strp_flag"),
        flag(F.col("_n_inv").isNotNull()).alias("inv_flag"),
        flag(F.col("_bp_hit")).alias("billing_flag"),
        flag(F.col("_bt_hit")).alias("braintree_flag"),
        "before_2021", "paid_before",
        flag(F.col("description").contains(PREAUTH_TEXT)).alias("pre_auth"),
        F.col("invoices_retry").cast(IntegerType()).alias("invoices_retry"),
        F.col("net_suite").cast(IntegerType()).alias("net_suite"),
        *(["object_owner_id"] if by_owner else []),
        _typed(F.col("_cfa") * per_s_row, "customer_facing_amount"),
        _typed(F.col("_gross") * per_s_row, "gross"),
        _typed(F.col("_net") * per_s_row, "net"),
        _typed(F.col("_inv_charge") * per_inv_row, "usd_invcharge"),
        _typed(F.col("_inv_refund") * per_inv_row, "usd_invrefund"),
        _typed(F.col("_bp") * rows, "billing_amount"),
        _typed(F.col("_bt") * rows, "braintree_amount"),
    )


def backward(inp: ReconInputs, p: ReconParams, by_owner: bool = False,
             profile: DataFrame | None = None, top: DataFrame | None = None) -> DataFrame:
    """C9b, backward direction: every invoice total against the processor side."""
    profile = profile if profile is not None else invoice_profile(inp, p)
    top = top if top is not None else top_processor(inp.processor)
    g = month_side(inp, by_owner)
    return backward_rows(_join_sides(g, F.col("_k"), profile, top.withColumnRenamed("_k", "_tk"), "_tk"), p, by_owner)


def month_side(inp: ReconInputs, by_owner: bool) -> DataFrame:
    """Invoice totals aggregated on the backward direction's own output keys."""
    keys = ["_k", "month"] + (["object_owner_id"] if by_owner else [])
    return (inp.invoice_totals.withColumn("_k", to_text("invoice_id"))
            .withColumn("month", month_label(F.to_date("paid")))
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_i"),
                                F.sum("converted_invcharge").alias("_inv_charge"),
                                F.sum("converted_invrefund").alias("_inv_refund")))


def backward_rows(j: DataFrame, p: ReconParams, by_owner: bool) -> DataFrame:
    """Output rows of the backward direction from its joined sides."""
    per_i_row = (_number(F.col("_n_ic")) * _number(F.greatest(F.col("_n_bc"), F.lit(1)))).cast(COUNT_TYPE)
    rows = (_number(F.col("_n_i")) * per_i_row).cast(COUNT_TYPE)
    return j.select(
        "month", F.lit(p.labels["backward"]).alias("category"),
        F.lit("").alias("reporting_category"), F.col("_k").alias("invoice_id"),
        F.lit("").alias("description"),
        flag(F.col("_t_hit")).alias("strp_flag"),
        F.lit(1).alias("inv_flag"),
        flag(F.col("_bp_hit")).alias("billing_flag"),
        flag(F.col("_bt_hit")).alias("braintree_flag"),
        "before_2021", "paid_before",
        flag(F.col("_t_desc").contains(PREAUTH_TEXT)).alias("pre_auth"),
        F.lit(0).alias("invoices_retry"), F.lit(0).alias("net_suite"),
        *(["object_owner_id"] if by_owner else []),
        _typed(F.col("_t_cfa") * rows, "customer_facing_amount"),
        _typed(F.col("_t_gross") * rows, "gross"),
        _typed(F.col("_t_net") * rows, "net"),
        _typed(F.col("_inv_charge") * per_i_row, "usd_invcharge"),
        _typed(F.col("_inv_refund") * per_i_row, "usd_invrefund"),
        _typed(F.col("_bp") * rows, "billing_amount"),
        _typed(F.col("_bt") * rows, "braintree_amount"),
    )


def report(summary_df: DataFrame) -> DataFrame:
    """The summary rolled up to the 12 flag keys.

    ``invoice_id`` is a key of the summary, so COUNT(DISTINCT invoice_id)
    over summary rows equals the reference's count over joined rows.
    """
    return summary_df.groupBy(*REPORT_KEYS).agg(
        F.countDistinct("invoice_id").alias("invoices"),
        *[F.sum(m).cast(SUM_TYPE).alias(m) for m in MEASURES])


def report_bitmaps(summary_df: DataFrame) -> DataFrame:
    """The report's keys with their invoices as bitmaps (blocks of dictionary numbers) and their sums.

    Reports at any subset of the keys follow from this table (:func:`report_rollups`), however often
    an invoice occurs under several keys: 4 KB per key and block of 32,768 invoices instead of a row per invoice.
    """
    ids = dense_ids(summary_df, "invoice_id", "_number").withColumnRenamed("invoice_id", "_value")
    numbered = skew_join(summary_df, ids, salted_key("invoice_id", "month", "description"), "_value", "left")
    return bitmaps(numbered, REPORT_KEYS, "_number", [F.sum(m).alias(m) for m in MEASURES])


def report_rollups(maps: DataFrame, grains=ROLLUP_GRAINS) -> DataFrame:
    """C10 at several grains: ``invoices`` counts each invoice once per row of the grain."""
    out = merged_counts(maps, REPORT_KEYS, grains, "invoices", MEASURES)
    return out.select("grain", *REPORT_KEYS, "invoices", *[F.col(m).cast(SUM_TYPE).alias(m) for m in MEASURES])
