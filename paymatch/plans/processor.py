"""Processor-side plans: tagged balance rows (C6) and the invoice check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paymatch.functions import flag, month_label, reference_digits, text_date, to_text
from paymatch.operators import lookup_flag, present_in
from paymatch.params import CHARGE_CATEGORIES, LOOKUP_CATEGORIES, ReconParams
from paymatch.plans.payments import clean_invoice_numbers
from paymatch.sources import AuditSources, ProcessorBranch
from paymatch.sources.tables import union_all

PROCESSOR_COLUMNS = ["balance_transaction_id", "description", "reporting_category", "created_utc",
                     "available_on_utc", "invoice_id", "stripe_month", "invoices_retry", "net_suite",
                     "gross", "net", "customer_facing_amount"]


def retry_condition(rules: tuple) -> F.Column:
    """OR of (description LIKE '%needle%' [AND category IN (...)]) — brackets explicit."""
    desc, cat = F.col("description"), F.col("reporting_category")
    out = None
    for needle, categories in rules:
        term = desc.contains(needle)
        if categories is not None:
            term = term & cat.isin(*categories)
        out = term if out is None else (out | term)
    return out


def _branch_facts(src: AuditSources, b: ProcessorBranch) -> DataFrame:
    facts = src.processor[b.facts]
    if b.fact_files is not None:
        facts = facts.where(F.col("file_name").isin(*b.fact_files))
    return facts


def branch_rows(src: AuditSources, b: ProcessorBranch, strip_zeros: bool = False) -> DataFrame:
    """One UNION branch: facts tagged with the invoice number of their description.

    The reference left-joins every lookup row with the same description and
    then de-duplicates; the lookup's invoice number is a function of the
    description, so joining a de-duplicated set of descriptions gives the
    same rows without the quadratic fan-out (R9).
    """
    facts = _branch_facts(src, b)
    lookup = src.processor[b.lookup].where(F.col("reporting_category").isin(*LOOKUP_CATEGORIES))
    if b.lookup_files is not None:
        lookup = lookup.where(F.col("file_name").isin(*b.lookup_files))
    facts = facts.select("balance_transaction_id", "description", "reporting_category",
                         "created_utc", "available_on_utc", "gross", "net", "customer_facing_amount")
    tagged = lookup_flag(facts, "description", lookup, "description", "_matched",
                         spread=("balance_transaction_id", "created_utc"))
    digits = reference_digits("description")
    if strip_zeros:
        digits = F.regexp_replace(digits, "^0+(?=.)", "")
    invoice_id = F.when(F.col("_matched"), digits)
    length = F.length(invoice_id)
    return tagged.select(
        "balance_transaction_id", "description", "reporting_category", "created_utc",
        "available_on_utc", invoice_id.alias("invoice_id"),
        month_label(text_date("created_utc")).alias("stripe_month"),
        flag(retry_condition(b.retry_rules)).alias("invoices_retry"),
        flag((length <= 4) & (length > 0) & F.col("reporting_category").isin(*CHARGE_CATEGORIES))
        .alias("net_suite"),
        "gross", "net", "customer_facing_amount",
    )


def processor_rows(src: AuditSources, p: ReconParams) -> DataFrame:
    """UNION (distinct) of the branches.

    The DISTINCT is needed: a period table may hold identical rows, and the
    branches may overlap. It is one partial-aggregated shuffle.
    """
    return union_all([branch_rows(src, b, p.strip_leading_zeros) for b in src.branches]).distinct()


def invoice_check(src: AuditSources, p: ReconParams, processor: DataFrame) -> DataFrame:
    """Paid and created dates of invoices among the clean processor numbers."""
    inv = src.invoice_for_check
    hit = present_in(inv, to_text(inv["id"]), clean_invoice_numbers(processor), "invoice_id")
    return hit.select("id", F.col("paid").alias("invoice_paid"),
                      F.col("object_created").alias("invoice_created")).distinct()
