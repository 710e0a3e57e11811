"""``Audit``: every reference output as a lazily built DataFrame.

Building an output starts no Spark job (except in the ``checkpoint`` mode, which
writes intermediates as they are built). Intermediates are built once per
``Audit`` object, and those with several readers (C2, C3's item totals, both
grains of C3, C4/C5's payment groups, C6, C7, C8, the invoice profile and the
top processor rows, both directions, item and payment dates, the unmatched
invoice set) are kept once: ``reuse="cache"`` persists them (memory, spilling
to disk; lost blocks are recomputed from lineage), ``reuse="checkpoint"`` writes
them to the cluster's ``spark.checkpoint.dir`` and cuts the lineage,
``reuse="none"`` recomputes per consumer. The union of the two directions is
never kept beside them. ``close()`` (or leaving a ``with`` block) releases what
was persisted.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from paymatch.operators import rate_conflicts
from paymatch.params import ReconParams
from paymatch.plans import accounts, drilldowns, invoices, matching, payments, processor, reconcile
from paymatch.session import materialize, persist_coalesced
from paymatch.sources import AuditSources


class Audit:
    def __init__(self, sources: AuditSources, params: ReconParams | None = None,
                 reuse: str = "cache", partials: dict[str, DataFrame] | None = None):
        if reuse not in ("cache", "checkpoint", "none"):
            raise ValueError(f"reuse must be cache, checkpoint or none, not {reuse!r}")
        self.src = sources
        self.p = params or ReconParams()
        self.reuse = reuse
        # daily partials by table (``paymatch.incremental``) instead of whole items and payments
        self.partials = partials or {}
        self._built: dict[tuple, DataFrame] = {}
        self._persisted: list[DataFrame] = []
        sources.check_zone()

    def __enter__(self) -> "Audit":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Release the kept intermediates; outputs built from them recompute what they need."""
        while self._persisted:
            self._persisted.pop().unpersist()

    def _shared(self, df: DataFrame) -> DataFrame:
        if self.reuse == "cache":
            self._persisted.append(persist_coalesced(df, StorageLevel.MEMORY_AND_DISK))
            return df
        if self.reuse == "checkpoint":
            return materialize(df)
        return df

    # --- C2-C8 ---------------------------------------------------------
    @cached_property
    def latest_override(self) -> DataFrame:
        return self._shared(accounts.latest_override(self.src, self.p))

    @cached_property
    def item_totals(self) -> DataFrame:
        """Unrounded item sums per (invoice, owner): one pass for both grains of C3."""
        kept = self.partials.get("api_invoiceitem")
        return self._shared(invoices.item_totals(self.src, self.p) if kept is None
                            else invoices.merged_item_totals(kept, self.src, self.p))

    @cached_property
    def invoice_totals(self) -> DataFrame:
        return self._shared(invoices.invoice_totals(self.src, self.p, self.item_totals, by_owner=False))

    @cached_property
    def invoice_totals_by_owner(self) -> DataFrame:
        return self._shared(invoices.invoice_totals(self.src, self.p, self.item_totals, by_owner=True))

    @cached_property
    def payment_groups(self) -> DataFrame:
        """Payment sums of both kinds of method: one pass for C4 and C5."""
        sums = payments.payment_sums(self.src, self.p, self.partials.get("billing_payment"))
        return self._shared(payments.payment_groups(sums, self.p))

    @cached_property
    def payment_groups_other(self) -> DataFrame:
        return payments.of_method(self.payment_groups, special=False)

    @cached_property
    def payment_groups_special(self) -> DataFrame:
        return payments.of_method(self.payment_groups, special=True)

    @cached_property
    def payments_other(self) -> DataFrame:
        return payments.payment_summary(self.payment_groups_other)

    @cached_property
    def payments_special(self) -> DataFrame:
        return payments.payment_summary(self.payment_groups_special)

    @cached_property
    def payments_by_method(self) -> DataFrame:
        """C4 with the payment method as a key and an output."""
        sums = payments.payment_sums(self.src, self.p, self.partials.get("billing_payment"))
        groups = self._shared(payments.payment_groups(sums, self.p, by_method=True))
        return payments.payment_summary(payments.of_method(groups, special=False))

    @cached_property
    def rate_conflicts(self) -> DataFrame:
        """Rates that are not unique per currency and day (empty for a sound table)."""
        return rate_conflicts(self.src.fx_rates)

    @cached_property
    def processor_rows(self) -> DataFrame:
        return self._shared(processor.processor_rows(self.src, self.p))

    @cached_property
    def invoice_check(self) -> DataFrame:
        return self._shared(processor.invoice_check(self.src, self.p, self.processor_rows))

    @cached_property
    def payment_check(self) -> DataFrame:
        return self._shared(payments.payment_check(self.src, self.p, self.processor_rows))

    # --- C9, C10 -------------------------------------------------------
    def inputs(self, by_owner: bool = False) -> reconcile.ReconInputs:
        return reconcile.ReconInputs(
            invoice_totals=self.invoice_totals_by_owner if by_owner else self.invoice_totals,
            payments_other=payments.latest_payment(self.payment_groups_other),
            payments_special=payments.latest_payment(self.payment_groups_special),
            processor=self.processor_rows,
            invoice_check=self.invoice_check,
            payment_check=self.payment_check,
        )

    @cached_property
    def invoice_profile(self) -> DataFrame:
        """Per-invoice lookup profile shared by both directions and both grains."""
        return self._shared(reconcile.invoice_profile(self.inputs(), self.p))

    @cached_property
    def top_processor(self) -> DataFrame:
        """Top processor row per invoice number, for both grains of the backward direction."""
        return self._shared(reconcile.top_processor(self.processor_rows))

    def _kept(self, key: tuple, build) -> DataFrame:
        if key not in self._built:
            self._built[key] = self._shared(build())
        return self._built[key]

    def recon_forward(self, by_owner: bool = False) -> DataFrame:
        return self._kept(("forward", by_owner), lambda: reconcile.forward(
            self.inputs(by_owner), self.p, by_owner, self.invoice_profile))

    def recon_backward(self, by_owner: bool = False) -> DataFrame:
        return self._kept(("backward", by_owner), lambda: reconcile.backward(
            self.inputs(by_owner), self.p, by_owner, self.invoice_profile, self.top_processor))

    def recon_summary(self, by_owner: bool = False) -> DataFrame:
        """The two directions (disjoint by ``category``: UNION ALL, R7)."""
        return self.recon_forward(by_owner).unionByName(self.recon_backward(by_owner))

    def recon_report(self, by_owner: bool = False) -> DataFrame:
        """C10. ``by_owner=True`` is V2's report: the same 12 keys, but the
        invoice totals it joins are at owner grain, so amounts repeat per owner."""
        return reconcile.report(self.recon_summary(by_owner))

    @cached_property
    def recon_report_rollups(self) -> DataFrame:
        """C10 at coarser grains, from bitmaps of its invoices."""
        return reconcile.report_rollups(self._shared(reconcile.report_bitmaps(self.recon_summary())))

    # --- matches beyond equal invoice numbers --------------------------
    @cached_property
    def fuzzy_candidates(self) -> DataFrame:
        """C1's bounds: invoices near in amount and date to rows that match none."""
        return matching.fuzzy_candidates(self.p, self.processor_rows, self.invoice_totals)

    @cached_property
    def reference_candidates(self) -> DataFrame:
        """Known invoices among all numbers of a description."""
        return matching.reference_candidates(self.processor_rows, self.src.invoice)

    @cached_property
    def recon_allocated(self) -> DataFrame:
        """C9 with each amount counted once: receipts allocated to charges."""
        return matching.recon_allocated(self._shared(matching.charge_intervals(self.invoice_totals_by_owner)),
                                        self._shared(matching.receipt_intervals(self.processor_rows)))

    # --- C11, C12 ------------------------------------------------------
    @cached_property
    def default_address(self) -> DataFrame:
        return accounts.default_address(self.src, self.p)

    @cached_property
    def label_detail(self) -> DataFrame:
        return accounts.label_detail(self.src, self.p, self.latest_override)

    # --- D1-D10 --------------------------------------------------------
    @cached_property
    def invoice_universe(self) -> DataFrame:
        return drilldowns.invoice_universe(self.processor_rows, self.invoice_totals,
                                           self.payment_groups_other)

    @cached_property
    def item_dates(self) -> DataFrame:
        """Per-invoice item dates shared by D2-D4 (one scan of the item table)."""
        return self._shared(invoices.item_dates(self.src))

    @cached_property
    def payment_dates(self) -> DataFrame:
        """Payment dates shared by D2 and D4 (one scan of the payment table)."""
        return self._shared(invoices.payment_dates(self.src, self.p))

    @cached_property
    def invoice_payment_dates(self) -> DataFrame:
        return invoices.invoice_payment_dates(self.p, self.invoice_universe, self.item_dates, self.payment_dates)

    @cached_property
    def first_item_cutoff(self) -> DataFrame:
        return invoices.first_item_cutoff(self.p, self.processor_rows, self.item_dates)

    @cached_property
    def late_update_flag(self) -> DataFrame:
        return invoices.late_update_flag(self.p, self.processor_rows, self.item_dates, self.payment_dates)

    @cached_property
    def unmatched(self) -> DataFrame:
        return self._shared(drilldowns.unmatched_invoices(
            self.invoice_totals_by_owner, self.processor_rows, self.payment_groups_other))

    @cached_property
    def unmatched_flags(self) -> DataFrame:
        return drilldowns.unmatched_flags(self.p, self.unmatched, self.invoice_check)

    @cached_property
    def unmatched_payments(self) -> DataFrame:
        return drilldowns.unmatched_payments(self.src, self.unmatched)

    @cached_property
    def unmatched_items(self) -> DataFrame:
        return drilldowns.unmatched_items(self.src, self.unmatched)

    @cached_property
    def unmatched_transactions(self) -> DataFrame:
        return drilldowns.unmatched_transactions(self.src, self.unmatched_items)

    @cached_property
    def unmatched_totals(self) -> DataFrame:
        return drilldowns.unmatched_totals(self.invoice_totals_by_owner, self.unmatched)

    @cached_property
    def unmatched_invoice_paid(self) -> DataFrame:
        return drilldowns.unmatched_invoice_paid(self.unmatched_totals)

    @cached_property
    def unmatched_owners(self) -> DataFrame:
        return drilldowns.unmatched_owners(self.src, self.unmatched_items, self.latest_override)

    def output(self, name: str) -> DataFrame:
        """One output by its registered name (only that plan is built)."""
        return OUTPUTS[name](self)

    def outputs(self) -> dict[str, DataFrame]:
        """Every output by its registered name."""
        return {name: build(self) for name, build in OUTPUTS.items()}


OUTPUTS = {
    "latest_override": lambda a: a.latest_override,
    "invoice_totals_usd": lambda a: a.invoice_totals,
    "invoice_totals_usd_by_owner": lambda a: a.invoice_totals_by_owner,
    "payments_other": lambda a: a.payments_other,
    "payments_method3": lambda a: a.payments_special,
    "payments_by_method": lambda a: a.payments_by_method,
    "rate_conflicts": lambda a: a.rate_conflicts,
    "processor_rows": lambda a: a.processor_rows,
    "invoice_check": lambda a: a.invoice_check,
    "payment_check": lambda a: a.payment_check,
    "recon_forward": lambda a: a.recon_forward(),
    "recon_backward": lambda a: a.recon_backward(),
    "recon_summary": lambda a: a.recon_summary(),
    "recon_summary_by_owner": lambda a: a.recon_summary(by_owner=True),
    "recon_report": lambda a: a.recon_report(),
    "recon_report_owner_grain": lambda a: a.recon_report(by_owner=True),
    "recon_report_rollups": lambda a: a.recon_report_rollups,
    "fuzzy_candidates": lambda a: a.fuzzy_candidates,
    "reference_candidates": lambda a: a.reference_candidates,
    "recon_allocated": lambda a: a.recon_allocated,
    "default_address": lambda a: a.default_address,
    "label_detail": lambda a: a.label_detail,
    "invoice_universe": lambda a: a.invoice_universe,
    "invoice_payment_dates": lambda a: a.invoice_payment_dates,
    "first_item_cutoff": lambda a: a.first_item_cutoff,
    "late_update_flag": lambda a: a.late_update_flag,
    "unmatched_flags": lambda a: a.unmatched_flags,
    "unmatched_payments": lambda a: a.unmatched_payments,
    "unmatched_items": lambda a: a.unmatched_items,
    "unmatched_transactions": lambda a: a.unmatched_transactions,
    "unmatched_totals": lambda a: a.unmatched_totals,
    "unmatched_invoice_paid": lambda a: a.unmatched_invoice_paid,
    "unmatched_owners": lambda a: a.unmatched_owners,
}
