"""Parameter switches of ReconParams (quirk and trap options)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paymatch.audit import Audit
from paymatch.params import fixture_params
from paymatch.sources.fixtures import fixture_sources

from conftest import SF_SMALL


def test_zero_rate_error_mode_raises(spark):
    """T5: with on_zero_rate='error' a rate rounding to 0.00 fails the job
    (the fixture has one such item at sf0.001)."""
    audit = Audit(fixture_sources(spark, SF_SMALL), fixture_params().with_(on_zero_rate="error"),
                  reuse="none")
    with pytest.raises(Exception):
        audit.invoice_totals.collect()


def test_payment_check_key_switch(spark):
    """K5: matching payments on invoice_id instead of the payment id finds the
    payments of the clean invoice numbers themselves."""
    src = fixture_sources(spark, SF_SMALL)
    by_id = Audit(src, fixture_params(), reuse="none").payment_check
    by_invoice = Audit(src, fixture_params().with_(payment_check_on="invoice_id"), reuse="none").payment_check
    clean = (Audit(src, fixture_params(), reuse="none").processor_rows
             .where("net_suite = 0 AND invoices_retry = 0 AND reporting_category IN ('charge','refund')")
             .select("invoice_id").distinct())
    got = by_invoice.select(F.col("invoice_id").cast("string").alias("k")).distinct()
    assert got.join(clean, got.k == clean.invoice_id, "left_anti").count() == 0
    assert by_invoice.count() > 0
    # by id: the payments whose own id is a clean number
    ids = (src.payment_for_check.select(F.col("id").cast("string").alias("k"), "invoice_id", "object_created", "amount")
           .join(clean, F.col("k") == clean.invoice_id, "left_semi").drop("k").distinct())
    assert by_id.exceptAll(ids).count() == 0 and ids.exceptAll(by_id).count() == 0


def test_late_update_focus_on_one_invoice(spark):
    """The single-invoice focus reproduces that invoice's flags of the full run."""
    src = fixture_sources(spark, SF_SMALL)
    full = Audit(src, fixture_params(), reuse="none").late_update_flag
    target = full.where("later_than_updated = 1").select("invoice_id").first()[0]
    focused = Audit(src, fixture_params().with_(late_update_invoice=int(target)),
                    reuse="none").late_update_flag
    a = focused.where(F.col("invoice_id") == target).select("later_than_updated").collect()
    b = full.where(F.col("invoice_id") == target).select("later_than_updated").collect()
    assert sorted(a) == sorted(b)
    # every other invoice falls back to flag 0 (no item update, no payment in focus)
    assert focused.where((F.col("invoice_id") != target) & (F.col("later_than_updated") != 0)).count() == 0
