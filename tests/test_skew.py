"""Hot keys: a third of the processor rows on one description, a third with
NULL description, a third on one invoice number; one invoice with hundreds
of items and payments. Results must still equal the reference's literal SQL
(brute force in DuckDB), and the plans must reduce hot keys map-side."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest

from helpers import duck_digest, sources_from, spark_digest, write_reference_tables
from paymatch.audit import Audit
from paymatch.oracle import oracle_queries
from paymatch.params import fixture_params
from paymatch.sources import reference_branches
from paymatch.sources.fixtures import NEXT_FILE
from paymatch.sources.schemas import SCHEMAS
from test_edge_cases import ROWS as EDGE_ROWS
from test_edge_cases import SCHEMA_OF, proc

N = 600  # rows per hot group


def _ts(i: int) -> dt.datetime:
    return dt.datetime(1997, 3, 1) + dt.timedelta(minutes=i)


def skewed_rows() -> dict:
    rows = {k: list(v) for k, v in EDGE_ROWS.items()}
    cats = ["charge", "refund", "fee", "charge_failure"]
    rows["processor_current"] += (
        [proc(f"hp{i}", "Payout", cats[i % 4], "1997-09-01", f"{i % 7}.00") for i in range(N)]
        + [proc(f"hn{i}", None, cats[i % 4], "1997-09-02", f"{i % 5}.00") for i in range(N)]
        + [proc(f"hi{i}", "Invoice 100001", cats[i % 2], "1997-09-03", f"{i % 11}.00") for i in range(N)]
    )
    rows["api_invoiceitem"] += [
        (100001, _ts(i), _ts(i), D(f"{i % 13}.25"), "REFUND" if i % 3 == 0 else "LABEL", 0, 7 + i % 3, 1)
        for i in range(N)]
    rows["billing_payment"] += [
        (200000 + i, 100001, 1 + i % 4, 0, _ts(i), _ts(i), D(f"{i % 9}.50")) for i in range(N)]
    # payment ids equal to the hot invoice number: payment-check fan-out
    rows["billing_payment"] += [(100001, 100001, 2, 0, _ts(i), _ts(i), D("1.00")) for i in range(3)]
    rows["fx_rates"] += [("USD", (dt.datetime(1997, 3, 1) + dt.timedelta(days=k)).date(), D("1.0000"))
                         for k in range(1, 3)]
    return rows


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    return _build(spark, tmp_path_factory)


def _build(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("skew")
    dfs, con = write_reference_tables(spark, str(root), skewed_rows(), SCHEMA_OF, SCHEMAS)
    audit = Audit(sources_from(dfs, reference_branches(NEXT_FILE)), fixture_params())
    return audit, con, oracle_queries(fixture_params(), with_fixtures=False)


def test_empty_invoice_numbers_are_spread(skewed):
    """Rows whose description has no digits can never match; no task key holds all of them."""
    from pyspark.sql import functions as F

    from paymatch.operators import salted_key
    audit, _, _ = skewed
    keys = (audit.processor_rows.where("invoice_id = ''")
            .select("description", "stripe_month", salted_key("invoice_id", "description", "stripe_month", blank=True)
                    .alias("k")))
    assert keys.count() > 0 and keys.where(F.col("k") == "").count() == 0


NAMES = ["invoice_totals_usd", "invoice_totals_usd_by_owner", "payments_other", "processor_rows",
         "payments_method3", "invoice_payment_dates", "unmatched_payments", "unmatched_items",
         "invoice_check", "payment_check", "recon_summary", "recon_summary_by_owner", "recon_report",
         "recon_report_owner_grain", "late_update_flag", "first_item_cutoff", "unmatched_owners"]


@pytest.mark.parametrize("name", NAMES)
def test_skewed_matches_brute_force(skewed, name):
    audit, con, sql = skewed
    df = audit.output(name)
    cols, expected = duck_digest(con, sql[name])
    assert sorted(df.columns) == cols
    assert spark_digest(df) == expected


def test_processor_side_is_pre_aggregated_before_shuffle(skewed):
    """The forward direction sums processor rows on their own keys with a
    partial (map-side) aggregate before any exchange on the invoice key."""
    audit, _, _ = skewed
    p = audit.recon_forward()._jdf.queryExecution().executedPlan().toString()
    assert "partial_count(1)" in p or "partial_sum(customer_facing_amount" in p
