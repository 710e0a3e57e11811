"""Run parameters of the reconciliation.

One frozen object replaces the reference's one-row parameter table. Every
builder reads literals from it, so Catalyst folds them into the plan and
pushes the time windows down to the Parquet scans.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import Decimal

# --- Fixed values: these must equal the reference's for right results. ---
# Reporting window and source window of the audit run.
REFERENCE_QUERY_START = "2022-01-01 00:00:00"
REFERENCE_QUERY_END = "2023-02-01 00:00:00"
REFERENCE_SOURCE_START = "2021-01-01 00:00:00"
REFERENCE_SOURCE_END = "2023-07-01 00:00:00"
# Payment method booked as the second payment processor.
SPECIAL_PAYMENT_METHOD = 3
# Processor categories that may carry an invoice number.
LOOKUP_CATEGORIES = ("charge", "refund", "charge_failure")
# Categories the match flags and checks look at.
CHARGE_CATEGORIES = ("charge", "refund")
# The one of them that is money received.
RECEIPT_CATEGORY = "charge"
# Bounds of the fuzzy match: days before and months after.
FUZZY_MIN_DAYS = -16
FUZZY_MAX_MONTHS = 6
# Invoice item purpose counted as a refund.
REFUND_PURPOSE = "REFUND"
# Description text marking a pre-authorisation hold.
PREAUTH_TEXT = "Preauthorization hold for first label purchase"
# Category labels of the two reconciliation directions.
FORWARD_LABEL = "Stripe-Prod"
BACKWARD_LABEL = "Prod-Stripe"
# Label-fact filters: provider, excluded user, excluded transaction statuses.
REFERENCE_PROVIDER_ID = 17
REFERENCE_EXCLUDED_USERS = (1206048,)
EXCLUDED_TRANSACTION_STATUSES = ("ERROR", "WAITING", "QUEUED")
# Cut-off of the "first item before" drill-down.
REFERENCE_FIRST_ITEM_CUTOFF = "2019-01-01"
# --- end of fixed values ---


@dataclass(frozen=True)
class ReconParams:
    """Half-open windows ``[start, end)`` as ``'YYYY-MM-DD HH:MM:SS'`` text."""

    query_start: str = REFERENCE_QUERY_START
    query_end: str = REFERENCE_QUERY_END
    source_start: str = REFERENCE_SOURCE_START
    source_end: str = REFERENCE_SOURCE_END
    special_method: int = SPECIAL_PAYMENT_METHOD
    provider_id: int | None = REFERENCE_PROVIDER_ID
    excluded_users: tuple[int, ...] = REFERENCE_EXCLUDED_USERS
    first_item_cutoff: str = REFERENCE_FIRST_ITEM_CUTOFF
    # Lower bound on payment creation for the late-update drill-down; the
    # reference read it from a session setting.
    billing_floor: str | None = None
    # Optional single-invoice focus of the late-update drill-down (the
    # reference hard-coded one id); None means every invoice.
    late_update_invoice: int | None = None
    # Division by a rate that rounds to 0.00: "null" (default) or "error".
    on_zero_rate: str = "null"
    # Payment-check key: "id" reproduces the reference (payment id compared
    # with invoice numbers); "invoice_id" is the evident intent; None leaves
    # the check out (its only visible effect is fan-out, K12).
    payment_check_on: str | None = "id"
    # Fuzzy match of rows without an invoice: date bounds around the paid date, and the
    # difference of amounts that is let pass.
    fuzzy_min_days: int = FUZZY_MIN_DAYS
    fuzzy_max_months: int = FUZZY_MAX_MONTHS
    fuzzy_tolerance: Decimal = Decimal("0.00")
    # Compare the digits of a description without their leading zeros (T2);
    # the reference compares them as they are.
    strip_leading_zeros: bool = False
    labels: dict = field(default_factory=lambda: {"forward": FORWARD_LABEL,
                                                   "backward": BACKWARD_LABEL})

    def with_(self, **kw) -> "ReconParams":
        return replace(self, **kw)


def fixture_params() -> ReconParams:
    """Parameters matching the test tables' date range (see FIXTURES.md)."""
    return ReconParams(
        query_start="1997-01-01 00:00:00",
        query_end="1998-02-01 00:00:00",
        source_start="1996-01-01 00:00:00",
        source_end="1998-07-01 00:00:00",
        provider_id=7,
        excluded_users=(1,),
        first_item_cutoff="1996-01-01",
        billing_floor="1997-01-01",
        fuzzy_tolerance=Decimal("50.00"),
    )
