"""Explicit schemas of the reference's source tables (FIXTURES.md §1).

The reference ships no DDL; these types come from how each column is used.
They are used when reading raw exports (CSV) and to validate Parquet inputs.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(15, 2)
TS = TimestampNTZType()


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, StructType] = {
    "user_useroverride": _s(("id", LongType()), ("object_owner_id", LongType()),
                            ("company_name_override", StringType()),
                            ("user_type_id", LongType()), ("partner_platform", StringType())),
    "user_usertype": _s(("id", LongType()), ("name", StringType())),
    "api_invoiceitem": _s(("invoice_id", LongType()), ("object_created", TS),
                          ("object_updated", TS), ("amount", MONEY),
                          ("object_purpose", StringType()), ("currency_id", LongType()),
                          ("object_owner_id", LongType()), ("transaction_id", LongType())),
    "api_invoice": _s(("id", LongType()), ("paid", TS), ("object_created", TS)),
    "api_currency": _s(("id", LongType()), ("iso", StringType())),
    "fx_rates": _s(("currency", StringType()), ("date", DateType()),
                   ("rate", DecimalType(15, 4))),
    "billing_payment": _s(("id", LongType()), ("invoice_id", LongType()),
                          ("payment_method_id", IntegerType()), ("currency_id", LongType()),
                          ("object_created", TS), ("object_updated", TS), ("amount", MONEY)),
    # One processor export period; created/available are kept as text.
    "processor_history": _s(("balance_transaction_id", StringType()),
                            ("description", StringType()),
                            ("reporting_category", StringType()),
                            ("created_utc", StringType()), ("available_on_utc", StringType()),
                            ("gross", MONEY), ("net", MONEY),
                            ("customer_facing_amount", MONEY), ("file_name", StringType())),
    "api_apiaddress": _s(("id", LongType()), ("object_owner_id", LongType()),
                         ("object_created", TS), ("is_default_sender", BooleanType())),
    "api_transaction": _s(("id", LongType()), ("object_owner_id", LongType()),
                          ("track_status_id", LongType()), ("api_rate_id", LongType()),
                          ("scan_form_id", LongType()), ("cost_usd", MONEY), ("amount", MONEY),
                          ("was_test", BooleanType()), ("object_state", StringType()),
                          ("object_status", StringType()), ("tracking_number", StringType()),
                          ("entry_point", StringType()), ("object_created", TS),
                          ("object_updated", TS)),
    "api_rate": _s(("id", LongType()), ("servicelevel_id", LongType()),
                   ("provider_id", LongType()), ("shipment_id", LongType()),
                   ("account_id", LongType()), ("discount_group_id", LongType()),
                   ("amount", MONEY), ("insurance_amount", MONEY),
                   ("amount_insurance_fee", MONEY), ("insurance_cost", MONEY),
                   ("zone", StringType()), ("servicelevel_name", StringType()),
                   ("object_created", TS)),
    "track_status": _s(("id", LongType()), ("name", StringType())),
    "auth_user": _s(("id", LongType()), ("apiuser_id", LongType()),
                    ("platform_id", LongType()), ("username", StringType())),
    "api_refund": _s(("transaction_id", LongType()), ("object_status", StringType()),
                     ("carrier_status", StringType()), ("approve_time", TS),
                     ("object_created", TS)),
}

# CSV exports of the processor carry no file name column; it is taken from
# the file the row came from.
PROCESSOR_EXPORT_CSV = StructType(
    [f for f in SCHEMAS["processor_history"].fields if f.name != "file_name"]
)
