"""Account-side plans: latest user override (C2), default sender address
(C11) and the label-purchase fact table (C12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paymatch.functions import day_text, month_label_upper
from paymatch.operators import skew_join, time_window, top_per_key
from paymatch.params import EXCLUDED_TRANSACTION_STATUSES, ReconParams
from paymatch.sources import AuditSources

# --- Fixed values: code → label mappings of the label fact (reference text). ---
DISCOUNT_GROUP_NAMES = ((1, "EBAY_CA"), (2, "EBAY_US"), (3, "ES_SHIPPO_REFERRED"),
                        (4, "ES_EXPRESS_SAVE_REFERRED"))
DISCOUNT_GROUP_DEFAULT = "NOT SET"
SCAN_BASED_PROVIDERS = (5, 50, 56, 95, 96, 98, 38, 41, 28, 40)
SCAN_BASED_LABELS = ("Scan-Based Outbound", "Not Scan-Based Outbound")
# --- end of fixed values ---

OVERRIDE_COLUMNS = ["id", "object_owner_id", "company_name_override", "user_type_id",
                    "user_type_name", "partner_platform"]


def latest_override(src: AuditSources, p: ReconParams) -> DataFrame:
    """Newest override row(s) per owner (RANK, ties kept), with type name.

    Ranked before the type lookup (the rank only reads ``id``), so the join
    sees one row per owner; the partial WindowGroupLimit keeps a busy owner
    from flooding one task.
    """
    top = top_per_key(src.user_override, ["object_owner_id"], [F.col("id").desc_nulls_first()],
                      ties="all")
    types = src.user_type.select(F.col("id").alias("_t_id"), F.col("name").alias("user_type_name"))
    return top.join(types, top["user_type_id"] == types["_t_id"], "left").select(*OVERRIDE_COLUMNS)


def default_address(src: AuditSources, p: ReconParams) -> DataFrame:
    """C11: each owner's earliest default-sender address row(s), ties kept.

    ``is_default_sender IS TRUE`` (NULL is not true). The rank comes first
    (with a partial group limit before its shuffle), so only each owner's
    earliest rows are collapsed to distinct ones.
    """
    addr = src.address
    default = addr.where(F.col("is_default_sender").eqNullSafe(True)
                         & F.col("object_owner_id").isNotNull()
                         & F.col("object_created").isNotNull())
    first = top_per_key(default, ["object_owner_id"], [F.col("object_created").asc()], ties="all").distinct()
    return first.select(*addr.columns, F.col("object_owner_id").alias("ooid"),
                        F.col("object_created").alias("unique_create_date"))


def _discount_group_name(col: str) -> F.Column:
    out = None
    for code, name in DISCOUNT_GROUP_NAMES:
        out = F.when(F.col(col) == code, name) if out is None else out.when(F.col(col) == code, name)
    return out.otherwise(DISCOUNT_GROUP_DEFAULT)


def label_detail(src: AuditSources, p: ReconParams, overrides: DataFrame) -> DataFrame:
    """Valid, non-test, non-error label purchases with rate, user,
    refund, tracking status and override attached; DISTINCT.

    Every join key is an output column, so the result is distinct once each
    side is distinct on its output columns: the narrow sides are
    de-duplicated before they are joined, and the transactions, cut down by
    the selective inner joins first, on the partitioning by their id that the
    join to refunds needs anyway. A busy owner's transactions are split over
    several tasks (``skew_join``).
    """
    ss, se = p.source_start, p.source_end
    txn = time_window(src.transaction, "object_created", ss, se).where(
        (F.col("object_state") == "VALID") & (F.col("was_test") == F.lit(False))
        & ~F.col("object_status").isin(*EXCLUDED_TRANSACTION_STATUSES))
    txn = txn.select(
        F.col("id").alias("api_transaction_id"), F.col("cost_usd").alias("est_postage_cost"),
        F.col("amount").alias("actual_postage_cost"), "was_test",
        F.col("object_state").alias("api_transaction_object_state"),
        F.col("object_status").alias("api_transaction_object_status"),
        "tracking_number", "entry_point", "scan_form_id", "track_status_id", "api_rate_id",
        F.col("object_created").alias("api_transaction_object_created"),
        F.col("object_updated").alias("api_transaction_object_updated"),
        F.col("object_owner_id").alias("api_transaction_object_owner"))
    scan_based = F.when(F.col("provider_id").isin(*SCAN_BASED_PROVIDERS), SCAN_BASED_LABELS[0]) \
        .otherwise(SCAN_BASED_LABELS[1])
    rate = time_window(src.rate, "object_created", ss, se).select(
        F.col("id").alias("_r_id"), F.col("amount").alias("user_rate"), "insurance_amount",
        F.col("amount_insurance_fee").alias("insurance_fee"), "insurance_cost", "zone",
        "servicelevel_id", "servicelevel_name", "provider_id", "shipment_id", "account_id",
        _discount_group_name("discount_group_id").alias("_group"))
    if p.provider_id is not None:
        rate = rate.where(F.col("provider_id") == p.provider_id)
    rate = rate.distinct()
    j = txn.join(rate, txn["api_rate_id"] == rate["_r_id"],
                 "inner" if p.provider_id is not None else "left")

    users = src.auth_user.select(F.col("id").alias("au_id"), F.col("apiuser_id").alias("api_user_id"),
                                 "username", "platform_id").distinct()
    ovr = overrides.select(F.col("object_owner_id").alias("_o_owner"), "company_name_override").distinct()
    if p.excluded_users:
        users = users.where(~F.col("au_id").isin(*p.excluded_users))
        owners = users.join(ovr, users["au_id"] == ovr["_o_owner"], "left").drop("_o_owner")
        j = skew_join(j, owners, "api_transaction_object_owner", "au_id", "inner")
    else:
        j = skew_join(j, users, "api_transaction_object_owner", "au_id", "left")
        j = skew_join(j, ovr, "api_transaction_object_owner", "_o_owner", "left").drop("_o_owner")

    ts = src.track_status.select(F.col("id").alias("_ts_id"), F.col("name").alias("track_status_name")).distinct()
    j = j.join(ts, j["track_status_id"] == ts["_ts_id"], "left").drop("_ts_id", "_r_id")
    ref = time_window(src.refund, "object_created", ss, se).select(
        F.col("transaction_id").alias("_ref_txn"),
        F.col("object_status").alias("api_refund_object_status"),
        F.col("carrier_status").alias("api_refund_carrier_status"),
        F.col("approve_time").alias("api_refund_approve_time")).distinct()
    j = j.repartition("api_transaction_id").distinct()
    j = j.join(ref, j["api_transaction_id"] == ref["_ref_txn"], "left")
    return j.select(
        *txn.columns, "user_rate", "insurance_amount", "insurance_fee", "insurance_cost", "zone",
        "servicelevel_id", "servicelevel_name", "provider_id", "shipment_id", "account_id",
        "track_status_name", "au_id", "api_user_id", "username", "platform_id",
        "company_name_override", "api_refund_object_status", "api_refund_carrier_status",
        "api_refund_approve_time",
        F.coalesce("_group", F.lit(DISCOUNT_GROUP_DEFAULT)).alias("discount_group_name"),
        scan_based.alias("scanbased_outbound_indicator"),
        month_label_upper("api_transaction_object_created").alias("lbl_generation_mnth"),
        month_label_upper("api_refund_approve_time").alias("refund_date_mnth"),
        day_text("api_transaction_object_created").alias("lbl_generation_date"),
        day_text("api_refund_approve_time").alias("refund_approval_time"),
        day_text("api_transaction_object_updated").alias("trx_updated"),
    )
