"""Reference-shaped views over the given test tables (FIXTURES.md §3).

Every view is a projection (plus one equi-join to a dimension) of a given
table, so its size grows with the scale factor and Catalyst prunes unused
columns down to the Parquet scan. The DuckDB oracle builds the same views
as CTEs (``paymatch.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, LongType

from paymatch.functions import money, ts_lit
from paymatch.sources.tables import AuditSources, reference_branches

# Fixture layout (FIXTURES.md): processor periods by order date, the next
# period's file, and the rate of each region's currency.
PERIODS = {
    "previous": ("1996-10-01 00:00:00", "1997-01-01 00:00:00"),
    "current": ("1997-01-01 00:00:00", "1998-01-01 00:00:00"),
    "next": ("1998-01-01 00:00:00", "1998-07-01 00:00:00"),
}
NEXT_FILE = "activity_1998-01.csv"
# Rate of region keys 0..4, before the +0.004; quotients by 3 and 1.37 never end.
REGION_RATES = ("1", "2", "3", "1.37", "8")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invoice(orders: DataFrame) -> DataFrame:
    return orders.select(
        (F.col("o_orderkey") + 100000).alias("id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.col("o_orderdate")).alias("paid"),
        F.col("o_orderdate").alias("object_created"),
    )


def invoice_item(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        (F.nullif(F.col("l_orderkey"), F.lit(0)) + 100000).alias("invoice_id"),
        F.col("l_shipdate").alias("object_created"),
        F.col("l_shipdate").alias("object_updated"),
        F.when(F.col("l_quantity") == 1, F.lit(None)).otherwise(money("l_extendedprice")).alias("amount"),
        F.when(F.col("l_returnflag") == "R", "REFUND").when(F.col("l_returnflag") == "N", "LABEL")
        .alias("object_purpose"),
        (F.col("l_suppkey") % 6).alias("currency_id"),
        F.col("l_suppkey").alias("object_owner_id"),
        F.col("l_orderkey").alias("transaction_id"),
    )


def currency(region: DataFrame) -> DataFrame:
    return region.select(F.col("r_regionkey").cast(LongType()).alias("id"),
                         F.substring("r_name", 1, 3).alias("iso"))


def fx_rates(lineitem: DataFrame, region: DataFrame) -> DataFrame:
    """Daily rate of every (currency, day) that line items trade in.

    Built by an equi-join of the traded (currency id, day) pairs to the
    region dimension — no cross product. Region 4 quotes 0.004 on the first
    of each month, which rounds to 0.00 (trap T5); region 1 quotes two rates on
    the 20th of the months before 1997.
    """
    traded = lineitem.select((F.col("l_suppkey") % 6).alias("rk"),
                             F.to_date("l_shipdate").alias("date")).distinct()
    base = F.element_at(F.array(*[F.lit(r).cast(DecimalType(15, 4)) for r in REGION_RATES]), F.col("r_regionkey") + 1)
    rate = (F.when((F.col("r_regionkey") == 4) & (F.dayofmonth("date") == 1), F.lit(0))
            .otherwise(base).cast(DecimalType(15, 4)) + F.lit(0.004).cast(DecimalType(15, 4)))
    # region 1 quotes a second rate, one higher, on the 20th of each month before the reporting window
    second = F.when((F.col("r_regionkey") == 1) & (F.dayofmonth("date") == 20) & (F.year("date") < 1997), 1)
    return (traded.join(region, traded.rk == region.r_regionkey)
            .select(F.substring("r_name", 1, 3).alias("currency"), "date",
                    F.explode(F.array_compact(F.array(F.lit(0), second))).alias("_more"), rate.alias("_rate"))
            .select("currency", "date", (F.col("_rate") + F.col("_more")).cast(DecimalType(15, 4)).alias("rate")))


def payment(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        (F.lit(99000) + F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("id"),
        (F.col("l_orderkey") + 100000).alias("invoice_id"),
        F.nullif(F.col("l_linenumber"), F.lit(7)).cast(IntegerType()).alias("payment_method_id"),
        (F.col("l_suppkey") % 6).alias("currency_id"),
        F.col("l_shipdate").alias("object_created"),
        F.col("l_shipdate").alias("object_updated"),
        money("l_extendedprice").alias("amount"),
    )


def processor_all(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    n = (k + 100000).cast("string")
    description = (
        F.when(k % 97 == 0, F.lit(None))
        .when(k % 13 == 0, F.concat(F.lit("Invoice "), (k % 900).cast("string")))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("Payout"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("Invoice "), n, F.lit(" - retry 1")))
        .when((F.col("o_orderpriority") == "1-URGENT") & (k % 2 == 0), F.concat(F.lit("reattempt of "), n))
        .when(k % 50 == 1, F.concat(F.lit("Preauthorization hold for first label purchase "), n))
        .otherwise(F.concat(F.lit("Invoice "), n))
    )
    category = (F.when(F.col("o_orderstatus") == "F", "charge")
                .when(F.col("o_orderstatus") == "O", "refund")
                .when(F.col("o_orderstatus") == "P",
                      F.when(k % 2 == 0, "charge_failure").otherwise("fee")))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    gross = money("o_totalprice")
    return orders.select(
        F.concat(F.lit("txn_"), k.cast("string")).alias("balance_transaction_id"),
        description.alias("description"),
        category.alias("reporting_category"),
        F.concat(day, F.lit(" 08:30:00")).alias("created_utc"),
        F.concat(day, F.lit(" 20:00:00")).alias("available_on_utc"),
        gross.alias("gross"),
        money(gross - F.lit(0.30).cast(DecimalType(15, 2))).alias("net"),
        gross.alias("customer_facing_amount"),
        F.concat(F.lit("activity_"), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".csv")).alias("file_name"),
        F.col("o_orderdate").alias("order_date"),
    )


def processor_period(orders: DataFrame, period: str) -> DataFrame:
    start, end = PERIODS[period]
    return (processor_all(orders)
            .where((F.col("order_date") >= ts_lit(start)) & (F.col("order_date") < ts_lit(end)))
            .drop("order_date"))


def user_override(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("object_owner_id"),
                         F.col("event_type").alias("company_name_override"),
                         (F.col("event_id") % 6).alias("user_type_id"),
                         F.col("props").alias("partner_platform"))


def user_type(region: DataFrame) -> DataFrame:
    return region.select(F.col("r_regionkey").cast(LongType()).alias("id"), F.col("r_name").alias("name"))


def address(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("object_owner_id"),
        F.col("ts").alias("object_created"),
        F.when(F.col("event_type") == "signup", F.lit(True))
        .when(F.col("event_type") == "error", F.lit(None).cast("boolean"))
        .otherwise(F.lit(False)).alias("is_default_sender"),
    )


def rate(part: DataFrame) -> DataFrame:
    zero = F.lit(0).cast(DecimalType(15, 2))
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_size").cast(LongType()).alias("servicelevel_id"),
        (F.col("p_size") % 10).cast(LongType()).alias("provider_id"),
        F.col("p_partkey").alias("shipment_id"),
        (F.col("p_partkey") % 10).alias("account_id"),
        (F.col("p_partkey") % 6).alias("discount_group_id"),
        money("p_retailprice").alias("amount"),
        zero.alias("insurance_amount"), zero.alias("amount_insurance_fee"),
        zero.alias("insurance_cost"),
        F.col("p_brand").alias("zone"), F.col("p_type").alias("servicelevel_name"),
        ts_lit("1997-03-01 00:00:00").alias("object_created"),
    )


def transaction(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("id"), F.col("o_custkey").alias("object_owner_id"),
        (k % 7).alias("track_status_id"), (k % 200).alias("api_rate_id"),
        (k % 5).alias("scan_form_id"),
        money("o_totalprice").alias("cost_usd"), money("o_totalprice").alias("amount"),
        (k % 11 == 0).alias("was_test"),
        F.when(F.col("o_orderstatus") == "P", "INVALID").otherwise("VALID").alias("object_state"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "ERROR")
        .when(F.col("o_orderpriority") == "2-HIGH", "QUEUED").otherwise("SUCCESS").alias("object_status"),
        F.concat(F.lit("TRK"), k.cast("string")).alias("tracking_number"),
        F.col("o_orderpriority").alias("entry_point"),
        F.col("o_orderdate").alias("object_created"), F.col("o_orderdate").alias("object_updated"),
    )


def track_status(region: DataFrame) -> DataFrame:
    return region.select(F.col("r_regionkey").cast(LongType()).alias("id"), F.col("r_name").alias("name"))


def auth_user(customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("apiuser_id"),
                           F.col("c_nationkey").cast(LongType()).alias("platform_id"),
                           F.col("c_name").alias("username"))


def refund(lineitem: DataFrame) -> DataFrame:
    return (lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1))
            .select(F.col("l_orderkey").alias("transaction_id"),
                    F.col("l_linestatus").alias("object_status"),
                    F.lit("RECEIVED").alias("carrier_status"),
                    F.col("l_shipdate").alias("approve_time"),
                    F.col("l_shipdate").alias("object_created")))


def fixture_sources(spark: SparkSession, sf_dir: str, next_facts: str = "current") -> AuditSources:
    """All reference tables as views over ``sf_dir``'s Parquet files."""
    r = lambda n: _read(spark, sf_dir, n)
    orders, lineitem, region = r("orders"), r("lineitem"), r("region")
    events, part, customer = r("events"), r("part"), r("customer")
    return AuditSources(
        user_override=user_override(events), user_type=user_type(region),
        invoice_item=invoice_item(lineitem), invoice=invoice(orders),
        currency=currency(region), fx_rates=fx_rates(lineitem, region),
        payment=payment(lineitem),
        processor={p: processor_period(orders, p) for p in PERIODS},
        branches=reference_branches(NEXT_FILE, next_facts),
        address=address(events), transaction=transaction(orders), rate=rate(part),
        track_status=track_status(region), auth_user=auth_user(customer),
        refund=refund(lineitem),
    )
