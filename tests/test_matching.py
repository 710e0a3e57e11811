"""Band joins, running totals without whole-key windows, and the matches built on them."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paymatch import ReconParams
from paymatch.operators import Band, add, band_join, later, missing_in, present_in, row_numbers, running
from paymatch.plans.matching import charge_intervals, fuzzy_candidates, recon_allocated, receipt_intervals, reference_candidates

PROCESSOR = ("balance_transaction_id string, description string, reporting_category string, created_utc string, "
             "available_on_utc string, invoice_id string, stripe_month string, invoices_retry int, net_suite int, "
             "gross decimal(15,2), net decimal(15,2), customer_facing_amount decimal(15,2)")
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
SMALL = NO_BROADCAST | {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def settings(spark):
    before = {}

    def put(new):
        for k, v in new.items():
            before.setdefault(k, spark.conf.get(k, None))
            spark.conf.set(k, v)

    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    return qe.executedPlan().toString()


def processor_row(i, description, gross, day="2022-03-01", invoice=None, category="charge", retry=0, short=0, time="08:30:00"):
    amount = None if gross is None else D(gross)
    return (f"txn_{i}", description, category, None if day is None else f"{day} {time}", None, invoice, "Mar-22", retry, short,
            amount, amount, amount)


def test_band_join_is_the_range_join(spark):
    rng = random.Random(5)
    left = [(i, rng.choice([None, rng.randrange(-300, 300)]), rng.randrange(50)) for i in range(400)]
    right = [(i, rng.choice([None, rng.randrange(-300, 300)]), rng.choice([None, rng.randrange(50)])) for i in range(300)]
    a = spark.createDataFrame(left, "i int, v int, w int")
    b = spark.createDataFrame(right, "j int, x int, y int")
    for slack, width in ((0, 1), (7, 14), (100, 30)):
        met = band_join(a, b, [Band(F.col("v"), F.col("x") - slack, F.col("x") + slack, width),
                               Band(F.col("w"), F.col("y") - 3, F.col("y"), 4)])
        expected = sorted((i, j) for i, v, w in left for j, x, y in right if None not in (v, x, y)
                          and abs(v - x) <= slack and y - 3 <= w <= y)
        assert sorted((r.i, r.j) for r in met.collect()) == expected
    assert band_join(a, b.where("false"), [Band(F.col("v"), F.col("x"), F.col("x"), 1)]).count() == 0
    with pytest.raises(ValueError):
        Band(F.col("v"), F.col("x"), F.col("x"), 0)


def test_band_join_has_no_nested_loop_and_splits_a_hot_bucket(spark, settings):
    settings(SMALL)
    left = spark.range(60_000, numPartitions=8).selectExpr("if(id % 2 = 0, 7, id % 5000) AS v", "uuid() AS payload")
    right = spark.range(300).selectExpr("id AS x", "id AS j")
    plan = final_plan(band_join(left, right, [Band(F.col("v"), F.col("x"), F.col("x"), 1)]))
    assert "skew=true" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("operator", [present_in, missing_in])
@pytest.mark.parametrize("hot", ["left", "right"])
def test_membership_with_a_hot_key_on_either_side(spark, settings, operator, hot):
    """A hot left key is split at run time, a hot right key is one row after the map-side reduction."""
    settings(SMALL)
    many = spark.range(60_000, numPartitions=8).selectExpr(
        "if(id % 3 > 0, 'hot', concat('k', id % 500)) AS k", "uuid() AS payload")
    few = spark.range(300).selectExpr("concat('k', id) AS k", "uuid() AS payload").unionByName(
        spark.range(1).selectExpr("'hot' AS k", "uuid() AS payload"))
    left, right = (many, few) if hot == "left" else (few, many)
    out = operator(left, left["k"], right, "k")
    plain = left.join(right.select(F.col("k").alias("q")), left["k"] == F.col("q"),
                      "left_semi" if operator is present_in else "left_anti")
    assert out.count() == plain.count()
    plan = final_plan(out)
    assert ("skew=true" in plan) == (hot == "left")


def test_running_totals_equal_plain_windows(spark):
    """One key holds most rows, many of them on one day and in one second."""
    rng = random.Random(2)
    start = dt.datetime(2022, 1, 1)
    rows = [(i, rng.choice(["hot", "hot", f"k{i % 40}", None]),
             rng.choice([None, start, start + dt.timedelta(seconds=rng.randrange(9)), start + dt.timedelta(days=rng.randrange(3))]),
             rng.randrange(100)) for i in range(4000)]
    df = spark.createDataFrame(rows, "i int, k string, t timestamp_ntz, v int")
    levels = [F.to_date("t"), F.hour("t") * 3600 + F.second("t")]
    order = [F.col("i").asc()]
    window = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_first(), "i")
    frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for agg, combine in ((F.sum, add), (F.max, later), (F.min, F.least)):
        got = running(df, ["k"], levels, order, {"s": F.col("v")}, agg, combine).select("i", "s")
        plain = df.select("i", agg("v").over(frame).alias("s"))
        assert got.exceptAll(plain).count() == 0 and got.count() == len(rows)
    got = row_numbers(df, ["k"], levels, order, "n").select("i", "n")
    assert got.exceptAll(df.select("i", F.row_number().over(window).alias("n"))).count() == 0


def test_one_invoice_and_day_is_spread_over_tasks(spark, settings):
    """Row numbers of one key on one day: no window task holds more than a second's rows and a total per second."""
    settings(NO_BROADCAST | {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    df = spark.range(200_000, numPartitions=8).selectExpr(
        "7 AS k", "timestamp_ntz '2022-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 80000) AS t", "id")
    levels = [F.to_date("t"), F.hour("t") * 3600 + F.minute("t") * 60 + F.second("t").cast("int")]
    numbered = row_numbers(df, ["k"], levels, [F.col("t"), F.col("id")], "n")
    sizes = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) < 20_000
    window = Window.partitionBy("k").orderBy("t", "id")
    plain = df.select("id", F.row_number().over(window).alias("n"))
    assert numbered.select("id", "n").exceptAll(plain).count() == 0


def test_fuzzy_candidates_bounds(spark):
    totals = spark.createDataFrame(
        [(1, dt.datetime(2022, 3, 17, 23), D("10.00")), (2, dt.datetime(2022, 3, 18), D("10.00")),
         (3, dt.datetime(2021, 9, 1), D("10.05")), (4, dt.datetime(2021, 8, 31), D("10.00")), (5, dt.datetime(2022, 3, 1), D("10.06")),
         (6, dt.datetime(2022, 3, 1), None), (7, None, D("10.00")), (8, dt.datetime(2022, 3, 1), D("99.00"))],
        "invoice_id long, paid timestamp_ntz, converted_invcharge decimal(15,2)")
    processor = spark.createDataFrame([
        processor_row(1, "a", "10.00"), processor_row(2, None, "10.00", category="refund"), processor_row(3, "c", "10.00", invoice="8"),
        processor_row(4, "d", "10.00", category="fee"), processor_row(5, "e", None), processor_row(6, "f", "10.00", day=None),
        processor_row(7, "g", "50.00"), processor_row(8, "h", "10.00", invoice=""), processor_row(8, "h", "10.00", invoice="77")],
        PROCESSOR)
    params = ReconParams(fuzzy_tolerance=D("0.05"))
    got = sorted((r.balance_transaction_id, r.candidates, r.nearest_invoice_id, r.amount_gap, r.day_gap)
                 for r in fuzzy_candidates(params, processor, totals).collect())
    # 1: paid 16 days later; 2: 17 days later; 3: six months before, five cents more; 4: a day too early; 5: a cent too much
    assert got == [("txn_1", 2, 1, D("0.00"), 16), ("txn_2", 2, 1, D("0.00"), 16), ("txn_8", 2, 1, D("0.00"), 16),
                   ("txn_8", 2, 1, D("0.00"), 16)]
    exact = fuzzy_candidates(ReconParams(), processor, totals).collect()
    assert {(r.candidates, r.nearest_invoice_id) for r in exact} == {(1, 1)}
    assert fuzzy_candidates(params, processor, totals.where("false")).count() == 0


def test_reference_candidates_find_the_invoice_of_a_retry(spark):
    processor = spark.createDataFrame([
        processor_row(1, "Invoice 1969107 - retry 2", "1", invoice="19691072"), processor_row(2, "Invoice 1969107", "1", invoice="1969107"),
        processor_row(3, "Payout", "1", invoice=""), processor_row(4, None, "1"), processor_row(5, "12 of 345, 678", "1"),
        processor_row(6, "nothing 999999999999999999999", "1"), processor_row(7, "Invoice 1969107 - retry 2", "1", category="fee"),
        processor_row(8, "é12é", "1", invoice="12")], PROCESSOR)
    invoice = spark.createDataFrame([(1969107,), (2,), (12,), (678,), (345,), (None,), (12,)], "id long")
    got = {r.balance_transaction_id: (r.known_numbers, r.candidate_invoice_id, r.recovered)
           for r in reference_candidates(processor, invoice).collect()}
    assert got == {"txn_1": (2, "1969107", True), "txn_2": (1, "1969107", False), "txn_3": (0, None, False),
                   "txn_4": (0, None, False), "txn_5": (3, "345", True), "txn_6": (0, None, False),
                   "txn_7": (2, "1969107", True), "txn_8": (1, "12", False)}


def test_a_busy_number_is_split(spark, settings):
    settings(SMALL)
    rows = spark.range(40_000, numPartitions=8).selectExpr(
        "concat('t', id) AS balance_transaction_id", "concat('Invoice ', id + 1000, ' - retry 1') AS description",
        "'charge' AS reporting_category", "'2022-01-01' AS created_utc", "cast(1 as decimal(15,2)) AS gross", "'x' AS invoice_id")
    invoice = spark.range(5000).selectExpr("id")
    out = reference_candidates(rows, invoice)
    assert "skew=true" in final_plan(out)
    assert out.where("known_numbers = 2").count() == 4000 and out.where("known_numbers = 1").count() == 36_000


def allocation(totals, processor):
    """First in, first out by hand."""
    out = []
    keys = {t[0] for t in totals} | {p[0] for p in processor}
    for key in keys:
        charges = sorted([list(t[1:]) for t in totals if t[0] == key])
        receipts = sorted([list(p[1:]) for p in processor if p[0] == key])
        while charges or receipts:
            left = [s[0][-1] for s in (charges, receipts) if s]
            part = min(left)
            c, r = charges[0] if charges else None, receipts[0] if receipts else None
            out.append((key, c and c[0], c and c[1], r and r[0], r and r[1], part))
            for side in (charges, receipts):
                if side:
                    side[0][-1] -= part
                    if not side[0][-1]:
                        side.pop(0)
    return out


def test_allocation_counts_every_amount_once(spark):
    rng = random.Random(9)
    day = dt.datetime(2022, 1, 1)
    # one invoice holds most charges and most receipts
    totals = {(rng.choice([1, 1, 1, 2, 3, 4]), day, owner): D(rng.randrange(1, 900)) / 100 for owner in range(600)}
    totals |= {(9, day, 1): D("5.00"), (10, day, 1): D("5.00"), (11, day + dt.timedelta(1), 2): D("0.01")}
    paid = {(rng.choice([1, 1, 1, 2, 3, 8]), i): D(rng.randrange(1, 2000)) / 100 for i in range(300)}
    paid |= {(10, 900): D("5.00"), (11, 901): D("90000000.00")}
    charges = [(i, t, o, a) for (i, t, o), a in totals.items()]
    rows = [processor_row(k, "x", str(a), day=f"2022-01-0{1 + k % 5}", invoice=str(i)) for (i, k), a in paid.items()]
    ignored = [processor_row(5000, "x", "7", invoice="1", retry=1), processor_row(5001, "x", "7", invoice="1", category="refund"),
               processor_row(5002, "x", "-7", invoice="1"), processor_row(5003, "x", "7", invoice=""), processor_row(5004, "x", "7"),
               processor_row(5005, "x", None, invoice="1"), processor_row(5006, "x", "7", invoice="1", short=1)]
    frame = spark.createDataFrame([*charges, (1, day, 9999, D("-3.00")), (1, day, None, None)],
                                  "invoice_id long, paid timestamp_ntz, object_owner_id long, converted_invcharge decimal(15,2)")
    out = recon_allocated(charge_intervals(frame), receipt_intervals(spark.createDataFrame([*rows, *ignored], PROCESSOR)))
    expected = allocation([(str(i), t, o, a) for i, t, o, a in charges],
                          [(r[5], r[3], r[0], r[9]) for r in rows])
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(
        str((a, b, c, d, e, f.quantize(D("0.01")))) for a, b, c, d, e, f in expected)
    sums = out.agg(F.sum(F.when(F.col("paid").isNotNull(), F.col("allocated"))),
                   F.sum(F.when(F.col("created_utc").isNotNull(), F.col("allocated")))).first()
    assert tuple(sums) == (sum(totals.values()), sum(paid.values()))
