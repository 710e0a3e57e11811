"""Generic operators and column helpers."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paymatch.functions import (
    date_before,
    flag,
    minute_text,
    money,
    month_label,
    month_label_upper,
    reference_digits,
    text_date,
    trunc_text,
)
from paymatch.operators import (
    convert,
    lookup_flag,
    missing_in,
    number_per_key,
    present_in,
    salted_key,
    skew_join,
    time_window,
    top_per_key,
)


def test_reference_digits_concatenates_all_runs(spark):
    df = spark.createDataFrame([("Invoice 1969107 - retry 2",), ("Payout",), (None,)], "d string")
    got = [r[0] for r in df.select(reference_digits("d")).collect()]
    assert got == ["19691072", "", None]


def test_text_date_and_month_labels(spark):
    df = spark.createDataFrame([("2022-09-05 12:00:00",)], "t string")
    r = df.select(text_date("t").alias("d")).select(
        "d", month_label("d").alias("m"), month_label_upper("d").alias("u")).first()
    assert r.d == dt.date(2022, 9, 5) and r.m == "Sep-22" and r.u == "SEP-22"


def test_money_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([(D("2.345"),), (D("-2.345"),)], "x decimal(10,3)")
    assert [r[0] for r in df.select(money("x")).collect()] == [D("2.35"), D("-2.35")]


def test_trunc_text_truncates_like_varchar(spark):
    df = spark.createDataFrame([("LONGCODE",)], "c string")
    assert df.select(trunc_text("c", 5)).first()[0] == "LONGC"


def test_flag_null_condition_is_zero(spark):
    df = spark.createDataFrame([(None,), ("a-b",)], "d string")
    assert [r[0] for r in df.select(flag(F.col("d").contains("-"))).collect()] == [0, 1]


def test_date_before_promotes_date_to_midnight(spark):
    df = spark.createDataFrame([(dt.datetime(1995, 12, 31, 23, 0),), (dt.datetime(1996, 1, 1, 5),)],
                               "t timestamp_ntz")
    assert [r[0] for r in df.select(date_before("t", "1996-01-01 00:00:00")).collect()] == [True, False]


def test_minute_text(spark):
    df = spark.createDataFrame([(dt.datetime(1997, 1, 2, 3, 4, 5),)], "t timestamp_ntz")
    assert df.select(minute_text("t")).first()[0] == "1997-01-02 03:04"


def test_convert_zero_rate_is_null(spark):
    df = spark.createDataFrame([(D("10.00"), D("0.00")), (D("10.00"), D("4.00"))],
                               "a decimal(15,2), r decimal(15,2)")
    got = [r[0] for r in df.select(convert(F.col("a"), F.col("r"))).collect()]
    assert got[0] is None and got[1] == D("2.5")


def test_time_window_is_half_open(spark):
    df = spark.createDataFrame([(dt.datetime(1997, 1, 1),), (dt.datetime(1998, 1, 1),)], "t timestamp_ntz")
    assert time_window(df, "t", "1997-01-01 00:00:00", "1998-01-01 00:00:00").count() == 1


def test_top_per_key_ties_and_nulls_first(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (2, 3), (2, 3), (2, 1)], "k int, v int")
    one = top_per_key(df, ["k"], [F.col("v").desc_nulls_first()])
    assert sorted((r.k, r.v) for r in one.collect()) == [(1, None), (2, 3)]
    ties = top_per_key(df, ["k"], [F.col("v").desc_nulls_first()], ties="all")
    assert ties.where("k = 2").count() == 2


def test_lookup_flag_with_hot_null_and_hot_value(spark):
    rows = [(None, i) for i in range(200)] + [("hot", i) for i in range(200)] + [("cold", 1)]
    facts = spark.createDataFrame(rows, "d string, i int")
    lookup = spark.createDataFrame([("hot",), ("hot",), (None,)], "d string")
    out = lookup_flag(facts, "d", lookup, "d", "m", spread=("i",))
    res = {(r.d, r.m) for r in out.select("d", "m").distinct().collect()}
    assert res == {(None, False), ("hot", True), ("cold", False)}
    assert out.count() == len(rows)


def test_salted_key_spreads_nulls_and_never_matches(spark):
    df = spark.createDataFrame([(None, i) for i in range(1000)], "k string, i int")
    salted = df.select(salted_key("k", "i", buckets=64).alias("s"))
    assert salted.distinct().count() > 32
    assert salted.where(F.col("s").rlike("^[0-9]*$")).count() == 0


def test_semi_and_anti(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    keys = spark.createDataFrame([(2,), (None,)], "k long")
    assert [r.k for r in present_in(df, df["k"], keys, "k").collect()] == [2]
    assert sorted(r.k for r in missing_in(df, df["k"], keys, "k").collect() if r.k is not None) == [1]


def test_salted_key_spreads_empty_keys_on_request(spark):
    df = spark.createDataFrame([("", i) for i in range(1000)] + [("7", 1), (None, 2)], "k string, i int")
    assert df.select(salted_key("k", "i", blank=True, buckets=64).alias("s")).distinct().count() > 32
    assert df.select(salted_key("k", "i").alias("s")).distinct().count() == 3
    assert df.where(salted_key("k", "i", blank=True) == "7").count() == 1


def test_salted_key_needs_columns_to_spread_by(spark):
    with pytest.raises(ValueError):
        salted_key("k")


def test_numbering_in_parts_equals_window(spark):
    """A key with half of all rows is numbered part by part; the numbers must
    equal the plain window's, NULL keys and NULL order values included."""
    import random
    rnd = random.Random(7)
    rows = [(1, rnd.randrange(10_000_000), i) for i in range(3000)]           # hot key
    rows += [(k % 50, rnd.randrange(10_000_000), i) for k, i in zip(range(2, 3002), range(3000, 6000))]
    rows += [(None, i, 10_000 + i) for i in range(40)] + [(7, None, 20_000), (7, None, 20_001)]
    df = spark.createDataFrame(rows, "k int, t long, id int").repartition(13)
    order = [F.col("t").desc_nulls_first(), F.col("id").asc()]
    parts = number_per_key(df, ["k"], order, "rn", part=F.floor(F.col("t") / 1_000_000),
                           part_order=F.col("_rn_part").desc_nulls_first()).select("id", "rn")
    plain = df.select("id", F.row_number().over(Window.partitionBy("k").orderBy(*order)).alias("rn"))
    assert parts.exceptAll(plain).count() == 0 and plain.exceptAll(parts).count() == 0
    assert parts.count() == len(rows)


def test_skew_join_equals_plain_join(spark):
    facts = spark.createDataFrame(
        [("hot", i) for i in range(900)] + [("warm", i) for i in range(300)]
        + [(None, i) for i in range(300)] + [(f"k{i}", i) for i in range(600)], "k string, i int")
    dim = spark.createDataFrame([("hot", "H"), ("warm", "W"), ("k1", "one"), ("k1", "uno"),
                                 (None, "null")], "dk string, v string")
    for how in ("left", "inner"):
        plain = facts.join(dim, facts.k == dim.dk, how).select("k", "i", "v")
        split = skew_join(facts, dim, "k", "dk", how).select("k", "i", "v")
        assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0


@pytest.mark.parametrize("join", ["lookup", "semi"])
def test_a_hot_key_is_split_at_run_time(spark, join):
    """With broadcasts off and small thresholds, the adaptive plan splits the
    partition that holds a hot key, although the lookup side is de-duplicated."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.shuffle.partitions": "16",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        facts = spark.range(60_000, numPartitions=8).selectExpr(
            "if(id % 2 = 0, 'hot', concat('k', id % 500)) AS k", "uuid() AS payload", "id")
        keys = spark.range(3000).selectExpr("if(id < 50, 'hot', concat('k', id % 700)) AS k")
        out = (lookup_flag(facts, "k", keys, "k", "m", spread=("id",)) if join == "lookup"
               else present_in(facts, facts["k"], keys, "k"))
        qe = out._jdf.queryExecution()
        assert qe.toRdd().count() == 60_000
        assert "skew=true" in qe.executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
