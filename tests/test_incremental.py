"""Layout by period, partials and their manifest, bitmap counts, publication by control totals."""

from __future__ import annotations

import datetime as dt
import os
import threading
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from paymatch.audit import Audit
from paymatch.incremental import Partials, _together
from paymatch.operators import bitmaps, dense_ids, merged_counts, time_window
from paymatch.params import fixture_params
from paymatch.plans.invoices import item_partials, merged_item_totals
from paymatch.plans.payments import payment_partials
from paymatch.sinks import ControlTotalsError, observed_write, publish_outputs
from paymatch.sources.fixtures import fixture_sources
from paymatch.sources.layout import write_by_period

from conftest import SF_SMALL

ITEMS = ("invoice_id long, object_created timestamp_ntz, object_updated timestamp_ntz, amount decimal(15,2), "
         "object_purpose string, currency_id long, object_owner_id long, transaction_id long")


def items(spark, *rows):
    """Rows (day, invoice, amount)."""
    data = [(i, d, d, D(a), "LABEL", 1, 2, 3) for d, i, a in
            [(dt.datetime.fromisoformat(d) if d else None, i, a) for d, i, a in rows]]
    return spark.createDataFrame(data, ITEMS)


def sums(store):
    return {(str(r.updated_day), r.invoice_id): r._charge for r in store.read().collect()}


def test_refresh_reads_only_changed_days(spark, tmp_path):
    path, column = str(tmp_path / "items"), "object_updated"
    first = items(spark, ("1997-01-01 05:00:00", 1, "1.00"), ("1997-01-01 06:00:00", 1, "2.00"), ("1997-01-02", 1, "4.00"),
                  (None, 9, "9.00"))
    write_by_period(first, path, column)
    store = Partials(spark, "api_invoiceitem", path, str(tmp_path / "partials"))
    assert store.refresh() == [dt.date(1997, 1, 1), dt.date(1997, 1, 2)]
    assert sums(store) == {("1997-01-01", 1): D("3.00"), ("1997-01-02", 1): D("4.00")}
    assert store.refresh() == []
    # a late row of an old day, and a new day
    write_by_period(items(spark, ("1997-01-01 23:59:59", 7, "8.00"), ("1997-01-03", 1, "16.00")), path, column)
    plan = store.changed([dt.date(1997, 1, 3)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_day_object_updated" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.changed([dt.date(1997, 1, 3)]).agg(F.sum("_charge")).first()[0] == D("16.00")
    assert store.refresh() == [dt.date(1997, 1, 1), dt.date(1997, 1, 3)]
    assert sums(store) == {("1997-01-01", 1): D("3.00"), ("1997-01-01", 7): D("8.00"), ("1997-01-02", 1): D("4.00"),
                           ("1997-01-03", 1): D("16.00")}
    # a refresh that was cut off before its manifest changes nothing
    os.makedirs(tmp_path / "partials" / "partials" / "refresh=9" / "_day_object_updated=1997-01-02")
    assert sums(store)["1997-01-02", 1] == D("4.00")


def test_window_prunes_the_layout(spark, tmp_path):
    rows = items(spark, *[(f"1997-{m:02d}-15 12:00:00", m, "1.00") for m in range(1, 13)], (None, 0, "1.00"))
    for grain in ("day", "month"):
        path = str(tmp_path / grain)
        write_by_period(rows, path, "object_updated", grain)
        cut = time_window(spark.read.parquet(path), "object_updated", "1997-03-15 12:00:00", "1997-05-15 12:00:01")
        assert sorted(r.invoice_id for r in cut.collect()) == [3, 4, 5]
        assert {f.split(f"_{grain}_object_updated=")[1][:7] for f in cut.select(F.input_file_name()).distinct()
                .toPandas().iloc[:, 0]} == {"1997-03", "1997-04", "1997-05"}
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert f"_{grain}_object_updated" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    with pytest.raises(ValueError, match="grain"):
        write_by_period(rows, str(tmp_path / "week"), "object_updated", "week")


def test_partials_need_whole_days(spark):
    src = fixture_sources(spark, SF_SMALL)
    p = fixture_params().with_(query_start="1997-01-01 06:00:00")
    with pytest.raises(ValueError, match="whole days"):
        merged_item_totals(item_partials(src.invoice_item), src, p)


def test_bitmap_counts_equal_distinct_counts(spark):
    rows = [("a" if i % 3 else None, i % 5, f"v{i % 701}" if i % 7 else None, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, n int, v string, x long").repartition(5)
    ids = dense_ids(df, "v", "_number")
    assert sorted(r._number for r in ids.collect()) == list(range(1, 702))
    # the numbers are a function of the values alone
    assert {tuple(r) for r in ids.collect()} == {tuple(r) for r in dense_ids(df.repartition(2), "v", "_number").collect()}
    # far apart, so that the bitmaps take several blocks
    numbered = df.join(ids.withColumn("_number", F.col("_number") * 5000), "v", "left")
    maps = bitmaps(numbered, ["k", "n"], "_number", [F.sum("x").alias("x")])
    assert maps.select("_block").distinct().count() > 50
    got = {(r.grain, r.k, r.n): (r.values, r.x) for r in merged_counts(maps, ["k", "n"], [["k", "n"], ["n"], []], "values", ["x"]).collect()}
    expected: dict = {}
    for k, n, v, x in rows:
        for key in (("k,n", k, n), ("n", None, n), ("", None, None)):
            found = expected.setdefault(key, (set(), [0]))
            found[0].add(v)
            found[1][0] += x
    assert got == {key: (len(values - {None}), total[0]) for key, (values, total) in expected.items()}


def test_publication_needs_equal_totals(spark, tmp_path):
    root = str(tmp_path / "published")
    names = ["invoice_totals_usd", "invoice_totals_usd_by_owner"]
    with Audit(fixture_sources(spark, SF_SMALL), fixture_params()) as audit:
        totals = publish_outputs(audit, root, names)
        rows = spark.read.parquet(f"{root}/invoice_totals_usd")
        assert totals["invoice_totals_usd"]["rows"] == rows.count() > 0
        assert totals["invoice_totals_usd"]["invcharge"] == rows.agg(F.sum("invcharge")).first()[0]
        before = sorted(os.listdir(f"{root}/invoice_totals_usd"))
        # control totals that do not fit, as of an export with a file missing
        with pytest.raises(ControlTotalsError, match="expected 1$"):
            publish_outputs(audit, root, names, {"invoice_totals_usd": {"rows": 1}})
        # one grain lost a row
        audit.invoice_totals_by_owner = audit.invoice_totals_by_owner.where(
            F.col("invoice_id") != rows.where("invcharge > 0").first().invoice_id)
        with pytest.raises(ControlTotalsError, match="invcharge"):
            publish_outputs(audit, root, names)
        assert sorted(os.listdir(f"{root}/invoice_totals_usd")) == before
        assert os.listdir(tmp_path) == ["published"]
        again = publish_outputs(audit, root, names[:1])
        assert again["invoice_totals_usd"] == totals["invoice_totals_usd"]
        assert sorted(os.listdir(root)) == names[:1] and os.listdir(tmp_path) == ["published"]


def test_observed_totals_of_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "a decimal(10,2), b string")
    assert observed_write(empty, str(tmp_path / "empty")) == {"rows": 0, "a": None}


def test_periods_are_listed_without_reading_rows(spark, tmp_path):
    """The digest of a period follows from its files' names, sizes and times: files that hold no Parquet at all are listed too."""
    for day in ("1997-01-01", "1997-01-02", "__HIVE_DEFAULT_PARTITION__"):
        folder = tmp_path / "items" / f"_day_object_updated={day}"
        folder.mkdir(parents=True)
        (folder / "part-0.parquet").write_text(day)
    store = Partials(spark, "api_invoiceitem", str(tmp_path / "items"), str(tmp_path / "partials"))
    first = store.periods_now()
    assert set(first) == {dt.date(1997, 1, 1), dt.date(1997, 1, 2)}
    (tmp_path / "items" / "_day_object_updated=1997-01-02" / "part-1.parquet").write_text("more")
    assert store.periods_now()[dt.date(1997, 1, 1)] == first[dt.date(1997, 1, 1)]
    assert store.periods_now()[dt.date(1997, 1, 2)] != first[dt.date(1997, 1, 2)]


def test_payment_partials_take_one_exchange(spark, tmp_path):
    created = dt.datetime(1997, 1, 5)
    rows = [(1, 1, 1, 1, created, created, D("2.00")), (2, 1, 1, 1, created, created, D("2.00")),
            (3, 1, 1, 1, created, created, D("3.00")), (4, 1, None, 1, created, created, D("9.00"))]
    pay = spark.createDataFrame(rows, "id long, invoice_id long, payment_method_id int, currency_id long, "
                                "object_created timestamp_ntz, object_updated timestamp_ntz, amount decimal(15,2)")
    partials = payment_partials(pay)
    assert sorted(r._sum for r in partials.collect()) == [D("2.00"), D("3.00")]
    assert payment_partials(pay)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_tables_do_not_wait_for_each_other(spark):
    both = threading.Barrier(2, timeout=60)
    spark.sparkContext.setLocalProperty("refresh.mark", "here")
    try:
        def step(table, value):
            both.wait()
            return table, value, spark.sparkContext.getLocalProperty("refresh.mark")
        assert _together(spark, step, {"a": 1, "b": 2}) == {"a": ("a", 1, "here"), "b": ("b", 2, "here")}
    finally:
        spark.sparkContext.setLocalProperty("refresh.mark", None)
