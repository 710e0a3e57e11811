"""Physical-plan shape: what must hold for the plans to scale."""

from __future__ import annotations

import pytest

from paymatch.audit import OUTPUTS, Audit
from paymatch.params import fixture_params
from paymatch.sources.fixtures import fixture_sources

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def audit(spark):
    """Plans as at scale: nothing kept, and no side small enough to broadcast."""
    spark.catalog.clearCache()  # cached data from other tests would replace the scans
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Audit(fixture_sources(spark, SF_SMALL), fixture_params(), reuse="none")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(OUTPUTS))
def test_no_cartesian_products(audit, name):
    p = plan(audit.output(name))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    assert "BroadcastExchange" not in p  # none is forced


@pytest.mark.parametrize("name", list(OUTPUTS))
def test_no_sort_aggregates(audit, name):
    if name == "recon_report_rollups":
        pytest.skip("bitmap buffers cannot be updated in place, so Spark sorts to build them")
    assert "SortAggregate" not in plan(audit.output(name))


@pytest.mark.parametrize("reuse", ["cache", "none"])
def test_building_outputs_starts_no_job(spark, reuse):
    sources = fixture_sources(spark, SF_SMALL)  # opening a Parquet folder reads its schema in a job
    spark.sparkContext.setJobGroup("building", "building")
    try:
        with Audit(sources, fixture_params(), reuse=reuse) as a:
            assert len(a.outputs()) == len(OUTPUTS)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_close_releases_all(spark):
    spark.catalog.clearCache()
    audit = Audit(fixture_sources(spark, SF_SMALL), fixture_params())
    audit.recon_report().count()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() > 0
    audit.close()
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_entry_queries_do_not_read_each_others_tables(spark):
    import __spark_entry__ as ep
    spark.catalog.clearCache()
    ep.queries()["recon_report"](spark, SF_SMALL).count()
    later = ep.queries()["invoice_check"](spark, SF_SMALL)
    assert "InMemoryTableScan" in plan(later)  # its own
    assert later.count() > 0
    ep._audit(spark, SF_SMALL)
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def scans(p: str, table: str) -> int:
    return sum("FileScan" in ln and f"{table}.parquet" in ln for ln in p.splitlines())


def test_one_scan_of_the_items_for_both_grains(spark):
    """Both grains of the totals read one kept aggregation of the item table, both payment summaries another."""
    with Audit(fixture_sources(spark, SF_SMALL), fixture_params()) as audit:
        for df in (audit.invoice_totals, audit.invoice_totals_by_owner):
            optimized = df._jdf.queryExecution().withCachedData().toString()
            assert "InMemoryRelation" in optimized
        assert audit.payment_groups_other._jdf.queryExecution().withCachedData().toString().count("InMemoryRelation") == 1


def test_label_detail_needs_no_wide_distinct(audit):
    """The last shuffle of the label rows is the one by transaction id that the refund join shares."""
    p = plan(audit.label_detail)
    wide = [ln for ln in p.splitlines() if "Exchange hashpartitioning(" in ln
            and ln.split("hashpartitioning(")[1].count("#") > 14]
    assert not wide


def test_item_window_reaches_scan(audit):
    p = plan(audit.invoice_totals)
    assert "GreaterThanOrEqual(l_shipdate,1997-01-01T00:00)" in p
    assert "LessThan(l_shipdate,1998" in p  # the plan text truncates long filters


def test_processor_periods_pruned_at_scan(audit):
    p = plan(audit.processor_rows)
    assert "GreaterThanOrEqual(o_orderdate,1996-10-01T00:00)" in p
    # only the columns the processor view needs are read
    assert "o_custkey" not in p


def test_top1_windows_get_group_limit(audit):
    assert "WindowGroupLimit" in plan(audit.latest_override)
    assert "WindowGroupLimit" in plan(audit.inputs().payments_other)


def test_top_processor_row_has_group_limit(audit):
    """Each map task sends on only its own best processor row per invoice number."""
    p = plan(audit.recon_backward())
    assert any("WindowGroupLimit" in ln and "gross" in ln for ln in p.splitlines())


def test_forward_reads_no_top_row(audit):
    p = plan(audit.recon_forward())
    assert not any("WindowGroupLimit" in ln and "gross" in ln for ln in p.splitlines())


def test_kept_tables_are_coalesced(spark):
    """A kept table has as many pieces as its bytes ask for, whatever number the shuffles are given; the setting is put back."""
    spark.catalog.clearCache()
    name = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before, n = spark.conf.get(name), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        with Audit(fixture_sources(spark, SF_SMALL), fixture_params()) as audit:
            rows = audit.processor_rows
            assert rows.count() > 0
            assert spark.conf.get(name) == before
            assert {r.getNumPartitions() for r in spark.sparkContext._jsc.getPersistentRDDs().values()} == {1}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)


def test_membership_does_not_sort_the_rows(audit):
    """Semi joins hash the distinct keys; the rows, mostly many times as many, are not sorted."""
    for df in (audit.payment_check, audit.invoice_check):
        p = plan(df)
        assert any("ShuffledHashJoin" in ln and "LeftSemi" in ln for ln in p.splitlines())
        assert not any("SortMergeJoin" in ln and "LeftSemi" in ln for ln in p.splitlines())


def test_payment_dates_take_one_exchange(audit):
    """The special method is judged in the aggregation that makes the dates, so no second one follows."""
    assert plan(audit.payment_dates).count("Exchange hashpartitioning") == 1
    assert "HashAggregate(keys=[_bp_id" not in plan(audit.invoice_payment_dates)
