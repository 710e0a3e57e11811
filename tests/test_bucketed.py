"""Bucketed sides of the reconciliation: equal rows, no exchange, busy numbers split."""

from __future__ import annotations

import pytest

from paymatch.audit import Audit
from paymatch.bucketed import BucketedStar, deal, repeat
from paymatch.params import fixture_params
from paymatch.sources.fixtures import fixture_sources

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def audit(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    with Audit(fixture_sources(spark, SF_SMALL), fixture_params()) as a:
        yield a
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module", params=[1, 1_000_000], ids=["every number split", "none split"])
def star(audit, request):
    s = BucketedStar(audit, buckets=5, rows_per_part=request.param)
    yield s
    s.close()


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("by_owner", [False, True])
def test_equals_the_plain_joins(audit, star, by_owner):
    assert rows(star.forward(by_owner)) == rows(audit.recon_forward(by_owner))
    assert rows(star.backward(by_owner)) == rows(audit.recon_backward(by_owner))


@pytest.mark.parametrize("by_owner", [False, True])
def test_no_exchange(star, by_owner):
    for df in (star.forward(by_owner), star.backward(by_owner)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2
        assert "Exchange" not in plan
        assert "Bucketed: true" in plan


def test_busy_number_fills_no_bucket(spark):
    rows = [("busy", f"d{i}", 1) for i in range(8000)] + [("other", "d", 1)]
    parts = spark.createDataFrame([("busy", 8), ("absent", 3)], "_busy string, _parts long")
    dealt = deal(spark.createDataFrame(rows, "_key string, description string, _n int"), parts).groupBy("_key", "_part").count()
    found = {(r["_key"], r["_part"]): r["count"] for r in dealt.collect()}
    assert set(found) == {("busy", k) for k in range(8)} | {("other", 0)}
    assert max(found.values()) < 1200 and sum(found.values()) == 8001
    lookups = spark.createDataFrame([("busy", 5), ("other", 6), (None, 7)], "_key string, _sum int")
    assert sorted(map(tuple, repeat(lookups, parts).select("_key", "_part").where("_key is not null").collect())) == [
        *(("busy", k) for k in range(8)), ("other", 0)]


def test_close_drops_tables(spark, audit):
    star = BucketedStar(audit, buckets=2, rows_per_part=2, grains=(False,))
    parts = spark.table(star.tables[0])
    assert parts.where("_parts >= 2").count() == parts.count() > 0
    star.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(star.name)]


def test_sides_written_once_are_not_kept_as_well(spark):
    with Audit(fixture_sources(spark, SF_SMALL), fixture_params()) as a:
        star = BucketedStar(a, buckets=2, grains=(True,))
        try:
            assert not {"invoice_profile", "top_processor"} & set(vars(a))
        finally:
            star.close()
