"""Every registered query against its DuckDB oracle on the smallest test tables.

The oracle takes the long way (fan-out joins, reports from the joined rows,
UNION); the Spark plans use the rewrites. Equal row sets check both.
"""

import pytest

from helpers import duck_digest, duck_given, spark_digest
from paymatch.audit import OUTPUTS, Audit
from paymatch.oracle import oracle_queries
from paymatch.params import fixture_params
from paymatch.sources.fixtures import fixture_sources

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def audit(spark):
    return Audit(fixture_sources(spark, SF_SMALL), fixture_params())


@pytest.fixture(scope="module")
def duck():
    return duck_given(SF_SMALL)


@pytest.fixture(scope="module")
def sql():
    return oracle_queries(fixture_params())


@pytest.mark.parametrize("name", list(OUTPUTS))
def test_matches_oracle(audit, duck, sql, name):
    df = audit.output(name)
    cols, (n_oracle, h_oracle) = duck_digest(duck, sql[name])
    assert sorted(df.columns) == cols
    n, h = spark_digest(df)
    assert n == n_oracle
    assert h == h_oracle


def test_entry_point_runs(spark):
    import __spark_entry__ as ep
    df = ep.entry(spark)
    assert df.count() > 0
    assert set(OUTPUTS) <= set(ep.oracle_sql()) <= set(ep.queries())
