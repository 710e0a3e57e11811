"""Sources (CSV exports with file provenance, Parquet tables) and sinks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paymatch.audit import Audit
from paymatch.params import fixture_params
from paymatch.sinks import REFERENCE_VIEW_NAMES, register_views, write_outputs
from paymatch.sources import conform, read_processor_exports
from paymatch.sources.fixtures import fixture_sources

from conftest import SF_SMALL


def test_processor_csv_exports_carry_file_name(spark, tmp_path):
    header = ("balance_transaction_id,description,reporting_category,created_utc,available_on_utc,"
              "gross,net,customer_facing_amount\n")
    (tmp_path / "Itemized_2023-01.csv").write_text(
        header + "txn_1,Invoice 100001,charge,2023-01-05 08:00:00,2023-01-07 00:00:00,10.00,9.70,10.00\n")
    (tmp_path / "Itemized_2023-02.csv").write_text(
        header + "txn_2,Payout,payout,2023-02-05 08:00:00,2023-02-07 00:00:00,-5.00,-5.00,-5.00\n")
    df = read_processor_exports(spark, [str(tmp_path / "*.csv")])
    rows = {r.balance_transaction_id: r for r in df.collect()}
    assert rows["txn_1"].file_name == "Itemized_2023-01.csv"
    assert str(rows["txn_2"].gross) == "-5.00"
    # the file-name filter of a branch (S4) works on the provenance column
    assert df.where(F.col("file_name").isin("Itemized_2023-02.csv")).count() == 1


def test_write_outputs_and_reference_views(spark, tmp_path):
    audit = Audit(fixture_sources(spark, SF_SMALL), fixture_params())
    paths = write_outputs(audit, str(tmp_path), ["recon_report", "processor_rows"])
    back = spark.read.parquet(paths["recon_report"])
    assert back.count() == audit.recon_report().count()
    register_views(audit)
    n = spark.sql("SELECT count(*) FROM Stripe_data WHERE net_suite = 0").first()[0]
    assert n == audit.processor_rows.where("net_suite = 0").count()
    assert set(REFERENCE_VIEW_NAMES) <= set(audit.outputs())


def test_audit_checkpoint_reuse(spark):
    audit = Audit(fixture_sources(spark, SF_SMALL), fixture_params(), reuse="checkpoint")
    assert audit.processor_rows.count() > 0
    with pytest.raises(ValueError):
        Audit(fixture_sources(spark, SF_SMALL), fixture_params(), reuse="local")


def test_conform_passes_other_columns_and_names_missing_ones(spark):
    df = spark.createDataFrame([(1, "A", "x")], "id int, iso string, note string")
    out = conform(df, "api_currency")
    assert out.dtypes == [("id", "bigint"), ("iso", "string"), ("note", "string")]
    with pytest.raises(ValueError, match="iso, id|id, iso"):
        conform(df.select("note"), "api_currency")


def test_zoned_timestamps_need_utc(spark):
    src = fixture_sources(spark, SF_SMALL)
    zoned = src.with_(invoice=src.invoice.withColumn("paid", F.col("paid").cast("timestamp")))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="UTC"):
            Audit(zoned, fixture_params())
        with pytest.raises(ValueError, match="UTC"):
            conform(zoned.invoice, "api_invoice")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture(scope="module")
def reference_tables(spark, tmp_path_factory):
    """The fixture sources as reference-named Parquet tables, with more columns and
    zoned timestamps; the previous period as CSV exports; a second snapshot."""
    src = fixture_sources(spark, SF_SMALL)
    root = tmp_path_factory.mktemp("reference")
    for name, df in src.as_dict().items():
        zoned = [F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes]
        df.select(*zoned, F.lit("more").alias(f"{name}_note")).write.parquet(str(root / "tables" / name))
        if name in ("api_invoice", "billing_payment"):
            df.write.parquet(str(root / "snapshot" / name))
    (src.processor["previous"].drop("file_name").coalesce(1).write.option("header", True)
     .csv(str(root / "exports")))
    return src, root


def test_batch_cli_on_reference_tables(spark, reference_tables):
    """All outputs of the batch entry point, in a session that is not on UTC,
    equal the oracle's over the same rows; whole rows pass through."""
    from helpers import duck_digest, duck_given, spark_digest
    from paymatch.__main__ import main
    from paymatch.audit import OUTPUTS
    from paymatch.oracle import oracle_queries
    from paymatch.sources.fixtures import NEXT_FILE

    src, root = reference_tables
    p = fixture_params()
    out = root / "out"
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        main(["--root", str(root / "tables"), "--out", str(out), "--next-file", NEXT_FILE,
              "--export", f"previous={root}/exports/*.csv", "--period", "current=processor_current",
              "--period", "next=processor_next", "--unqualified-root", str(root / "snapshot"),
              "--query-start", p.query_start, "--query-end", p.query_end,
              "--source-start", p.source_start, "--source-end", p.source_end,
              "--provider-id", str(p.provider_id), "--excluded-user", str(p.excluded_users[0]),
              "--first-item-cutoff", p.first_item_cutoff, "--billing-floor", p.billing_floor,
              "--fuzzy-tolerance", str(p.fuzzy_tolerance), "--reuse", "cache"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    con, sql = duck_given(SF_SMALL), oracle_queries(p)
    notes = {"default_address": "api_apiaddress_note", "unmatched_payments": None, "unmatched_items": "api_invoiceitem_note",
             "unmatched_transactions": "api_transaction_note"}
    for name in OUTPUTS:
        got = spark.read.parquet(str(out / name))
        if notes.get(name):
            assert got.where(F.col(notes[name]) != "more").count() == 0
            got = got.drop(notes[name])
        cols, expected = duck_digest(con, sql[name])
        assert sorted(got.columns) == cols
        assert spark_digest(got) == expected, name
