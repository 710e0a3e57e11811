"""

The rows are written once as Parquet; Spark reads them through the normal
source path, DuckDB runs the oracle (the reference's literal SQL shape) over
the same files. Every registered output must agree, and a few outputs are
also checked against values worked out by hand.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from helpers import duck_digest, sources_from, spark_digest, write_reference_tables
from paymatch.audit import OUTPUTS, Audit
from paymatch.oracle import oracle_queries
from paymatch.params import fixture_params
from paymatch.sources import reference_branches
from paymatch.sources.fixtures import NEXT_FILE
from paymatch.sources.schemas import SCHEMAS


def T(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


CUR_FILE = "activity_1997-02.csv"


def proc(txn, desc, cat, day, gross, file=CUR_FILE):
    g = None if gross is None else D(gross)
    net = None if g is None else g - D("0.30")
    return (txn, desc, cat, f"{day} 08:30:00", f"{day} 20:00:00", g, net, g, file)


ROWS = {
    "api_invoice": [
        (100001, T("1997-02-01"), T("1995-06-01")),
        (100002, T("1997-03-05"), T("1997-03-01")),
        (100003, T("1996-12-20"), T("1996-12-01")),
        (100004, T("1997-05-01"), T("1997-04-01")),
        (100004, T("1997-05-01"), T("1997-04-01")),   # duplicated invoice row
        (100005, None, T("1997-01-01")),              # unpaid
        (100006, T("1997-07-01"), T("1997-07-01")),   # no processor row, no payment
        (123, T("1997-06-01"), T("1997-06-01")),
    ],
    "api_invoiceitem": [
        (100001, T("1997-01-20"), T("1997-02-01 10:00:00"), D("100.00"), "LABEL", 0, 7, 1),
        (100001, T("1997-01-21"), T("1997-02-02 11:00:00"), D("30.00"), "REFUND", 1, 7, 1),
        (100001, T("1997-01-22"), T("1997-02-02 12:00:00"), D("20.00"), None, 1, 8, 1),
        (100001, T("1997-01-22"), T("1997-02-02 12:00:00"), None, "LABEL", 1, 8, 1),
        (100002, T("1997-03-01"), T("1997-03-05"), D("50.00"), "LABEL", 2, 7, 2),
        (100004, T("1997-04-01"), T("1997-05-01"), D("10.00"), "LABEL", 3, 9, 4),
        (100004, T("1997-04-01"), T("1997-05-01"), D("5.00"), "REFUND", 4, 9, 4),
        (100005, T("1997-01-01"), T("1997-01-02"), D("12.00"), "LABEL", 0, 7, 5),
        (None, T("1997-01-01"), T("1997-02-01"), D("1.00"), "LABEL", 0, 1, 9),
        (100003, T("1996-12-01"), T("1997-01-03"), D("9.00"), "LABEL", 0, 7, 3),
        (123, T("1997-06-01"), T("1997-06-01"), D("40.00"), "LABEL", 0, 7, 5),
        (100006, T("1997-07-01"), T("1997-07-01"), D("77.00"), "LABEL", 0, 5, 6),
    ],
    "api_currency": [(0, "USD"), (1, "EUR"), (2, "ZZZ"), (3, "LONGCODE"), (4, "GBP")],
    "fx_rates": [
        *[("USD", d(x), D("1.0000")) for x in
          ("1997-01-02", "1997-01-03", "1997-02-01", "1997-02-03", "1997-02-04", "1997-02-05",
           "1997-03-06", "1997-03-07", "1997-03-08", "1997-06-01", "1997-07-01", "1997-07-02")],
        ("EUR", d("1997-02-02"), D("2.0040")),
        ("ZZZ", d("1997-03-05"), D("0.0040")),      # rounds to 0.00 (T5)
        ("LONGCODE", d("1997-05-01"), D("4.0000")),  # code longer than 5 (T4)
        ("GBP", d("1997-05-01"), D("5.0000")),
        ("GBP", d("1997-05-01"), D("8.0000")),      # two rates one day
    ],
    "billing_payment": [
        (1, 100001, 1, 0, T("1997-02-03"), T("1997-02-03"), D("100.00")),
        (2, 100001, 1, 0, T("1997-02-03"), T("1997-02-03"), D("100.00")),   # copy (K9)
        (3, 100001, 3, 0, T("1997-02-04"), T("1997-02-04"), D("10.00")),
        (4, 100002, 2, 0, T("1997-03-06"), T("1997-03-06"), D("50.00")),
        (5, 100002, 2, 0, T("1997-03-06"), T("1997-03-07"), D("50.00")),   # tie on created
        (6, 100004, None, 0, T("1997-05-02"), T("1997-05-02"), D("3.00")),  # NULL method
        (100002, 100002, 1, 0, T("1997-03-08"), T("1997-03-08"), D("5.00")),  # id = invoice no (K5)
        (100001, 555, 1, 0, T("1997-02-05"), T("1997-02-05"), D("7.00")),
        (7, None, 1, 0, T("1997-07-02"), T("1997-07-02"), D("2.00")),
        (8, 100006, 3, 0, T("1997-07-02"), T("1997-07-02"), D("2.00")),
    ],
    "processor_current": [
        proc("t1", "Invoice 100001", "charge", "1997-02-01", "100.00"),
        proc("t1", "Invoice 100001", "charge", "1997-02-01", "100.00"),        # exact copy
        proc("t2", "Invoice 100001", "charge", "1997-02-01", None),            # NULL gross (T1)
        proc("t3", "Invoice 100002", "charge", "1997-03-05", "50.00"),
        proc("t4", "Invoice 100002", "refund", "1997-03-05", "50.00"),         # tied gross (K10)
        proc("t5", "Invoice 100004 - retry 1", "charge", "1997-05-01", "10.00"),
        proc("t8", "retry fee", "fee", "1997-05-02", "1.00"),
        proc("t9", "reattempt fee", "fee", "1997-05-02", "1.00"),
        proc("t9b", "reattempt 100004", "charge", "1997-05-02", "1.00"),
        proc("t10", "Invoice 123", "charge", "1997-06-01", "40.00"),
        proc("t11", "Invoice 00100001", "charge", "1997-06-02", "4.00"),       # leading zeros (T2)
        proc("t12", "Invoice 1234567890123456789012", "charge", "1997-06-03", "4.00"),
        proc("t13", "Preauthorization hold for first label purchase 100004", "charge",
             "1997-05-03", "2.00"),
        proc("t14", "no digits here", "refund", "1997-06-04", "3.00"),
        proc("c_nf", "retry fee", "fee", "1997-12-30", "1.00", NEXT_FILE),    # K1 branch 2
        *[proc(f"tp{i}", "Payout", "charge" if i % 2 else "fee", "1997-08-01", f"{i}.00")
          for i in range(1, 31)],                                              # hot key
        *[proc(f"tn{i}", None, "fee", "1997-08-02", f"{i}.00") for i in range(1, 21)],  # NULLs
    ],
    "processor_previous": [
        proc("p1", "Invoice 100001", "charge", "1996-12-15", "11.00"),
        proc("p2", "retry fee", "fee", "1996-12-16", "1.00"),
        proc("p3", "Invoice 100003", "charge", "1996-12-17", "9.00"),
        proc("p4", "Payout", "fee", "1996-12-18", "5.00"),
    ],
    "processor_next": [
        proc("n1", "Invoice 100004", "charge", "1998-01-05", "10.00", NEXT_FILE),
        proc("n2", "retry fee", "fee", "1998-01-06", "1.00", NEXT_FILE),
        proc("n3", "Invoice 100002", "charge", "1998-02-06", "1.00", "activity_1998-02.csv"),
    ],
    "user_useroverride": [
        (1, 10, "A", 1, "p"), (2, 10, "B", 2, "p"), (2, 10, "C", 9, "q"),
        (None, 11, "N", 1, "x"), (5, 11, "M", 1, "y"), (6, None, "Z", 1, "z"),
        (7, 12, "Q", 2, "w"),
    ],
    "user_usertype": [(1, "one"), (2, "two")],
    "api_apiaddress": [
        (1, 10, T("1997-01-01"), True), (2, 10, T("1997-01-01"), True),
        (1, 10, T("1997-01-01"), True), (3, 10, T("1996-01-01"), False),
        (4, 11, None, True), (5, 11, T("1997-02-01"), True),
        (6, 12, T("1997-01-01"), None), (7, None, T("1997-01-01"), True),
    ],
    "api_transaction": [
        (1, 10, 0, 1, 1, D("5.00"), D("5.00"), False, "VALID", "SUCCESS", "TRK1", "API",
         T("1997-02-01"), T("1997-02-02")),
        (2, 10, 5, 1, None, D("6.00"), D("6.00"), False, "VALID", "SUCCESS", "TRK2", "WEB",
         T("1997-02-03"), T("1997-02-03")),
        (3, 11, 0, 2, 1, D("7.00"), D("7.00"), True, "VALID", "SUCCESS", "TRK3", "API",
         T("1997-02-04"), T("1997-02-04")),
        (4, 1, 0, 1, 1, D("8.00"), D("8.00"), False, "VALID", "SUCCESS", "TRK4", "API",
         T("1997-02-05"), T("1997-02-05")),
        (5, 10, 0, 1, 1, D("9.00"), D("9.00"), False, "VALID", "ERROR", "TRK5", "API",
         T("1997-02-06"), T("1997-02-06")),
        (6, 12, 0, 3, 1, D("1.00"), D("1.00"), False, "VALID", "SUCCESS", "TRK6", "API",
         T("1997-02-07"), T("1997-02-07")),
        (7, 10, 0, 1, 1, D("2.00"), D("2.00"), False, "VALID", "SUCCESS", "TRK7", "API",
         T("1995-02-07"), T("1995-02-07")),
        (8, 12, 0, 2, 1, D("2.00"), D("2.00"), None, "VALID", "SUCCESS", "TRK8", "API",
         T("1997-03-07"), T("1997-03-07")),
        (9, 12, 0, 2, 1, D("2.00"), D("2.00"), False, "VALID", None, "TRK9", "API",
         T("1997-03-08"), T("1997-03-08")),
        (10, 13, 0, 2, 1, D("2.00"), D("2.00"), False, "VALID", "SUCCESS", "TRK10", "API",
         T("1997-03-09"), T("1997-03-09")),
    ],
    "api_rate": [
        (1, 1, 7, 1, 1, 3, D("10.00"), D("0"), D("0"), D("0"), "z1", "s1", T("1997-03-01")),
        (2, 2, 7, 2, 1, 9, D("11.00"), D("0"), D("0"), D("0"), "z2", "s2", T("1997-03-01")),
        (3, 3, 3, 3, 1, 1, D("12.00"), D("0"), D("0"), D("0"), "z3", "s3", T("1997-03-01")),
    ],
    "track_status": [(0, "OK")],
    "auth_user": [(10, 10, 1, "u10"), (11, 11, 1, "u11"), (1, 1, 1, "excluded"), (12, 12, 2, "u12")],
    "api_refund": [
        (1, "F", "X", T("1997-02-05"), T("1997-02-05")),
        (1, "O", "Y", T("1997-02-06"), T("1997-02-06")),
        (2, "F", "X", T("1990-02-06"), T("1990-02-06")),   # outside the source window
    ],
}

SCHEMA_OF = {**{n: n for n in SCHEMAS},
             "processor_current": "processor_history", "processor_previous": "processor_history",
             "processor_next": "processor_history"}


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("edge")
    dfs, con = write_reference_tables(spark, str(root), ROWS, SCHEMA_OF, SCHEMAS)
    src = sources_from(dfs, reference_branches(NEXT_FILE))
    return Audit(src, fixture_params()), con, oracle_queries(fixture_params(), with_fixtures=False)


@pytest.mark.parametrize("name", list(OUTPUTS))
def test_edge_rows_match_oracle(edge, name):
    audit, con, sql = edge
    df = audit.output(name)
    cols, expected = duck_digest(con, sql[name])
    assert sorted(df.columns) == cols
    assert spark_digest(df) == expected


def test_zero_rate_and_long_code_give_null_conversion(edge):
    """T5: a rate of 0.004 rounds to 0.00 → NULL, not an error. T4: a code
    longer than 5 characters is truncated in the rate table and no longer matches."""
    audit, _, _ = edge
    rows = {r.invoice_id: r for r in audit.invoice_totals.collect()}
    assert rows[100002].converted_invcharge is None and rows[100002].invcharge == D("50.00")
    # 100004: LONGCODE item unconverted; the GBP refund matches two rates
    # (5 and 8) and is counted twice, as the reference's join does — and
    # the invoice row itself is duplicated, doubling again.
    assert rows[100004].invcharge == D("20.00")
    assert rows[100004].invrefund == D("-20.00")
    assert rows[100004].converted_invrefund == D("-3.25")  # (-5/5 + -5/8) × 2 invoice rows


def test_leading_zeros_and_long_numbers_do_not_match(edge):
    """Invoice numbers compare as text; no cast error on 22 digits."""
    audit, _, _ = edge
    fwd = audit.recon_forward()
    r = fwd.where(F.col("invoice_id") == "00100001").first()
    assert r.inv_flag == 0
    assert fwd.where(F.col("invoice_id") == "1234567890123456789012").first().inv_flag == 0


def test_null_gross_wins_top_row(edge):
    """DESC puts NULL first, so invoice 100001's top processor row has NULL gross."""
    audit, _, _ = edge
    back = audit.recon_backward().where(F.col("invoice_id") == "100001").first()
    assert back.strp_flag == 1 and back.gross is None


def test_retry_rules_per_branch(edge):
    """K2/K3: bare 'retry' flags a fee row in the current branch but not in
    the next-period branch; the row survives the UNION twice (K1)."""
    audit, _, _ = edge
    rows = audit.processor_rows.where(F.col("balance_transaction_id") == "c_nf").collect()
    assert sorted(r.invoices_retry for r in rows) == [0, 1]
    fee = audit.processor_rows.where(F.col("balance_transaction_id") == "t9").first()
    assert fee.invoices_retry == 0


def test_rank_ties_kept(edge):
    audit, _, _ = edge
    top = audit.latest_override.where(F.col("object_owner_id") == 10).collect()
    assert sorted(r.company_name_override for r in top) == ["B", "C"]
    nul = audit.latest_override.where(F.col("object_owner_id") == 11).collect()
    assert [r.id for r in nul] == [None]


OPTIONS = {"strip_leading_zeros": True, "payment_check_on": None}


@pytest.mark.parametrize("option", list(OPTIONS))
@pytest.mark.parametrize("name", ["processor_rows", "payment_check", "recon_summary", "recon_report"])
def test_options_match_oracle(edge, option, name):
    """T2 and K12 as options, against the oracle with the same option."""
    audit, con, _ = edge
    p = audit.p.with_(**{option: OPTIONS[option]})
    cols, expected = duck_digest(con, oracle_queries(p, with_fixtures=False)[name])
    df = Audit(audit.src, p, reuse="none").output(name)
    assert sorted(df.columns) == cols
    assert spark_digest(df) == expected


def test_leading_zeros_match_when_stripped(edge):
    audit, _, _ = edge
    fwd = Audit(audit.src, audit.p.with_(strip_leading_zeros=True), reuse="none").recon_forward()
    assert fwd.where(F.col("invoice_id") == "00100001").count() == 0


def test_two_rates_for_a_day_are_reported(edge):
    audit, _, _ = edge
    assert [(r.fx_iso, r.rates) for r in audit.rate_conflicts.collect()] == [("GBP", 2)]
