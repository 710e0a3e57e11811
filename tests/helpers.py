"""Shared test helpers: value digests and DuckDB oracle runs."""

from __future__ import annotations

import decimal
import hashlib
import os

import duckdb

GIVEN_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def digest(cols, rows) -> tuple[int, str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return len(rows), hashlib.sha1("\n".join(lines).encode()).hexdigest()


def spark_digest(df):
    return digest(df.columns, [tuple(r) for r in df.collect()])


def duck_given(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in GIVEN_TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def duck_digest(con, sql: str):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return sorted(cols), digest(cols, cur.fetchall())


def write_reference_tables(spark, root, rows: dict, schema_of: dict, schemas: dict):
    """Write hand-made reference tables as Parquet; return Spark DataFrames and a
    DuckDB connection with a view per table over the same files."""
    dfs = {}
    con = duckdb.connect()
    for name, data in rows.items():
        path = f"{root}/{name}"
        spark.createDataFrame(data, schemas[schema_of[name]]).coalesce(1).write.parquet(path)
        dfs[name] = spark.read.parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return dfs, con


def sources_from(dfs: dict, branches):
    from paymatch.sources import AuditSources
    return AuditSources(
        user_override=dfs["user_useroverride"], user_type=dfs["user_usertype"],
        invoice_item=dfs["api_invoiceitem"], invoice=dfs["api_invoice"],
        currency=dfs["api_currency"], fx_rates=dfs["fx_rates"], payment=dfs["billing_payment"],
        processor={"previous": dfs["processor_previous"], "current": dfs["processor_current"],
                   "next": dfs["processor_next"]},
        branches=branches,
        address=dfs["api_apiaddress"], transaction=dfs["api_transaction"], rate=dfs["api_rate"],
        track_status=dfs["track_status"], auth_user=dfs["auth_user"], refund=dfs["api_refund"],
    )
