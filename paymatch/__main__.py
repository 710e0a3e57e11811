"""Batch run: ``python -m paymatch --root DIR --out DIR [options]``.

Reads the reference tables from ``--root`` (one Parquet folder per table,
processor periods as named by ``--period``, or CSV exports as named by
``--export``), runs every output and writes each to ``--out/<name>``. On a cluster, submit with ``spark-submit -m paymatch``
semantics (the session comes from the cluster); ``--reuse checkpoint`` keeps
shared intermediates in the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
from decimal import Decimal

from pyspark.sql import SparkSession

from paymatch.audit import OUTPUTS, Audit
from paymatch.params import ReconParams
from paymatch.session import apply_settings
from paymatch.sinks import publish_outputs, write_outputs
from paymatch.sources import load_sources, reference_branches


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="paymatch")
    ap.add_argument("--root", required=True, help="folder of reference tables (Parquet)")
    ap.add_argument("--out", required=True, help="output folder")
    ap.add_argument("--period", action="append", default=[],
                    help="processor period as name=folder (previous, current, next)")
    ap.add_argument("--export", action="append", default=[],
                    help="processor period from CSV exports as name=path (repeatable, globs allowed)")
    ap.add_argument("--next-file", required=True, help="file name the next-period branch keeps")
    ap.add_argument("--next-facts", default="current", help="period that the next-file branch scans (K1)")
    ap.add_argument("--unqualified-root", help="folder of the second api_invoice and billing_payment snapshot (K11)")
    ap.add_argument("--query-start", default=ReconParams.query_start)
    ap.add_argument("--query-end", default=ReconParams.query_end)
    ap.add_argument("--source-start", default=ReconParams.source_start)
    ap.add_argument("--source-end", default=ReconParams.source_end)
    ap.add_argument("--provider-id", type=int, default=ReconParams.provider_id,
                    help="label fact provider filter (negative: no filter)")
    ap.add_argument("--excluded-user", type=int, action="append",
                    help="label fact excluded user id (repeatable)")
    ap.add_argument("--special-method", type=int, default=ReconParams.special_method)
    ap.add_argument("--first-item-cutoff", default=ReconParams.first_item_cutoff)
    ap.add_argument("--billing-floor", help="earliest payment creation in the late-update drill-down")
    ap.add_argument("--late-update-invoice", type=int, help="only this invoice in the late-update drill-down")
    ap.add_argument("--on-zero-rate", default=ReconParams.on_zero_rate, choices=["null", "error"])
    ap.add_argument("--payment-check-on", default=ReconParams.payment_check_on,
                    choices=["id", "invoice_id", "none"])
    ap.add_argument("--fuzzy-min-days", type=int, default=ReconParams.fuzzy_min_days)
    ap.add_argument("--fuzzy-max-months", type=int, default=ReconParams.fuzzy_max_months)
    ap.add_argument("--fuzzy-tolerance", type=Decimal, default=ReconParams.fuzzy_tolerance,
                    help="difference of amounts that a fuzzy match lets pass")
    ap.add_argument("--strip-leading-zeros", action="store_true", help="compare invoice numbers without leading zeros")
    ap.add_argument("--reuse", default="checkpoint", choices=["cache", "checkpoint", "none"])
    ap.add_argument("--only", action="append", choices=list(OUTPUTS), help="outputs to write")
    ap.add_argument("--publish", action="store_true",
                    help="replace --out as a whole, and only if the control totals of the outputs agree")
    a = ap.parse_args(argv)

    spark = SparkSession.builder.appName("paymatch").getOrCreate()
    apply_settings(spark)
    periods = dict(p.split("=", 1) for p in a.period)
    exports: dict[str, list[str]] = {}
    for name, path in (e.split("=", 1) for e in a.export):
        exports.setdefault(name, []).append(path)
    src = load_sources(spark, a.root, periods, reference_branches(a.next_file, a.next_facts), exports,
                       a.unqualified_root)
    params = ReconParams(query_start=a.query_start, query_end=a.query_end,
                         source_start=a.source_start, source_end=a.source_end,
                         special_method=a.special_method, first_item_cutoff=a.first_item_cutoff,
                         billing_floor=a.billing_floor, late_update_invoice=a.late_update_invoice,
                         on_zero_rate=a.on_zero_rate, strip_leading_zeros=a.strip_leading_zeros,
                         payment_check_on=None if a.payment_check_on == "none" else a.payment_check_on,
                         fuzzy_min_days=a.fuzzy_min_days, fuzzy_max_months=a.fuzzy_max_months,
                         fuzzy_tolerance=a.fuzzy_tolerance,
                         provider_id=None if a.provider_id < 0 else a.provider_id,
                         excluded_users=tuple(a.excluded_user) if a.excluded_user
                         else ReconParams.excluded_users)
    with Audit(src, params, reuse=a.reuse) as audit:
        if a.publish:
            for name, totals in publish_outputs(audit, a.out, a.only).items():
                print(f"{name}\t{a.out.rstrip('/')}/{name}\t{totals['rows']} rows")
            return
        for name, path in write_outputs(audit, a.out, a.only).items():
            print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
