"""Sinks: write outputs as Parquet, or expose them as temp views.

The reference materialises each step as a session temp table and returns
the report as a result set. Here each output is a DataFrame; a run either
writes them (one folder per output) or registers them as temp views under
the reference's temp-table names, so SQL written against those names runs
unchanged on ``spark.sql``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from paymatch.audit import OUTPUTS, Audit
from paymatch.plans.reconcile import MEASURES

# --- Fixed values: the reference's temp-table names for the matching outputs. ---
REFERENCE_VIEW_NAMES = {
    "latest_override": "useroverride_detail",
    "invoice_totals_usd": "Prod_Invoiceitem",
    "payments_other": "Billing_payment_info",
    "payments_method3": "Billing_payment_Braintree",
    "processor_rows": "Stripe_data",
    "invoice_check": "Invoice_check",
    "payment_check": "Billing_check",
    "recon_summary": "Stripe_Summary",
    "default_address": "default_address",
    "label_detail": "transaction_detail",
}
# --- end of fixed values ---


#: Pairs of outputs whose columns must add up to the same totals.
CONTROLS = (
    ("recon_summary", "recon_report", tuple(MEASURES)),
    ("recon_summary_by_owner", "recon_report_owner_grain", tuple(MEASURES)),
    ("invoice_totals_usd", "invoice_totals_usd_by_owner", ("invcharge", "invrefund")),
)


class ControlTotalsError(ValueError):
    """Totals that do not agree; nothing was published."""


def write_outputs(audit: Audit, root: str, names: Iterable[str] | None = None,
                  mode: str = "overwrite") -> dict[str, str]:
    """Write each output to ``<root>/<name>`` as Parquet; returns the paths.

    Outputs are written one after another; the audit's shared intermediates
    are computed once (``Audit(reuse=...)``) and reused by later outputs.
    """
    paths = {}
    for name in names or OUTPUTS:
        path = f"{root.rstrip('/')}/{name}"
        audit.output(name).write.mode(mode).parquet(path)
        paths[name] = path
    return paths


def register_views(audit: Audit, reference_names: bool = True) -> dict[str, DataFrame]:
    """Register every output as a temp view (by its name, and by the
    reference's temp-table name where there is one)."""
    views = {}
    for name in OUTPUTS:
        df = audit.output(name)
        df.createOrReplaceTempView(name)
        views[name] = df
        if reference_names and name in REFERENCE_VIEW_NAMES:
            df.createOrReplaceTempView(REFERENCE_VIEW_NAMES[name])
            views[REFERENCE_VIEW_NAMES[name]] = df
    return views


def observed_write(df: DataFrame, path: str) -> dict[str, Decimal | int | None]:
    """Write ``df`` as Parquet; returns its row count (``rows``) and the sum of each decimal column.

    The totals are observed while the rows are written (``DataFrame.observe``): no second pass.
    """
    seen = Observation()
    sums = [F.sum(F.col(f.name).cast(DecimalType(38, f.dataType.scale))).alias(f.name)
            for f in df.schema.fields if isinstance(f.dataType, DecimalType) and f.name != "rows"]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *sums).write.parquet(path)
    return seen.get


def publish_outputs(audit: Audit, root: str, names: Iterable[str] | None = None,
                    expected: dict[str, dict[str, Decimal | int]] | None = None) -> dict[str, dict]:
    """Write outputs to a staging folder beside ``root`` and put it in the place of ``root`` if all totals agree.

    Totals must agree between the outputs of :data:`CONTROLS` that are written, and with
    ``expected`` (per output ``rows`` or sums of columns, as the control totals of an export state them).
    Otherwise a :class:`ControlTotalsError` names every difference, the staging folder goes and ``root`` stays
    as it was. Publication is two renames: readers find the old set, for a moment none, or the new set, and never a mix.
    Returns the totals of each output.
    """
    root = root.rstrip("/")
    spark = audit.src.invoice.sparkSession
    run = uuid.uuid4().hex
    staging, before = f"{root}-staging-{run}", f"{root}-before-{run}"
    try:
        totals = {name: observed_write(audit.output(name), f"{staging}/{name}") for name in names or OUTPUTS}
        wrong = [f"{one}.{c} = {totals[one][c]}, {other}.{c} = {totals[other][c]}"
                 for one, other, columns in CONTROLS if one in totals and other in totals
                 for c in columns if totals[one][c] != totals[other][c]]
        wrong += [f"{name}.{c} = {totals.get(name, {}).get(c)}, expected {value}"
                  for name, stated in (expected or {}).items() for c, value in stated.items()
                  if totals.get(name, {}).get(c) != value]
        if wrong:
            raise ControlTotalsError("; ".join(wrong))
    except BaseException:
        _delete(spark, staging)
        raise
    replaced = _exists(spark, root)
    if replaced:
        _rename(spark, root, before)
    _rename(spark, staging, root)
    if replaced:
        _delete(spark, before)
    return totals


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _file_system(spark, folder)
    return fs.exists(path)


def _rename(spark: SparkSession, folder: str, target: str) -> None:
    fs, path = _file_system(spark, folder)
    if not fs.rename(path, _file_system(spark, target)[1]):
        raise OSError(f"{folder} could not be renamed to {target}")


def _delete(spark: SparkSession, folder: str) -> None:
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)
