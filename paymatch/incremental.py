"""Incremental refresh: partials per day that merge, and a manifest of the periods read.

A table laid out by day or month (:func:`paymatch.sources.layout.write_by_period`) is reduced to partial
sums per day. A refresh compares the files of every period with the manifest of the last one, recomputes the
periods whose files differ, and reads no others; an output is then merged from the partials of its window.
Partials are written once, under the number of their refresh, and the manifest that names them comes last, so a
refresh that is cut off changes nothing.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paymatch.audit import Audit
from paymatch.params import ReconParams, fixture_params
from paymatch.plans import invoices, payments
from paymatch.session import ensure_checkpoint_dir
from paymatch.sources import AuditSources, read_table
from paymatch.sources.fixtures import fixture_sources
from paymatch.sources.layout import PERIOD_COLUMNS, period_name, write_by_period

MANIFEST = "period date, digest long, refresh int"
PARTIALS = {"api_invoiceitem": invoices.item_partials, "billing_payment": payments.payment_partials}


class Partials:
    """Partials of one table under ``root``; ``build`` reduces rows of whole periods and keeps their partition column."""

    def __init__(self, spark: SparkSession, table: str, path: str, root: str,
                 grain: str = "day", build: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.table, self.path, self.root = spark, table, path, root.rstrip("/")
        self.period = period_name(PERIOD_COLUMNS[table], grain)
        self.build = build or PARTIALS[table]

    def source(self) -> DataFrame:
        return read_table(self.spark, self.path, self.table)

    def periods_now(self) -> dict[dt.date, int]:
        """A digest of the files of each period. Lists the files and opens none; one row a period reaches the driver."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.path)
        name = F.xxhash64("path", "length", "modificationTime")
        known = files.where(F.col(self.period).isNotNull()).groupBy(F.col(self.period).cast("date"))
        return {r[0]: r[1] for r in known.agg(F.bit_xor(name)).collect()}

    def _last(self) -> int:
        """Number of the last refresh that was completed; 0 if there is none."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/*/_SUCCESS")
        found = pattern.getFileSystem(conf).globStatus(pattern)
        return max([int(f.getPath().getParent().getName()) for f in found or []], default=0)

    def manifest(self) -> dict[dt.date, tuple[int, int]]:
        """Per period the digest of its files and the refresh that holds its partials."""
        last = self._last()
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{last}").collect() if last else []
        return {r.period: (r.digest, r.refresh) for r in rows}

    def changed(self, periods: list[dt.date]) -> DataFrame:
        """The partials of ``periods`` from the table; others are not read."""
        return self.build(self.source().where(F.col(self.period).isin(periods)))

    def refresh(self) -> list[dt.date]:
        """Recompute the partials of new and changed periods; returns these. Periods that are gone leave the manifest."""
        old, now, number = self.manifest(), self.periods_now(), self._last() + 1
        periods = sorted(d for d, digest in now.items() if old.get(d, (None,))[0] != digest)
        if not periods and len(old) == len(now):
            return []
        if periods:
            self.changed(periods).write.mode("overwrite").partitionBy(self.period).parquet(f"{self.root}/partials/refresh={number}")
        rows = [(d, digest, number if d in periods else old[d][1]) for d, digest in now.items()]
        (self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite")
         .parquet(f"{self.root}/manifest/{number}"))
        return periods

    def read(self) -> DataFrame:
        """The live partials of all periods."""
        live = sorted(f"{refresh}:{start}" for start, (_, refresh) in self.manifest().items())
        if not live:
            return self.changed([])
        partials = self.spark.read.parquet(f"{self.root}/partials")
        return partials.where(F.concat_ws(":", "refresh", self.period).isin(live)).drop("refresh")


def refreshed_audit(spark: SparkSession, src: AuditSources, params: ReconParams, tables: dict[str, str], root: str,
                    grain: str = "day", reuse: str = "cache") -> Audit:
    """An audit whose invoice totals (C3) and payments (C4, C5) come from refreshed partials below ``root``.

    ``tables``: path of the layout by ``grain`` of ``api_invoiceitem`` and ``billing_payment``, or of one of them.
    """
    def refreshed(table: str, path: str) -> DataFrame:
        store = Partials(spark, table, path, f"{root}/{table}", grain)
        store.refresh()
        return store.read()
    return Audit(src, params, reuse, _together(spark, refreshed, tables))


def _together(spark: SparkSession, step: Callable, tables: dict[str, object]) -> dict[str, object]:
    """``step(table, value)`` of every table. Tables do not wait for each other: cores that the last tasks of one leave idle serve another."""
    with ThreadPoolExecutor(max(1, len(tables))) as pool:
        # a target a table: each carries its own copy of the caller's job properties
        found = {table: pool.submit(inheritable_thread_target(spark)(step), table, value) for table, value in tables.items()}
        return {table: f.result() for table, f in found.items()}


def _two_increments(spark: SparkSession, sf_dir: str) -> Audit:
    """The fixture's items and payments arrive in two parts, with a refresh after each; the second part has months of the first."""
    src, params = fixture_sources(spark, sf_dir), fixture_params()
    root = f"{ensure_checkpoint_dir(spark)}/daily-{uuid.uuid4().hex}"
    frames = {"api_invoiceitem": src.invoice_item, "billing_payment": src.payment}
    paths = {table: f"{root}/tables/{table}" for table in frames}
    audit = None
    for late in (False, True):
        def arrive(table: str, df: DataFrame) -> None:
            second = (F.col(PERIOD_COLUMNS[table]) >= F.lit(params.query_end).cast("timestamp_ntz") - F.expr("interval 6 months")) & (
                F.col("invoice_id") % 3 != 0)
            write_by_period(df.where(second if late else ~second), paths[table], PERIOD_COLUMNS[table], "month")
        _together(spark, arrive, frames)
        audit = refreshed_audit(spark, src, params, paths, f"{root}/partials", "month", reuse="none")
    return audit


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered queries: outputs merged from the partials of two increments."""
    return {"invoice_totals_refreshed": lambda spark, sf_dir: _two_increments(spark, sf_dir).invoice_totals_by_owner,
            "payments_refreshed": lambda spark, sf_dir: _two_increments(spark, sf_dir).payments_other}


#: The output that each of these queries must equal.
SAME_AS = {"invoice_totals_refreshed": "invoice_totals_usd_by_owner", "payments_refreshed": "payments_other"}
