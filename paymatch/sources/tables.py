"""Source container and loaders.

``AuditSources`` binds each reference table name to a DataFrame. The
processor history comes as several export periods; ``ProcessorBranch``
describes how one period is tagged with invoice numbers (facts table,
lookup table, optional file-name filters, retry rules).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from paymatch.sources.schemas import PROCESSOR_EXPORT_CSV, SCHEMAS

# --- Fixed values: retry rules of the processor branches (reference text). ---
# (needle, categories) — the needle matches any category when categories is
# None. Branches over the current lookup use RETRY_RULES; the branch over the
# next-period lookup lacks "reattempt" and limits "retry" to charges.
RETRY_RULES = (("retry", None), ("reattempt", ("charge",)), ("-", ("charge", "refund")))
RETRY_RULES_NEXT = (("retry", ("charge",)), ("-", ("charge", "refund")))
# --- end of fixed values ---


@dataclass(frozen=True)
class ProcessorBranch:
    """One UNION branch of the processor rows: facts ⟕ lookup on description."""

    facts: str
    lookup: str
    fact_files: tuple[str, ...] | None = None
    lookup_files: tuple[str, ...] | None = None
    retry_rules: tuple = RETRY_RULES


def reference_branches(next_file: str, next_facts: str = "current") -> tuple[ProcessorBranch, ...]:
    """The reference's three branches.

    Branch 2 scans the *current* period with the next period's file name
    (quirk K1), so it is normally empty; pass ``next_facts='next'`` for the
    evidently intended form.
    """
    return (
        ProcessorBranch("current", "current"),
        ProcessorBranch(next_facts, "next", (next_file,), (next_file,), RETRY_RULES_NEXT),
        ProcessorBranch("previous", "current"),
    )


@dataclass
class AuditSources:
    user_override: DataFrame
    user_type: DataFrame
    invoice_item: DataFrame
    invoice: DataFrame
    currency: DataFrame
    fx_rates: DataFrame
    payment: DataFrame
    processor: dict[str, DataFrame]
    branches: tuple[ProcessorBranch, ...]
    address: DataFrame
    transaction: DataFrame
    rate: DataFrame
    track_status: DataFrame
    auth_user: DataFrame
    refund: DataFrame
    # Tables the reference reads without schema prefix (quirk K11); by
    # default the same snapshot as the schema-qualified ones.
    invoice_unqualified: DataFrame | None = None
    payment_unqualified: DataFrame | None = None

    @property
    def invoice_for_check(self) -> DataFrame:
        return self.invoice_unqualified if self.invoice_unqualified is not None else self.invoice

    @property
    def payment_for_check(self) -> DataFrame:
        return self.payment_unqualified if self.payment_unqualified is not None else self.payment

    def check_zone(self) -> None:
        """Refuse zoned timestamps in a session that is not on UTC: windows, rate
        days and month labels would all shift. (``read_table`` casts on reading.)"""
        spark = self.invoice.sparkSession
        zoned = [f"{name}.{c}" for name, df in self.as_dict().items() for c, t in df.dtypes if t == "timestamp"]
        if zoned and spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "+00:00"):
            raise ValueError(f"set spark.sql.session.timeZone to UTC; zoned timestamps in {', '.join(zoned)}")

    def with_(self, **kw) -> "AuditSources":
        return replace(self, **kw)

    def register_views(self) -> None:
        """Expose every source as a temp view for ``spark.sql`` users."""
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(name)

    def as_dict(self) -> dict[str, DataFrame]:
        out = {
            "user_useroverride": self.user_override, "user_usertype": self.user_type,
            "api_invoiceitem": self.invoice_item, "api_invoice": self.invoice,
            "api_currency": self.currency, "fx_rates": self.fx_rates,
            "billing_payment": self.payment, "api_apiaddress": self.address,
            "api_transaction": self.transaction, "api_rate": self.rate,
            "track_status": self.track_status, "auth_user": self.auth_user,
            "api_refund": self.refund,
        }
        for period, df in self.processor.items():
            out[f"processor_{period}"] = df
        return out


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the documented columns of table ``name`` typed, all other
    columns unchanged behind them (``SELECT *`` passes whole rows through, P2).

    A documented column that is missing is an error that names all of them.
    """
    schema = SCHEMAS[name]
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"table {name} lacks the columns {', '.join(missing)}")
    zoned = [f.name for f in schema.fields if df.schema[f.name].dataType == TimestampType()]
    if zoned and df.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError(f"set spark.sql.session.timeZone to UTC: {name} has zoned timestamps ({', '.join(zoned)})")
    known = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*known, *[c for c in df.columns if c not in schema.names])


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Parquet table, documented columns typed, others passed through."""
    return conform(spark.read.parquet(path), name)


def read_processor_exports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Processor CSV exports → one period table with a ``file_name`` column.

    The file name comes from the hidden ``_metadata`` column, so filters on
    it (S4) need no extra pass over the files.
    """
    df = (spark.read.schema(PROCESSOR_EXPORT_CSV).option("header", True)
          .option("mode", "FAILFAST").csv(paths))
    return df.withColumn("file_name", F.col("_metadata.file_name"))


def load_sources(spark: SparkSession, root: str, periods: dict[str, str],
                 branches: tuple[ProcessorBranch, ...], exports: dict[str, list[str]] | None = None,
                 unqualified_root: str | None = None) -> AuditSources:
    """Reference tables stored as ``<root>/<table>`` Parquet directories.

    ``periods``: processor periods by name, as Parquet folders below ``root``;
    ``exports``: periods read from CSV files (or globs) instead.
    ``unqualified_root``: folder of the second snapshot of ``api_invoice`` and
    ``billing_payment`` that the unqualified table names meant (K11); without
    it they are the same as the qualified ones.
    """
    def t(name: str, folder: str = root) -> DataFrame:
        return read_table(spark, f"{folder}/{name}", name)

    processor = {p: read_table(spark, f"{root}/{d}", "processor_history")
                 for p, d in periods.items()}
    processor |= {p: read_processor_exports(spark, paths) for p, paths in (exports or {}).items()}
    return AuditSources(
        user_override=t("user_useroverride"), user_type=t("user_usertype"),
        invoice_item=t("api_invoiceitem"), invoice=t("api_invoice"),
        currency=t("api_currency"), fx_rates=t("fx_rates"), payment=t("billing_payment"),
        processor=processor, branches=branches, address=t("api_apiaddress"),
        transaction=t("api_transaction"), rate=t("api_rate"),
        track_status=t("track_status"), auth_user=t("auth_user"), refund=t("api_refund"),
        invoice_unqualified=t("api_invoice", unqualified_root) if unqualified_root else None,
        payment_unqualified=t("billing_payment", unqualified_root) if unqualified_root else None,
    )


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
