"""The reconciliation's sides kept as bucketed tables.

Both directions, at both grains, join the same lookups by invoice number. Here
every side is written once, bucketed and sorted by (invoice number, part), and
all four joins read the buckets as they lie: no exchange, however often a
direction is run again.

Adaptive execution cannot split a bucket at run time, so busy numbers are
split while the tables are written. A number with more than ``rows_per_part``
rows on a driving side gets as many parts as its rows need; its driving rows
are dealt to them by a hash of their other keys and its lookup rows are
repeated in each. Repeats are fewer than the driving rows over
``rows_per_part`` for each lookup row, and numbers that are not busy have none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paymatch.audit import Audit
from paymatch.operators import skew_join
from paymatch.params import fixture_params
from paymatch.plans import reconcile
from paymatch.session import ensure_checkpoint_dir
from paymatch.sources.fixtures import fixture_sources

#: Driving rows of one invoice number that may share a bucket.
ROWS_PER_PART = 1_000_000
ON = ["_key", "_part"]


def _with_parts(df: DataFrame, parts: DataFrame, part: Callable[[Column], Column]) -> DataFrame:
    joined = skew_join(df, parts, "_key", "_busy", "left")
    return joined.withColumn("_part", part(F.coalesce("_parts", F.lit(1).cast("long")))).drop("_busy", "_parts")


def deal(df: DataFrame, parts: DataFrame) -> DataFrame:
    """Driving rows, each in one ``_part`` of its ``_key``, by a hash of the columns that are no measures."""
    spread = F.xxhash64(*[c for c in df.columns if not c.startswith("_")])
    return _with_parts(df, parts, lambda n: F.pmod(spread, n))


def repeat(df: DataFrame, parts: DataFrame) -> DataFrame:
    """Lookup rows, once in every ``_part`` of their ``_key``."""
    return _with_parts(df, parts, lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))


class BucketedStar:
    """Bucketed sides of the reconciliation of ``audit``, below the shared checkpoint folder.

    ``buckets``: per table, ``spark.sql.shuffle.partitions`` if not given; a
    bucket is read by one task, so they should hold some 128 MB of the largest side.
    The tables belong to the session's catalog; ``close()`` drops them and their files.
    """

    def __init__(self, audit: Audit, buckets: int | None = None, rows_per_part: int = ROWS_PER_PART,
                 grains: tuple[bool, ...] = (False, True)):
        self.p = audit.p
        inputs = {by_owner: audit.inputs(by_owner) for by_owner in grains}
        first = inputs[grains[0]]
        self.spark: SparkSession = first.processor.sparkSession
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"paymatch_{uuid.uuid4().hex}"
        self.root = f"{ensure_checkpoint_dir(self.spark)}/{self.name}"
        self.tables: list[str] = []
        driving = {"processor": (reconcile.processor_side(first), reconcile.processor_key())}
        for by_owner, inp in inputs.items():
            driving[f"month_{by_owner}"] = (reconcile.month_side(inp, by_owner), F.col("_k"))
        driving = {name: df.withColumn("_key", key.cast("string")) for name, (df, key) in driving.items()}
        # written once, so not kept as well (if the audit has kept them already, Spark reads them from there)
        lookups = {"profile": reconcile.invoice_profile(first, self.p), "top": reconcile.top_processor(first.processor)}
        lookups |= {f"invoice_{by_owner}": reconcile.invoice_side(inp, by_owner) for by_owner, inp in inputs.items()}
        parts = self._parts(list(driving.values()), rows_per_part)
        self.sides: dict[str, DataFrame] = {}
        for name, df in driving.items():
            self.sides[name] = self._save(deal(df, parts), name)
        for name, df in lookups.items():
            keyed = df.withColumn("_key", F.col("_k").cast("string")).drop("_k")
            self.sides[name] = self._save(repeat(keyed, parts), name)

    def _parts(self, driving: list[DataFrame], rows_per_part: int) -> DataFrame:
        """Invoice numbers that are busy on a driving side, with their number of parts."""
        counts = [df.groupBy(F.col("_key").alias("_busy")).count().where(F.col("count") > rows_per_part) for df in driving]
        busy = counts[0]
        for more in counts[1:]:
            busy = busy.unionByName(more)
        busy = busy.groupBy("_busy").agg(F.ceil(F.max("count") / rows_per_part).cast("long").alias("_parts"))
        return self._save(busy, "parts", bucketed=False)

    def _save(self, df: DataFrame, name: str, bucketed: bool = True) -> DataFrame:
        table = f"{self.name}_{name.lower()}"
        self.tables.append(table)
        if bucketed:
            # dealt as the buckets are: one file a bucket
            df = df.repartition(self.buckets, *ON).sortWithinPartitions(*ON)
        out = df.write.format("parquet").option("path", f"{self.root}/{name}")
        (out.bucketBy(self.buckets, *ON).sortBy(*ON) if bucketed else out).saveAsTable(table)
        return self.spark.table(table)

    def _joined(self, driving: str, other: str) -> DataFrame:
        out = self.sides[driving].join(self.sides["profile"], ON, "left").join(self.sides[other], ON, "left")
        return reconcile.per_check_row(out.drop(*ON))

    def forward(self, by_owner: bool = False) -> DataFrame:
        """C9a from the buckets."""
        return reconcile.forward_rows(self._joined("processor", f"invoice_{by_owner}"), self.p, by_owner)

    def backward(self, by_owner: bool = False) -> DataFrame:
        """C9b from the buckets."""
        return reconcile.backward_rows(self._joined(f"month_{by_owner}", "top"), self.p, by_owner)

    def summary(self, by_owner: bool = False) -> DataFrame:
        """C9 from the buckets."""
        return self.forward(by_owner).unionByName(self.backward(by_owner))

    def close(self) -> None:
        """Drop the tables and delete their files; nothing may read them any more."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _star(spark: SparkSession, sf_dir: str, by_owner: bool) -> BucketedStar:
    with Audit(fixture_sources(spark, sf_dir), fixture_params()) as audit:
        return BucketedStar(audit, grains=(by_owner,))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered queries: both directions from bucketed sides, at both grains."""
    return {"recon_summary_bucketed": lambda spark, sf_dir: _star(spark, sf_dir, False).summary(),
            "recon_owner_bucketed": lambda spark, sf_dir: _star(spark, sf_dir, True).summary(by_owner=True)}


#: The output that each of these queries must equal.
SAME_AS = {"recon_summary_bucketed": "recon_summary", "recon_owner_bucketed": "recon_summary_by_owner"}
