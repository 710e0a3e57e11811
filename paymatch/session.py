"""Session settings and lineage cuts.

The audit is a batch of joins and aggregations; what matters at scale is
AQE (coalescing small shuffle partitions, splitting skewed ones at run
time) and zone-less timestamps. ``materialize`` cuts lineage into the
cluster's shared checkpoint folder so a lost executor never forces a
recomputation from the raw sources.
"""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when that costs an extra shuffle
    # downstream: a shuffle is cheaper than one straggler holding a hot key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app: str = "paymatch", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's session."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(SESSION_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_settings(spark: SparkSession) -> None:
    """Set what results and plans depend on (UTC, ANSI, AQE) on a session that others made."""
    for key, value in SESSION_CONF.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the context checkpoints to: one already set, else the
    cluster's ``spark.checkpoint.dir``, else (tests) a scratch folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    d = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="paymatch-ckpt-")
    sc.setCheckpointDir(d)
    return d


def persist_coalesced(df: DataFrame, level: StorageLevel) -> DataFrame:
    """``df.persist(level)``, kept in as many partitions as its bytes ask for.

    Spark keeps a cached result in ``spark.sql.shuffle.partitions`` pieces however small
    they are, unless this setting allows adaptive execution to merge them; each
    reader's shuffle then writes a file per piece and target partition, so its cost
    grows with the square of the setting. The plan to keep is fixed by ``persist``, so the setting is put back.
    """
    conf, name = df.sparkSession.conf, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return df.persist(level)
    finally:
        conf.set(name, before)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never ``localCheckpoint``): the data lands in the
    shared checkpoint folder and survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
