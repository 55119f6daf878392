"""Session defaults and the one shared working folder.

Lineage is cut only with tables written below the folder that ``spark.checkpoint.dir`` names, or with reliable
``checkpoint()``, so a lost executor never takes intermediate state with it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a hot join key even when a later aggregate must then shuffle once more.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    # Column expressions are built by the thousand; recording the Python call site of each costs more than building it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "marketloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the defaults above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where there is no cluster (local master)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_root(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df):
    """Materialise an expensive table that several branches of a plan read.

    Written once as Parquet in the shared folder: branches read only the columns they use, the planner knows the size, and
    no branch depends on an executor that may be lost. (``checkpoint()`` would compute the last stage twice and store whole rows.)
    """
    path = fresh_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
