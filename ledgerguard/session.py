"""Spark session and lineage helpers.

Every operator in the library is a ``DataFrame -> DataFrame`` function; this
module only holds the session defaults a job should run with and the one
place that decides where lineage is cut.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_DEFAULT = "2024-01-31 00:00:00"


def get_spark(app: str = "ledgerguard", master: str | None = None,
              shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """Session with AQE, skew-join handling and UTC; no UI server."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # streaming state (dedup, per-account velocity) off the JVM heap, checkpointed as changelogs
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    )
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ts_lit(value: str = AS_OF_DEFAULT):
    """Time-zone-free timestamp literal (TIMESTAMP_NTZ), matching the parquet inputs."""
    return F.to_timestamp_ntz(F.lit(value))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``; the setting is only read.

    A session that names none gets a scratch folder of its own, but only where the driver and the
    executors are one process (``local[...]``, as in tests).  On a cluster a machine-local folder
    would lose data, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lg-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, sort_within: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing a parquet table into the shared checkpoint folder and reading it back.

    One job (an eager ``checkpoint()`` without a persist would compute the plan twice), the data
    survives executor loss, and readers get column pruning and filter pushdown on the snapshot.
    ``sort_within`` sorts each written file (no shuffle) so that the row groups cover narrow ranges
    of those columns and pushed-down filters on them skip row groups."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort_within) if sort_within else df).write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
