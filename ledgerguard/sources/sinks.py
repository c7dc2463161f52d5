"""Sinks and cached reads (O-S6, O-S8, O-S10, O-S11).

All writes go to folders the caller names (in production: the shared
warehouse / checkpoint folder, never a machine-local temp directory).
"""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _gathered(df: DataFrame, partition_by: list[str]) -> DataFrame:
    """Rows gathered by the partition columns before they are written, so that a partition gets few files (a large one
    several, as Spark splits what exceeds its advisory size) instead of one from every task."""
    return df.hint("rebalance", *partition_by)


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """O-S6: append a query result to a parquet table (optionally partitioned, e.g. by flag_domain)."""
    if partition_by:
        _gathered(df, partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("append").parquet(path)


def backfill_table(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """O-S7 as a table: replaces the partitions that ``df`` has rows of, whole, and leaves every other file alone."""
    (_gathered(df, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def export_csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    """O-S8: CSV with a header line and no index column (flags export is capped at 500 rows)."""
    out = df.limit(limit) if limit else df
    out.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def export_json(results: DataFrame, path: str, summary: DataFrame | None = None) -> None:
    """O-S10: result rows as JSON lines, plus an optional summary next to them."""
    results.write.mode("overwrite").json(f"{path}/results")
    if summary is not None:
        summary.write.mode("overwrite").json(f"{path}/summary")


class CachedTable:
    """O-S11: a shared input kept in memory/disk for ``ttl_seconds``, then re-read on next use."""

    def __init__(self, loader, ttl_seconds: float = 240.0):
        self.loader = loader
        self.ttl = ttl_seconds
        self._df: DataFrame | None = None
        self._at = 0.0

    def get(self) -> DataFrame:
        now = time.monotonic()
        if self._df is None or now - self._at > self.ttl:
            self.invalidate()
            self._df = self.loader().persist(StorageLevel.MEMORY_AND_DISK)
            self._at = now
        return self._df

    def invalidate(self) -> None:
        if self._df is not None:
            self._df.unpersist()
            self._df = None
