"""An append-only registry that gives every key one number for good (flag ids of text transaction ids).

A hash of a key can fall on another key's; a registered number cannot.  New keys are sorted over the tasks, each task gets
the range of numbers that its count of keys needs (``ids.assign_sequential_ids``), and the pairs are appended.  Keys that
are there keep their number; registering the same keys again appends nothing.  One job registers at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerguard.operators.ids import assign_sequential_ids

SCHEMA = "key string, id long"


class KeyRegistry:
    def __init__(self, spark: SparkSession, path: str, base: int):
        """``base``: the number before the first one."""
        self.spark, self.path, self.base = spark, path, base

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def pairs(self) -> DataFrame:
        """key, id of every registered key."""
        return self.spark.read.schema(SCHEMA).parquet(self.path) if self._exists() else self.spark.createDataFrame([], SCHEMA)

    def register(self, keys: DataFrame) -> DataFrame:
        """Registers the keys (a column ``key``; null is none) that are new, and returns ``pairs``."""
        have = self.pairs()
        last = have.agg(F.coalesce(F.max("id"), F.lit(self.base)).alias("_lg_base"))
        new = keys.select(F.col("key").cast("string").alias("key")).filter("key IS NOT NULL").distinct().join(have, "key", "left_anti")
        numbered = assign_sequential_ids(new, "key", last, "id")
        numbered.select("key", "id").write.mode("append").parquet(self.path)
        return self.pairs()
