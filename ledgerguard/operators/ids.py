"""Consecutive ids without a single-partition window.

``row_number() over (order by k)`` with no partition runs in one task.  Here
the rows are range-partitioned by ``k`` and sorted inside each partition;
``monotonically_increasing_id`` then encodes (partition, position).  A
per-partition count table (one row per partition, so its size is bounded by
the partition count and safe to broadcast) gives each partition its offset.
Ids follow ``k`` order and are consecutive after ``base``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerguard.session import cut_lineage


def next_id(table: DataFrame, id_col: str) -> DataFrame:
    """O-A14: one-row frame ``_lg_base = COALESCE(MAX(id), 0)`` of an existing table."""
    return table.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint").alias("_lg_base"))


def assign_sequential_ids(df: DataFrame, order_col: str, base: DataFrame | int, out_col: str,
                          num_partitions: int | None = None) -> DataFrame:
    n = num_partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    mid = F.col("_lg_mid")
    # materialize (partition, position) once: the count branch and the numbering branch must
    # see the very same partitioning, whatever AQE would do on a re-evaluation
    parted = cut_lineage(df.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
                         .withColumn("_lg_mid", F.monotonically_increasing_id())
                         .withColumn("_lg_pid", F.shiftright(mid, 33))
                         .withColumn("_lg_rn", mid - F.shiftleft(F.shiftright(mid, 33), 33) + 1))
    counts = parted.groupBy("_lg_pid").agg(F.count(F.lit(1)).alias("_lg_n"))
    offsets = counts.withColumn(
        "_lg_off",
        F.coalesce(F.sum("_lg_n").over(Window.orderBy("_lg_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)))
    if isinstance(base, int):
        offsets = offsets.withColumn("_lg_base", F.lit(base).cast("bigint"))
    else:  # the one-row base is a scalar subquery
        offsets = offsets.withColumn("_lg_base", base.select("_lg_base").scalar())
    return (parted.join(F.broadcast(offsets.select("_lg_pid", "_lg_off", "_lg_base")), "_lg_pid")
                  .withColumn(out_col, (F.col("_lg_base") + F.col("_lg_off") + F.col("_lg_rn")).cast("bigint"))
                  .drop("_lg_pid", "_lg_rn", "_lg_off", "_lg_mid", "_lg_base"))
