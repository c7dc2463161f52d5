"""Operator 6, shards by minimax contiguous partition (built-in functions only).

Documents with equal texts form an atomic group; groups are ordered by their smallest doc_id (then by
text digest).  The smallest capacity is searched for which filling the shards one after another, each
with as many further groups as fit, takes all groups; the groups are cut there.  So no contiguous
partition into as many shards has a smaller largest shard.

Running sums come from a range partitioning with per-partition offsets.  A greedy fill asks, once per
shard, for the last running sum within reach; ``CANDIDATES`` capacities are filled at once, each step one
job over the stored sums that reads only the value ranges asked for.  To the driver come the bounds, one
number per value range (``RANGES`` of them) and one per candidate and step.

Defined cases: a null text counts as empty (size 1, crc32 of nothing) and is grouped with empty texts;
a text of any length only matters by its size; repeated rows each take a slot; null ids come first; an empty table gives an empty result; shards may stay
empty where there are fewer groups; one group larger than a fair share fills a shard alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerguard.llm.common import literal_rows, stored, texts

CANDIDATES, RANGES = 256, 4096


def numbered(df: DataFrame, *order) -> DataFrame:
    """The rows range-partitioned and sorted by ``order`` and stored with _pid (partition) and _pos
    (growing with the order inside a partition)."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                  .withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()))


def running_sums(groups: DataFrame, size: str, *order) -> DataFrame:
    """The groups with ``cum``, the sum of ``size`` up to and with each in the order."""
    rows = numbered(groups, *order)
    inside = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    # one row for each partition
    before = (rows.groupBy(F.col("_pid").alias("_p")).agg(F.sum(size).alias("_t"))
              .withColumn("_off", F.coalesce(F.sum("_t").over(
                  Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    return (rows.withColumn("_in", F.sum(size).over(inside)).join(F.broadcast(before), F.col("_pid") == F.col("_p"))
            .withColumn("cum", (F.col("_in") + F.col("_off")).cast("long")).drop("_pid", "_pos", "_p", "_t", "_off", "_in"))


def smallest_capacity(sums: DataFrame, size: str, shards: int) -> list[int]:
    """The cuts (running sums at the shards' ends) of the smallest capacity; ``sums`` has cum and size."""
    spark = sums.sparkSession
    total, most = sums.agg(F.max("cum"), F.max(size)).first()
    if total is None:
        return [0] * shards
    width = -(-(total + 1) // RANGES)
    ranged = sums.select("cum", F.floor(F.col("cum") / width).cast("int").alias("r"))
    last = [0] * (RANGES + 1)  # the largest sum before each range
    for r in ranged.groupBy("r").agg(F.max("cum").alias("m")).collect():
        last[r["r"] + 1] = r["m"]
    for i in range(1, RANGES + 1):
        last[i] = max(last[i], last[i - 1])

    def furthest(targets: list[int]) -> dict[int, int]:
        """The largest running sum up to each target."""
        asked = sorted({t for t in targets if t < total})
        found = {t: total for t in targets if t >= total}
        if asked:
            frame = literal_rows(spark, [{"t": t, "tr": t // width} for t in asked], "t: bigint, tr: int")
            part = ranged.filter(F.col("r").isin(sorted({t // width for t in asked})))
            got = {x["t"]: x["m"] for x in part.join(
                F.broadcast(frame), (F.col("r") == F.col("tr")) & (F.col("cum") <= F.col("t")))
                .groupBy("t").agg(F.max("cum").alias("m")).collect()}
            found |= {t: got.get(t, last[t // width]) for t in asked}
        return found

    def fill(capacities: list[int]) -> dict[int, list[int]]:
        cuts = {c: [] for c in capacities}
        for _ in range(shards):
            reach = {c: (k[-1] if k else 0) + c for c, k in cuts.items()}
            found = furthest(list(reach.values()))
            for c, k in cuts.items():
                k.append(found[reach[c]])
        return cuts

    low = max(-(-total // shards), most)
    high = max(low, -(-total // shards) + most)  # always enough
    while low < high:
        step = max(1, (high - low) // CANDIDATES)
        tried = fill(sorted({*range(low, high, step)}))
        fits = [c for c, k in tried.items() if k[-1] == total]
        misses = [c for c, k in tried.items() if k[-1] < total]
        high = min(fits, default=high)
        low = max((c + 1 for c in misses), default=low)
    return fill([low])[low]


def shard_by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    raw = F.encode("text", "UTF-8")
    base = stored(texts(docs).select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("digest")))
    groups = base.groupBy("digest").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    sums = stored(running_sums(groups, "bytes", F.col("first").asc_nulls_first(), F.col("digest")))
    cuts = smallest_capacity(sums, "bytes", shards)
    shard = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + F.when(F.col("cum") > cut, 1).otherwise(0)
    placed = base.join(sums.select(F.col("digest").alias("_d"), "cum", shard.cast("int").alias("shard")),
                       F.col("digest") == F.col("_d")).drop("_d", "digest")
    rows = numbered(placed, F.col("cum"), F.col("doc_id").asc_nulls_first())
    # rows of a shard are consecutive in each partition: one row for each partition and shard
    runs = (rows.groupBy(F.col("_pid").alias("_p"), F.col("shard").alias("_s"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
            .withColumn("_off", F.coalesce(F.sum("_n").over(
                Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    return (rows.join(F.broadcast(runs), (F.col("_pid") == F.col("_p")) & (F.col("shard") == F.col("_s")))
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("_off") + F.col("_pos") - F.col("_first")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
