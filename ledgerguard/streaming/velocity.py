"""O-ST4: exact velocity on a stream, with state keyed by (bucket of accounts, granule).

A stream cannot count the transactions in ``[t - W, t]`` when a row arrives: rows up to the watermark's delay older may
still come.  So a row waits until the watermark has passed its granule (a piece of W / ``granules``), and is then
counted once, exactly, over every row that was not dropped as late.

A window reaches over the row's own granule, part of the granule W before it, and all granules between.  Each row
is therefore sent to its own granule, to the one W later (as an edge), and as part of a count to those between;
the counts are summed per (account, granule) in the sending task.  A key of the state holds the rows of two granules of
one bucket of accounts, however many an account has in a window or a batch, and an event-time timer at the granule's
end counts, emits and clears it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerguard.functions import constants as K
from ledgerguard.operators.timewin import duration_micros

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the library
OWN, EDGE, BETWEEN = 0, 1, 2
SENT = pa.schema([("account_id", pa.string()), ("granule", pa.int64()), ("kind", pa.int32()), ("txn_id", pa.string()),
                  ("t", pa.int64()), ("n", pa.int64())])
SENT_DDL = "account_id string, granule long, kind int, txn_id string, t long, n long"
STATE = pa.schema([SENT.field(x) for x in ("account_id", "kind", "txn_id", "t", "n")])
OUT_DDL = "account_id string, txn_id string, t long, velocity_count long"
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
BUCKETS = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, which timers and list
    state need; the caller's own session is left as it is."""
    s = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        s.conf.set(key, spark.conf.get(key))
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return s


def granule_micros(window: str, granules: int) -> int:
    return -(-duration_micros(window) // granules)


def _sent(window: int, width: int):
    """Arrow batches of (account_id, txn_id, t) -> the rows and counts for each granule they matter to."""
    def run(batches):
        for batch in batches:
            account, ids = batch.column("account_id"), batch.column("txn_id")
            t = batch.column("t").to_numpy(zero_copy_only=False).astype("int64")
            own, edge = t // width, (t + window) // width
            one, none = np.ones(len(t), "int64"), pa.nulls(len(t), pa.string())
            for kind, granule, sent_ids in ((OWN, own, ids), (EDGE, edge, none)):
                yield pa.RecordBatch.from_arrays(
                    [account, pa.array(granule), pa.array(np.full(len(t), kind, "int32")), sent_ids, pa.array(t), pa.array(one)], schema=SENT)
            groups = (pa.table({"account_id": account, "own": own, "edge": edge}).group_by(["account_id", "own", "edge"])
                      .aggregate([([], "count_all")]))
            first, last = groups.column("own").to_numpy() + 1, groups.column("edge").to_numpy()
            times = last - first
            if not times.sum():
                continue
            at = np.repeat(np.arange(len(times)), times)
            granule = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            sums = (pa.table({"account_id": groups.column("account_id").combine_chunks().take(pa.array(at)), "granule": granule,
                              "n": groups.column("count_all").combine_chunks().take(pa.array(at))})
                    .group_by(["account_id", "granule"]).aggregate([("n", "sum")]).combine_chunks())
            size = sums.num_rows
            yield pa.RecordBatch.from_arrays(
                [sums.column("account_id").combine_chunks(), sums.column("granule").combine_chunks(), pa.array(np.full(size, BETWEEN, "int32")),
                 pa.nulls(size, pa.string()), pa.array(np.zeros(size, "int64")), sums.column("n_sum").combine_chunks()], schema=SENT)
    return run


class _Granule(StatefulProcessor):
    """The state of one granule and the accounts of one bucket: their rows, the edges W before, the counts between, as
    they came.  What one call brings is stored as one value, so that calls of the state store grow with the keys and
    the deliveries, not with the rows or the accounts."""

    def __init__(self, window: int, width: int):
        self.window, self.width = window, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getListState("sent", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        end = (key[1] + 1) * self.width
        if end <= watermark:
            return iter(())  # late rows: the granule has been counted; a batch reconcile finds them
        known = False
        for batch in rows:
            known = True
            batch = batch[(batch["kind"] == BETWEEN) | (batch["t"] >= watermark)]
            if len(batch):
                table = pa.Table.from_pandas(batch, schema=STATE, preserve_index=False)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, STATE) as out:
                    out.write_table(table)
                self.sent.appendValue((sink.getvalue().to_pybytes(),))
        if known:
            self.handle.registerTimer(-(-end // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [pa.ipc.open_stream(bytes(r[0])).read_all() for r in self.sent.get()]
        if parts:
            yield from self.counted(pa.concat_tables(parts), key[1] * self.width)
        self.sent.clear()

    def counted(self, sent: pa.Table, start: int) -> Iterator[pd.DataFrame]:
        """The counts of the granule's own rows; every time of an account becomes its place in one line of accounts."""
        code = sent.column("account_id").combine_chunks().dictionary_encode()
        code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy().astype("int64")
        kind, t, n = (sent.column(x).to_numpy() for x in ("kind", "t", "n"))
        own, edge, between = kind == OWN, kind == EDGE, kind == BETWEEN
        if not own.any():
            return
        first = code[own] * self.width          # an account's part of the line
        at = first + t[own] - start
        rows, edges = np.sort(at), np.sort(code[edge] * self.width + t[edge] + self.window - start)
        before = np.zeros(int(code.max()) + 1, "int64")
        np.add.at(before, code[between], n[between])
        count = (before[code[own]] + np.searchsorted(edges, first + self.width, side="left") - np.searchsorted(edges, at, side="left")
                 + np.searchsorted(rows, at, side="right") - np.searchsorted(rows, first, side="left"))
        yield (sent.select(["account_id", "txn_id", "t"]).filter(pa.array(own))
               .append_column("velocity_count", pa.array(count.astype("int64"))).to_pandas())

    def close(self) -> None:
        pass


def streaming_velocity(txns: DataFrame, window: str = K.VELOCITY_WINDOW, granules: int = 4, account_col: str = "account_id",
                       id_col: str = "txn_id", ts_col: str = "txn_ts", buckets: int = BUCKETS) -> DataFrame:
    """account_id, txn_id, txn_ts, velocity_count of a stream with a watermark: each row once, when the watermark
    has passed its granule, with the count of the account's rows in [t - window, t].

    Rows older than the watermark are dropped from every count.  A null account is an account of its own; rows without
    a time take no part.  ``granules`` pieces of the window keep a busy account's keys small; the accounts of one of
    ``buckets`` share a key, and a checkpoint is bound to both numbers."""
    w, width = duration_micros(window), granule_micros(window, granules)
    narrow = txns.filter(F.col(ts_col).isNotNull()).select(
        # null keys would not stay together in Python: a null account is the empty text
        F.coalesce(F.col(account_col).cast("string"), F.lit("")).alias("account_id"), F.col(id_col).cast("string").alias("txn_id"),
        F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{ts_col}`)").alias("t"))
    sent = narrow.mapInArrow(_sent(w, width), SENT_DDL).withColumn("bucket", F.pmod(F.xxhash64("account_id"), F.lit(buckets)))
    counted = (sent.groupBy("bucket", "granule")
               .transformWithStateInPandas(_Granule(w, width), OUT_DDL, "Append", "EventTime"))
    account = F.when(F.col("account_id") != "", F.col("account_id").cast(txns.schema[account_col].dataType)).alias("account_id")
    return counted.select(account, "txn_id", F.expr(f"timestampadd(MICROSECOND, t, {EPOCH})").alias("txn_ts"), "velocity_count")


def run_velocity(spark: SparkSession, source: str, window: str = K.VELOCITY_WINDOW, delay: str = "30 minutes", granules: int = 4,
                 sink: str | None = None, checkpoint: str | None = None) -> str:
    """Counts everything available now into the sink (a folder of Parquet) and returns it; with the same sink and
    checkpoint a later run goes on where this one ended."""
    from ledgerguard.streaming.refresh import scratch_path, transactions_stream
    sink, checkpoint = sink or scratch_path(spark, "velocity"), checkpoint or scratch_path(spark, "ckpt-velocity")
    txns = transactions_stream(stateful_session(spark), source)
    txns = txns.withColumn("event_time", F.col("txn_ts").cast("timestamp")).withWatermark("event_time", delay)
    q = (streaming_velocity(txns, window, granules).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return sink
