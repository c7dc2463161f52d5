"""Incremental flag refresh with Structured Streaming (O-ST1..O-ST7).

* O-ST1: ``readStream`` of raw transaction files -> bank view projection ->
  watermark + ``dropDuplicatesWithinWatermark(txn_id)`` -> ``foreachBatch``:
  exact velocity (below), row rules, flag build (static join to accounts),
  anti-join against the flags already in the sink (O-ST2), append.  Re-running
  an epoch after a failure appends nothing twice.
* Velocity in the refresh job: each micro-batch is counted with the batch range
  window (``timewin``, hot accounts split into granules) over the batch plus the
  stream's own history of the last window (narrow rows, partitioned by date,
  read with partition pruning, appended idempotently).  No per-account state, so
  a hot account never sits in one task or one state value.
* O-ST3: rows older than the watermark are dropped by the stream; the batch
  reconcile :func:`find_missed_flags` finds flagged transactions that have no flag.
* O-ST4 as a streaming operator, exact also for rows that come late within the watermark:
  ``streaming/velocity.py``.
* O-ST5 / O-ST6: windowed aggregations written once and run either on a
  stream or on a batch DataFrame (same code).

Checkpoints and sinks live under the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerguard.functions import constants as K
from ledgerguard.operators.fraud import (_pick_score, default_score_seed,
                                         detect_cross_border, detect_round_number, detect_structuring,
                                         flag_id_registry, own_number, register_flag_ids, timed_fraud_flags)
from ledgerguard.operators.timewin import duration_micros, trailing_count
from ledgerguard.session import checkpoint_dir, ts_lit
from ledgerguard.sources.adapters import adapter_sql
from ledgerguard.sources.schemas import RISK_FLAGS_SCHEMA, conform

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table's folder is there; any storage error is raised, not taken for a missing table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def transactions_stream(spark: SparkSession, source: str, max_files_per_trigger: int | None = None,
                        max_bytes_per_trigger: str | None = None) -> DataFrame:
    """Streaming bank view of the raw event files (same projection as the batch view).

    ``max_files_per_trigger`` / ``max_bytes_per_trigger`` bound a micro-batch, and with it the share of
    a hot account that one state-function call holds."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    raw = reader.parquet(source)
    view = f"_lg_events_{uuid.uuid4().hex[:8]}"
    raw.createOrReplaceTempView(view)
    return spark.sql(adapter_sql("transactions", "spark", lambda t: view))


# ---- O-ST1 / O-ST2 ----------------------------------------------------------------------
def classify_rows(txns: DataFrame, n: int = K.VELOCITY_MIN_TXNS) -> DataFrame:
    """Row rules + the velocity count already on the rows -> the classified columns of classify_fraud."""
    df = detect_structuring(txns)
    df = detect_cross_border(df)
    df = detect_round_number(df)
    df = df.withColumn("is_velocity", F.coalesce(F.col("velocity_count") >= n, F.lit(False)))
    hits = [("is_velocity", "VELOCITY"), ("is_structuring", "STRUCTURING"),
            ("high_risk_country", "CROSS_BORDER"), ("is_round_number", "ROUND_NUMBER")]
    primary = F.when(F.col(hits[0][0]), hits[0][1])
    for col, p in hits[1:]:
        primary = primary.when(F.col(col), p)
    seed = default_score_seed(F.col("txn_id"))
    reviewed = primary.isNotNull() & (F.pmod(seed, F.lit(3)) == 0)
    return (df.withColumn("fraud_pattern", primary)
              .withColumn("is_flagged", F.col("fraud_pattern").isNotNull())
              .withColumn("flag_score", _pick_score(F.col("fraud_pattern"), seed))
              .withColumn("review_status",
                          F.when(reviewed, F.when(F.pmod(seed, F.lit(5)) == 0, "CONFIRMED_FRAUD").otherwise("CLEARED"))
                           .when(F.col("is_flagged"), "PENDING")))


SINK_SCHEMA = T.StructType([*RISK_FLAGS_SCHEMA.fields, T.StructField("txn_date", T.DateType())])


def existing_flags(spark: SparkSession, sink: str, lo=None, hi=None) -> DataFrame:
    """The sink's flags; with time bounds only those of transactions on the days between (partitions pruned)."""
    if not path_exists(spark, sink):    # first run
        return spark.createDataFrame([], RISK_FLAGS_SCHEMA)
    flags = spark.read.schema(SINK_SCHEMA).parquet(sink)
    if lo is not None:
        flags = flags.filter(F.col("txn_date").between(F.lit(lo.date()), F.lit(hi.date())))
    return flags.drop("txn_date")


def append_new_flags(flags: DataFrame, sink: str, lo, hi) -> None:
    """O-ST2 + O-S6: append only flags whose txn_id is not in the sink yet (idempotent).  ``lo``/``hi`` bound the
    transactions' times, so that of the sink only their days are read.  The flags are gathered by day before they
    are written, a large day in several files."""
    have = existing_flags(flags.sparkSession, sink, lo, hi).select("txn_id").filter(F.col("txn_id").isNotNull())
    new = flags.withColumn("txn_date", F.to_date("txn_ts")).join(have, "txn_id", "left_anti")
    new = conform(new, SINK_SCHEMA)
    new.hint("rebalance", "txn_date").write.mode("append").partitionBy("txn_date").parquet(sink)


# ---- velocity of a micro-batch from the stream's own history -----------------------------
HISTORY_SCHEMA = T.StructType([
    T.StructField("account_id", T.LongType()), T.StructField("txn_ts", T.TimestampNTZType()),
    T.StructField("txn_id", T.StringType()), T.StructField("txn_date", T.DateType()),
])


def read_history(spark: SparkSession, path: str, lo, hi) -> DataFrame:
    """Recorded transactions with time in [lo, hi] (date partitions pruned, time filter pushed down)."""
    if not path_exists(spark, path):    # first batch
        return spark.createDataFrame([], HISTORY_SCHEMA)
    h = spark.read.schema(HISTORY_SCHEMA).parquet(path)
    return (h.filter(F.col("txn_date").between(F.lit(lo.date()), F.lit(hi.date())))
             .filter(F.col("txn_ts").between(ts_lit(lo.isoformat(sep=" ")), ts_lit(hi.isoformat(sep=" ")))))


def batch_velocity(batch: DataFrame, history: str, window: str, lo, hi) -> DataFrame:
    """The batch rows plus ``velocity_count``: rows of the account in [t - W, t] among the batch and
    the transactions recorded by earlier batches.  ``lo``/``hi`` are the batch's time bounds."""
    import datetime as dt
    spark = batch.sparkSession
    since = lo - dt.timedelta(microseconds=duration_micros(window))
    # rows of a re-run epoch may already be recorded: they are counted once, as batch rows
    seen = (read_history(spark, history, since, hi).join(batch.select("txn_id"), "txn_id", "left_anti")
            .select("account_id", "txn_ts", "txn_id", F.lit(False).alias("_lg_new")))
    both = batch.withColumn("_lg_new", F.lit(True)).unionByName(seen, allowMissingColumns=True)
    counted = trailing_count(both, ["account_id"], "txn_ts", window, "velocity_count")
    return counted.filter(F.col("_lg_new")).drop("_lg_new")


def record_history(batch: DataFrame, history: str, lo, hi) -> None:
    """Append the batch's (account, time, id) to the history, skipping ids already there (re-run)."""
    spark = batch.sparkSession
    have = read_history(spark, history, lo, hi).select("txn_id")
    rows = batch.select("account_id", "txn_ts", "txn_id", F.to_date("txn_ts").alias("txn_date"))
    new = rows.join(have, "txn_id", "left_anti")
    new.hint("rebalance", "txn_date").write.mode("append").partitionBy("txn_date").parquet(history)


def start_flag_refresh(spark: SparkSession, source: str, accounts: DataFrame, sink: str, checkpoint: str,
                       *, lookback: str = "30 minutes", velocity_window: str = K.VELOCITY_WINDOW,
                       as_of: str = "2024-01-31 00:00:00", trigger: dict | None = None,
                       max_files_per_trigger: int | None = None,
                       max_bytes_per_trigger: str | None = None, history: str | None = None, flag_ids: str | None = None):
    """O-ST1: start the refresh query; ``trigger`` defaults to every 15 minutes.
    ``history`` (default: next to the sink) keeps the (account, time, id) rows the stream has seen;
    rows older than the watermark plus the velocity window can be dropped from it by date partition.
    ``flag_ids`` (default: next to the sink) is the registry of flag ids for text transaction ids."""
    registry = flag_id_registry(spark, flag_ids or f"{sink.rstrip('/')}-flag-ids")
    history = history or f"{sink.rstrip('/')}-velocity-history"
    txns = transactions_stream(spark, source, max_files_per_trigger, max_bytes_per_trigger)
    # watermarks need a TIMESTAMP (not NTZ) column: keep txn_ts as is and add the event time
    txns = (txns.withColumn("event_time", F.col("txn_ts").cast("timestamp"))
                .withWatermark("event_time", lookback).dropDuplicatesWithinWatermark(["txn_id"]))
    accounts_snapshot = accounts.select("account_id", "customer_id")

    def process(batch: DataFrame, epoch_id: int):
        # the batch is written once and read by the caller's session: adaptive execution is off in a stream's own
        staged = f"{sink.rstrip('/')}-staged-{epoch_id}"
        batch.write.mode("overwrite").parquet(staged)
        b = spark.read.schema(batch.schema).parquet(staged)
        lo, hi = b.agg(F.min("txn_ts"), F.max("txn_ts")).first()    # two scalars
        if lo is not None:
            classified = classify_rows(batch_velocity(b, history, velocity_window, lo, hi))
            # plain numbers need no registry; it is only asked where a batch holds other ids
            texts = b.filter(own_number(F.col("txn_id")).isNull()).limit(1).count()     # one number
            ids = register_flag_ids(classified, registry) if texts else None
            append_new_flags(timed_fraud_flags(classified, accounts_snapshot, as_of, ids), sink, lo, hi)
            record_history(b, history, lo, hi)
        remove_path(spark, staged)

    writer = txns.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"processingTime": "15 minutes"}))
    return writer.start()


def run_flag_refresh(spark: SparkSession, source: str, accounts: DataFrame, sink: str | None = None,
                     checkpoint: str | None = None, **kw) -> str:
    """Process everything available now (tests, catch-up runs) and return the sink path."""
    sink = sink or scratch_path(spark, "flags")
    checkpoint = checkpoint or scratch_path(spark, "ckpt-refresh")
    q = start_flag_refresh(spark, source, accounts, sink, checkpoint, trigger={"availableNow": True}, **kw)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return sink


def find_missed_flags(classified: DataFrame, flags: DataFrame) -> DataFrame:
    """O-ST3: batch reconcile - flagged transactions without a flag (late rows, lagging refresh)."""
    have = flags.select("txn_id").filter(F.col("txn_id").isNotNull())
    return classified.filter(F.col("is_flagged")).join(have, "txn_id", "left_anti")


# ---- O-ST5 / O-ST6: windowed aggregations (stream or batch) ------------------------------
def sliding_velocity(txns: DataFrame, window: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """O-ST5: txns per account per sliding window, from counts per (account, pane of one slide).

    A batch: each pane sees the panes of the next window in its row's frame (at most window / slide of them) and gives
    the rows of those windows whose first pane it is, so every window is made once and nothing is added up after the
    panes.  An account's frame holds panes, not txns.  A stream: the panes' counts are windowed again."""
    w, step = duration_micros(window), duration_micros(slide)
    if w % step:
        raise ValueError("the window must be a multiple of the slide")
    if txns.isStreaming:
        panes = txns.groupBy(F.window("txn_ts", slide).alias("p"), "account_id").agg(F.count(F.lit(1)).alias("n"))
        g = panes.groupBy(F.window(F.window_time("p"), window, slide).alias("w"), "account_id").agg(F.sum("n").alias("n"))
        return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "account_id", "n")
    k = w // step
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', txn_ts)")
    panes = (txns.filter("txn_ts IS NOT NULL").groupBy("account_id", F.floor(micros / F.lit(step)).alias("p"))
             .agg(F.count(F.lit(1)).alias("n")))
    by_time = Window.partitionBy("account_id").orderBy("p")
    seen = panes.select("account_id", "p", F.lag("p").over(by_time).alias("before"),
                        F.collect_list(F.struct("p", "n")).over(by_time.rangeBetween(0, k - 1)).alias("ahead"))
    first = F.greatest(F.coalesce(F.col("before") + 1, F.col("p") - (k - 1)), F.col("p") - (k - 1))
    starts = seen.select("account_id", "ahead", F.explode(F.sequence(first, "p")).alias("s"))
    n = F.aggregate("ahead", F.lit(0).cast("long"), lambda a, x: a + F.when(x["p"] < F.col("s") + k, x["n"]).otherwise(0))
    at = lambda pane: F.expr(f"timestampadd(MICROSECOND, ({pane}) * {step}, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    return starts.select(at("s").alias("window_start"), at(f"s + {k}").alias("window_end"), "account_id", n.alias("n"))


def flag_rate(flagged: DataFrame, ts_col: str = "txn_ts", every: str = "15 minutes") -> DataFrame:
    """O-ST6: flags per tumbling window by domain and severity."""
    g = flagged.groupBy(F.window(ts_col, every).alias("w"), "flag_domain", "severity").agg(
        F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "flag_domain", "severity", "n")
