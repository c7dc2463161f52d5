"""Streaming refresh: stream == batch on in-order data, idempotent re-run, late data."""

import shutil

from pyspark.sql import functions as F

from conftest import SF001
from ledgerguard.plans.context import RiskContext
from ledgerguard.streaming import refresh as ST


def test_stream_equals_batch_and_rerun_adds_nothing(spark):
    ctx = RiskContext(spark, SF001)
    sink = ST.run_flag_refresh(spark, f"{SF001}/event[s].parquet", ctx.accounts, velocity_window="24 hours")
    got = spark.read.parquet(sink).select("flag_id", "flag_type", "flag_score", "flag_status")
    want = ctx.fraud_flags.select("flag_id", "flag_type", "flag_score", "flag_status")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    n = got.count()
    ST.run_flag_refresh(spark, f"{SF001}/event[s].parquet", ctx.accounts, sink=sink, velocity_window="24 hours")
    assert spark.read.parquet(sink).count() == n


def test_late_rows_are_dropped_and_reconciled(spark, tmp_path):
    ctx = RiskContext(spark, SF001)
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    land = tmp_path / "landing"
    # first file: the last day; second file: the rest of the month, entirely older than the watermark
    ev.filter(F.col("ts") >= "2024-01-30").coalesce(1).write.parquet(str(land / "a"))
    ev.filter(F.col("ts") < "2024-01-30").coalesce(1).write.parquet(str(land / "b"))
    src = str(tmp_path / "src")
    import os
    os.makedirs(src)
    shutil.copy(next(p for p in (land / "a").glob("*.parquet")), os.path.join(src, "1.parquet"))
    sink, ckpt = ST.scratch_path(spark, "flags"), ST.scratch_path(spark, "ckpt")
    q = ST.start_flag_refresh(spark, src, ctx.accounts, sink, ckpt, trigger={"availableNow": True},
                              velocity_window="24 hours")
    q.awaitTermination()
    first = spark.read.parquet(sink).count()
    shutil.copy(next(p for p in (land / "b").glob("*.parquet")), os.path.join(src, "2.parquet"))
    q = ST.start_flag_refresh(spark, src, ctx.accounts, sink, ckpt, trigger={"availableNow": True},
                              velocity_window="24 hours")
    q.awaitTermination()
    assert spark.read.parquet(sink).count() == first          # late file ignored by the watermark
    missed = ST.find_missed_flags(ctx.transactions, ST.existing_flags(spark, sink))
    # in the in-order part only velocity can differ: the stream never saw the preceding 24 hours
    recent = missed.filter(F.col("txn_ts") >= "2024-01-30")
    assert recent.filter(F.col("fraud_pattern") != "VELOCITY").count() == 0
    assert missed.filter(F.col("txn_ts") < "2024-01-30").count() > 0   # the late rows, found by the reconcile


def brute_velocity(rows, window_s):
    """(txn_id, count) of (txn_id, account, time) rows: the account's rows in [t - window, t]."""
    import bisect
    import collections
    times = collections.defaultdict(list)
    for _, account, t in rows:
        times[account].append(t)
    for v in times.values():
        v.sort()
    return {i: bisect.bisect_right(times[a], t) - bisect.bisect_left(times[a], t - window_s) for i, a, t in rows}


def counted_stream(spark, deliveries, tmp_path, window, granules, delay="30 minutes"):
    """The operator over (txn_id, account_id, epoch seconds) deliveries, each its own run on one checkpoint."""
    from ledgerguard.streaming import velocity as V
    src, sink, ckpt = (str(tmp_path / x) for x in ("src", "sink", "ckpt"))
    schema = "txn_id string, account_id long, txn_ts timestamp_ntz"
    for rows in deliveries:
        df = spark.createDataFrame([(str(i), a, t) for i, a, t in rows], "txn_id string, account_id long, s long")
        df.select("txn_id", "account_id", F.expr("timestampadd(SECOND, s, TIMESTAMP_NTZ '1970-01-01 00:00:00')").alias("txn_ts")
                  ).repartition(3).write.mode("append").parquet(src)
        stream = (V.stateful_session(spark).readStream.schema(schema).parquet(src)
                  .withColumn("event_time", F.col("txn_ts").cast("timestamp")).withWatermark("event_time", delay))
        q = (V.streaming_velocity(stream, window, granules).writeStream.format("parquet").option("path", sink)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
    return {int(r["txn_id"]): r["velocity_count"] for r in spark.read.parquet(sink).collect()}


def test_stream_velocity_is_exact_for_late_rows_and_a_hot_account(spark, tmp_path):
    """Rows come up to 25 minutes late over several runs; account 1 holds a third of all rows, densely."""
    import random
    rng = random.Random(1)
    base = 1_700_000_000
    rows = [(i, 1 if i % 3 == 0 else None if i % 50 == 1 else rng.randrange(2, 12), base + rng.randrange(0, 6 * 3600)) for i in range(3000)]
    rows += [(3000 + i, 1, base + 7200 + i % 5) for i in range(500)]        # ties and one very dense moment
    arrival = {r[0]: r[2] + rng.randrange(0, 1500) for r in rows}
    cuts = [base, base + 2 * 3600, base + 4 * 3600, base + 9 * 3600]
    deliveries = [[r for r in rows if lo <= arrival[r[0]] < hi] for lo, hi in zip(cuts, cuts[1:])]
    assert sum(map(len, deliveries)) == len(rows)
    deliveries.append([(9999, 99, base + 48 * 3600)])                       # moves the watermark past all of them
    got = counted_stream(spark, deliveries, tmp_path, "1 hour", 8)
    assert got == brute_velocity(rows, 3600)


def test_stream_velocity_drops_rows_behind_the_watermark(spark, tmp_path):
    base = 1_700_000_000
    rows = [(1, 1, base), (2, 1, base + 60), (3, 1, base + 7200)]
    late = [(4, 1, base + 30), (5, 1, base + 7100)]                         # 4 is two hours behind, 5 within the delay
    got = counted_stream(spark, [rows, late, [(9, 9, base + 90000)]], tmp_path, "1 hour", 4)
    assert got == {1: 1, 2: 2, 3: 2, 5: 1}


def test_stream_velocity_with_one_granule(spark, tmp_path):
    base = 1_700_000_000
    rows = [(i, i % 2, base + 400 * i) for i in range(60)]
    got = counted_stream(spark, [rows, [(99, 9, base + 90000)]], tmp_path, "1 hour", 1)
    assert got == brute_velocity(rows, 3600)


def test_one_state_key_counts_many_accounts():
    """The state's keys do not grow with the accounts: a granule of a bucket counts each of its accounts apart."""
    import random
    import pandas as pd
    import pyarrow as pa
    from ledgerguard.streaming import velocity as V
    rng = random.Random(3)
    window, width = 3600 * 10**6, 1800 * 10**6
    rows = [(str(i), f"a{rng.randrange(40)}", rng.randrange(0, 6 * width)) for i in range(2000)]
    sent = pa.RecordBatch.from_pydict({"account_id": [r[1] for r in rows], "txn_id": [r[0] for r in rows], "t": [r[2] for r in rows]})
    table = pa.Table.from_batches(list(V._sent(window, width)([sent])))
    state, out = V._Granule(window, width), []
    for granule in range(6):
        out += list(state.counted(table.filter(pa.compute.equal(table.column("granule"), granule)).select(V.STATE.names), granule * width))
    got = pd.concat(out)
    assert dict(zip(got["txn_id"], got["velocity_count"])) == brute_velocity(rows, window)


def test_sliding_counts_of_panes_equal_a_row_by_row_expand(spark):
    ctx = RiskContext(spark, SF001)
    t = ctx.bank.transactions
    want = (t.groupBy(F.window("txn_ts", "1 hour", "5 minutes").alias("w"), "account_id").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "account_id", "n"))
    got = ST.sliding_velocity(t)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_sliding_counts_of_a_stream(spark, tmp_path):
    """The stream windows the panes' counts again; what the watermark has passed equals the batch."""
    ctx = RiskContext(spark, SF001)
    stream = ST.transactions_stream(spark, f"{SF001}/event[s].parquet")
    stream = stream.withColumn("txn_ts", F.col("txn_ts").cast("timestamp")).withWatermark("txn_ts", "30 minutes")
    sink = str(tmp_path / "sink")
    q = (ST.sliding_velocity(stream).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(sink).select(F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz"), "account_id", "n")
    want = ST.sliding_velocity(ctx.bank.transactions)
    assert got.exceptAll(want).count() == 0
    last = ctx.bank.transactions.agg(F.max("txn_ts") - F.expr("INTERVAL 30 MINUTES")).first()[0]
    assert got.count() == want.filter(F.col("window_end") <= F.lit(last)).count() > 0


def test_velocity_history_spans_micro_batches(spark, tmp_path):
    """Two in-order files, one per micro-batch: the second batch's velocity counts reach back into the
    first through the recorded history, so the stream equals the batch flags exactly."""
    import os
    ctx = RiskContext(spark, SF001)
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    land, src = tmp_path / "landing", tmp_path / "src"
    os.makedirs(src)
    ev.filter(F.col("ts") < "2024-01-16").coalesce(1).write.parquet(str(land / "a"))
    ev.filter(F.col("ts") >= "2024-01-16").coalesce(1).write.parquet(str(land / "b"))
    for i, part in enumerate(("a", "b")):
        dst = os.path.join(src, f"{i}.parquet")
        shutil.copy(next(p for p in (land / part).glob("*.parquet")), dst)
        os.utime(dst, (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))   # arrival order = file order
    sink, ckpt = ST.scratch_path(spark, "flags"), ST.scratch_path(spark, "ckpt")
    q = ST.start_flag_refresh(spark, str(src), ctx.accounts, sink, ckpt, trigger={"availableNow": True},
                              velocity_window="24 hours", max_files_per_trigger=1)
    q.awaitTermination()
    assert len(q.recentProgress) >= 2                          # really two micro-batches
    got = spark.read.parquet(sink).select("flag_id", "flag_type", "flag_score", "flag_status")
    want = ctx.fraud_flags.select("flag_id", "flag_type", "flag_score", "flag_status")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert spark.read.parquet(f"{sink}-velocity-history").count() == ev.count()


def test_history_read_is_partition_pruned(spark):
    """A micro-batch reads only the date partitions of its window from the velocity history."""
    import contextlib
    import datetime as dt
    import io
    ctx = RiskContext(spark, SF001)
    hist = ST.scratch_path(spark, "hist")
    t = ctx.bank.transactions
    lo, hi = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 11, 12)
    ST.record_history(t, hist, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1))
    h = ST.read_history(spark, hist, lo, hi)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        h.explain("formatted")
    assert "PartitionFilters: [isnotnull(txn_date" in buf.getvalue() and "2024-01-10" in buf.getvalue()
    want = t.filter((F.col("txn_ts") >= "2024-01-10") & (F.col("txn_ts") <= "2024-01-11 12:00:00")).count()
    assert h.count() == want > 0


def test_sink_reads_are_partition_pruned(spark):
    """A micro-batch reads only the days of its transactions from the flags written so far, and writes few files a day."""
    import contextlib
    import datetime as dt
    import io
    ctx = RiskContext(spark, SF001)
    sink = ST.run_flag_refresh(spark, f"{SF001}/event[s].parquet", ctx.accounts, velocity_window="24 hours")
    some = ST.existing_flags(spark, sink, dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 11))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        some.explain("formatted")
    assert "PartitionFilters: [isnotnull(txn_date" in buf.getvalue() and "2024-01-10" in buf.getvalue()
    days = ctx.transactions.filter("is_flagged").select("txn_id", F.to_date("txn_ts").alias("d")).filter("d BETWEEN '2024-01-10' AND '2024-01-11'")
    assert some.count() == days.count() > 0
    files = spark.read.parquet(sink).select("txn_date", "_metadata.file_path").groupBy("txn_date").agg(F.countDistinct("file_path").alias("n"))
    assert files.agg(F.max("n")).first()[0] == 1
