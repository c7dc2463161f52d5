"""Registered entries for document search (O-R*) and streaming (O-ST*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.operators import search as R
from ledgerguard.operators.flags import payload_field
from ledgerguard.plans.detect_queries import c
from ledgerguard.streaming import doc_index as DI
from ledgerguard.streaming import refresh as ST
from ledgerguard.streaming import velocity as V

# --- fixed values: the question set of the search check (parameters, not data) ---
QUESTIONS = [
    "What is the minimum liquidity coverage ratio and when must the supervisor be notified",
    "Which cash deposits below the reporting threshold indicate structuring",
    "How are politically exposed persons handled in enhanced due diligence",
    "When is an account classified as non performing and how much must be provisioned",
    "What triggers a suspicious activity report and what is the filing deadline",
    "Which jurisdictions are high risk for cross border wire transfers",
    "How is the net stable funding ratio calculated",
    "What is the credit watch list threshold for probability of default",
]


def _postings(ctx) -> DataFrame:
    return ctx.postings


def _questions(ctx) -> DataFrame:
    return ctx.spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, text string")


def index_postings(ctx):
    """O-R1: the full inverted index (built, not read from the stored index)."""
    return ctx.derived_postings


def index_stats(ctx):
    p = _postings(ctx)
    return p.agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("term").alias("n_terms"),
                 F.sum("tf").alias("total_tf"))


def bm25_top_k(ctx):
    """O-R2 / O-R4: eight questions x all documents, top 10 each."""
    return R.bm25(ctx.search_index, _questions(ctx), k=10)


def bm25_filtered(ctx):
    """O-R2 with attribute filters: regulations and internal policies only."""
    docs = ctx.policy_docs.filter(c("doc_type").isin("REGULATION", "INTERNAL_POLICY"))
    return R.bm25(ctx.search_index, _questions(ctx), k=5, docs=docs)


def bm25_benchmark(ctx):
    """Every benchmark passage (whole text) as a query: where does it occur?"""
    qs = ctx.bank.raw("benchmark").select(c("item_id").alias("query_id"), "text")
    return R.bm25(ctx.search_index, qs, k=3)


def vector_top_k(ctx):
    """O-R3: label centroids as queries, cosine top 10 over all embeddings."""
    emb = ctx.bank.raw("embeddings")
    return R.vector_search(ctx.vector_index, R.label_centroids(emb), k=10)


def vector_neighbours(ctx):
    """O-R3 with as many queries as there are vectors: each one's five nearest, itself included."""
    q = ctx.bank.raw("embeddings").select(c("vec_id").alias("query_id"), c("embedding").alias("qvec"))
    return R.vector_search(ctx.vector_index, q, k=5)


def doc_tags(ctx):
    return R.doc_tags(ctx.policy_docs)


def doc_snippets(ctx):
    return R.doc_snippets(ctx.policy_docs)


def conversation_pairs(ctx):
    return R.conversation_pairs(ctx.bank.raw("conversations"))


def conversation_newest(ctx):
    """O-R7: every exchange with its place, the newest of its conversation first."""
    return R.newest_first(R.conversation_pairs(ctx.bank.raw("conversations"))).select("conv_id", "user_turn", "question", "nth")


def conversation_summary(ctx):
    return R.conversation_summary(R.conversation_pairs(ctx.bank.raw("conversations")))


def agent_responses(ctx) -> DataFrame:
    """Saved agent responses rebuilt from the conversation log: one JSON message per turn, keyed by
    its conversation, with a text part (user/assistant turns) or a tool-use part (system turns).

    A row per turn, not a body per conversation: no conversation is ever gathered into one row,
    however long it is; the extraction combines the messages of a conversation map-side."""
    conv = ctx.bank.raw("conversations")
    part = F.when(c("role") == "system", F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string")
                                                  .alias("text"), F.lit("context_loader").alias("name"))) \
        .otherwise(F.struct(F.lit("text").alias("type"), c("text"), F.lit(None).cast("string").alias("name")))
    return conv.select(c("conv_id").alias("response_id"), "turn",
                       F.to_json(F.struct(F.array(part).alias("content"))).alias("body"))


def agent_log_extract(ctx):
    """O-R8."""
    return R.agent_log_extract(agent_responses(ctx))


def run_summary(ctx):
    """O-R9 over the question run."""
    return R.run_summary(_questions(ctx), bm25_top_k(ctx))


def run_totals(ctx):
    """O-R9: the run's totals over the questions and every benchmark passage; seconds only tell that it was timed."""
    asked = _questions(ctx).unionByName(ctx.bank.raw("benchmark").select((c("item_id") + 1000).alias("query_id"), "text"))
    _, totals = R.run_report(ctx.search_index, asked.unionByName(ctx.spark.createDataFrame([(-1, "?!")], "query_id long, text string")))
    return totals.select("asked", "passed", "failed", (c("seconds") > 0).alias("timed"))


# ---- streaming ---------------------------------------------------------------
def _events_glob(ctx) -> str:
    return f"{ctx.sf_dir.rstrip('/')}/event[s].parquet"


def refresh_increment(ctx):
    """O-ST1 + O-ST4: one catch-up run of the refresh stream; the appended flags."""
    sink = ST.run_flag_refresh(ctx.spark, _events_glob(ctx), ctx.accounts, velocity_window=ctx.velocity_window,
                               as_of=ctx.as_of)
    out = ctx.spark.read.parquet(sink)
    return out.select("flag_id", "flag_type", "severity", "flag_status", "customer_id", "account_id", "txn_id",
                      "flag_score")


def stream_velocity(ctx, delay_minutes: int = 30, late_minutes: int = 20, deliveries: int = 3):
    """O-ST4: velocity counted by the stateful stream while rows come up to 20 minutes late, in three deliveries; all rows
    whose granule the watermark has passed."""
    spark = ctx.spark
    source = ST.scratch_path(spark, "deliveries")
    events = ctx.bank.raw("events")
    # a row arrives up to late_minutes after its time, so rows of one delivery are older than some of the one before
    late = F.make_dt_interval(secs=(c("event_id") % F.lit(60 * late_minutes)).cast("decimal(18,6)"))
    arrives = c("ts") + late
    lo, hi = events.agg(F.min(arrives), F.max(arrives)).first()     # two scalars
    sink, checkpoint = ST.scratch_path(spark, "velocity"), ST.scratch_path(spark, "ckpt-velocity")
    for i in range(deliveries):
        start, end = (lo + (hi - lo) * x / deliveries for x in (i, i + 1))
        due = (arrives >= F.lit(start)) & ((arrives < F.lit(end)) if i < deliveries - 1 else F.lit(True))
        events.filter(due).write.mode("append").parquet(source)
        V.run_velocity(spark, source, ctx.velocity_window, f"{delay_minutes} minutes", 2, sink, checkpoint)
    return spark.read.parquet(sink).select("txn_id", "account_id", "txn_ts", "velocity_count")


def refresh_rerun(ctx):
    """O-ST2: the same stream run twice into one sink; the second run appends nothing."""
    spark = ctx.spark
    sink = ST.scratch_path(spark, "flags")
    for _ in (1, 2):
        ST.run_flag_refresh(spark, _events_glob(ctx), ctx.accounts, sink=sink,
                            velocity_window=ctx.velocity_window, as_of=ctx.as_of)
    # a flag that the second run had appended again would stand twice
    per_flag = ST.existing_flags(spark, sink).groupBy("flag_id").agg(F.count(F.lit(1)).alias("n"))
    one = per_flag.agg(F.count(F.lit(1)).alias("first"), F.sum(c("n") - 1).alias("again"))
    return one.select(F.explode(F.array(F.struct(F.lit(1).cast("long").alias("run"), c("first").alias("added")),
                                        F.struct(F.lit(2).cast("long").alias("run"), F.coalesce("again", F.lit(0)).alias("added")))).alias("r")
                      ).select("r.run", "r.added")


def missed_flags(ctx, cutoff: str = "2024-01-30 00:00:00"):
    """O-ST3: the files with the rows from ``cutoff`` on have not arrived at the stream yet; the batch
    reconcile over all transactions finds what is missing."""
    spark = ctx.spark
    arrived = ST.scratch_path(spark, "arrived")
    ctx.bank.raw("events").filter(c("ts") < F.to_timestamp_ntz(F.lit(cutoff))).write.parquet(arrived)
    sink = ST.run_flag_refresh(spark, arrived, ctx.accounts, velocity_window=ctx.velocity_window, as_of=ctx.as_of)
    flags = ST.existing_flags(spark, sink)
    return ST.find_missed_flags(ctx.transactions, flags).select("txn_id", "account_id", "txn_ts", "fraud_pattern")


def sliding_velocity(ctx):
    """O-ST5 (batch run of the streaming aggregation)."""
    return ST.sliding_velocity(ctx.bank.transactions)


def flag_rate_15min(ctx):
    """O-ST6 (batch run): fraud flags per 15 minutes of transaction time, which the flag's payload carries."""
    f = ctx.fraud_flags.select("flag_domain", "severity", payload_field("txn_ts", "timestamp_ntz").alias("txn_ts"))
    return ST.flag_rate(f)


def doc_index_stream(ctx):
    """O-ST7: index refresh as a stream over the document files; index statistics."""
    root = ST.scratch_path(ctx.spark, "index")
    index = DI.run_index_refresh(ctx.spark, f"{ctx.sf_dir.rstrip('/')}/document[s].parquet", root, f"{root}-ckpt")
    return index.postings().agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("term").alias("n_terms"),
                                F.sum("tf").alias("total_tf"))


def doc_index_changes(ctx):
    """O-ST7: all documents are delivered, then a second time with changes (the French ones get their source as a last
    word, the Spanish ones are withdrawn, the rest come as they were); each document in the index, the version that
    last wrote it, and its terms, after a compaction."""
    spark, docs = ctx.spark, ctx.bank.raw("documents")
    source, root = ST.scratch_path(spark, "deliveries"), ST.scratch_path(spark, "index")
    text = F.when(c("lang") == "fr", F.concat_ws(" ", "text", "source")).when(c("lang") != "es", c("text"))
    for delivery in (docs, docs.withColumn("text", text)):
        delivery.write.mode("append").parquet(source)
        index = DI.run_index_refresh(spark, source, root, f"{root}-ckpt")
    written = index.documents().select("doc_id", c("v").alias("version"))
    index.compact()
    terms = index.postings().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("total_tf"))
    return (written.join(terms, "doc_id", "left")
            .select("doc_id", c("version").cast("long").alias("version"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
                    F.coalesce("total_tf", F.lit(0)).alias("total_tf")))


ENTRIES = {
    "index_postings": index_postings, "index_stats": index_stats, "bm25_top_k": bm25_top_k,
    "bm25_filtered": bm25_filtered, "bm25_benchmark": bm25_benchmark, "vector_top_k": vector_top_k, "vector_neighbours": vector_neighbours,
    "doc_tags": doc_tags, "doc_snippets": doc_snippets, "conversation_pairs": conversation_pairs,
    "conversation_summary": conversation_summary, "conversation_newest": conversation_newest, "agent_log_extract": agent_log_extract,
    "run_summary": run_summary, "run_totals": run_totals,
    "stream_velocity": stream_velocity, "refresh_increment": refresh_increment, "refresh_rerun": refresh_rerun, "missed_flags": missed_flags,
    "sliding_velocity": sliding_velocity, "flag_rate_15min": flag_rate_15min, "doc_index_stream": doc_index_stream,
    "doc_index_changes": doc_index_changes,
}
