"""Generator golden counts, window helpers vs brute force, search and conversation helpers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerguard.operators import search as R
from ledgerguard.operators.timewin import range_sums, trailing_count
from ledgerguard.sources import generate as GEN


def test_generator_golden_counts(spark):
    counts = {r.fraud_pattern: r.n for r in GEN.label_counts(GEN.generate_transactions(spark, 50000)).collect()}
    assert counts == {"VELOCITY": 7579, "STRUCTURING": 846, "CROSS_BORDER": 273, "ROUND_NUMBER": 273}
    assert sum(counts.values()) == 8971


def test_split_and_lookup(spark):
    assert [(r.value, r.idx) for r in GEN.split_to_rows(spark, "a,b,c").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    df = spark.range(3).select(GEN.lookup(["x", "y", "z"], F.col("id")).alias("v"))
    assert [r.v for r in df.collect()] == ["x", "y", "z"]


def _random_rows(n=400, keys=3, seed=7):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    return [(i, rnd.randrange(keys), t0 + dt.timedelta(seconds=rnd.randrange(0, 5 * 86400)), rnd.randrange(1, 9))
            for i in range(n)]


def test_bucketed_windows_match_brute_force(spark):
    data = _random_rows()
    df = spark.createDataFrame(data, "id long, k long, ts timestamp_ntz, v long")
    w = dt.timedelta(hours=6)
    tc = {r.id: r.c for r in trailing_count(df, ["k"], "ts", "6 hours", "c").collect()}
    fw = {r.id: (r.n, r.s) for r in range_sums(df, ["k"], "ts", "6 hours",
                                                {"n": F.lit(1), "s": F.col("v")}, "forward").collect()}
    for i, k, t, v in data:
        same = [(t2, v2) for _, k2, t2, v2 in data if k2 == k]
        assert tc[i] == sum(1 for t2, _ in same if t - w <= t2 <= t)
        fwd = [v2 for t2, v2 in same if t <= t2 <= t + w]
        assert fw[i] == (len(fwd), sum(fwd))


def test_top_k_is_exact(spark):
    rnd = random.Random(3)
    data = [(q, d, float(rnd.randrange(50))) for q in range(3) for d in range(300)]
    df = spark.createDataFrame(data, "query_id long, doc_id long, score double")
    got = {(r.query_id, r.rank): r.doc_id for r in R.top_k_per_group(df, ["query_id"], "score", "doc_id", 7,
                                                                      buckets=16).collect()}
    for q in range(3):
        want = sorted([x for x in data if x[0] == q], key=lambda x: (-x[2], x[1]))[:7]
        assert [got[(q, i + 1)] for i in range(7)] == [d for _, d, _ in want]


def test_index_bm25_and_pairs(spark):
    docs = spark.createDataFrame([(1, "Liquidity coverage ratio, LCR!"), (2, "Cash deposits; cash structuring"),
                                  (3, "")], "doc_id long, content string")
    post = R.build_index(docs)
    assert sorted((r.doc_id, r.term, r.tf, r.doc_len) for r in post.filter("doc_id = 2").collect()) == [
        (2, "cash", 2, 4), (2, "deposits", 1, 4), (2, "structuring", 1, 4)]
    q = spark.createDataFrame([(0, "cash LCR")], "query_id long, text string")
    res = R.bm25(R.write_index(docs), q, k=5).collect()
    assert {r.doc_id for r in res} == {1, 2}
    conv = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
                                  (1, 3, "user", "q2"), (1, 4, "user", "q3"), (1, 5, "assistant", "a3")],
                                 "conv_id long, turn long, role string, text string")
    assert sorted((r.question, r.answer) for r in R.conversation_pairs(conv).collect()) == [("q1", "a1"), ("q3", "a3")]
    # a gap, over a range's end too, and a repeated turn number
    gaps = spark.createDataFrame([(1, 0, "user", "q1"), (1, 9, "assistant", "a1"), (1, 10, "user", "q2"),
                                  (1, 12, "assistant", "a2"), (1, 12, "assistant", "again"), (2, 7, "user", "q3")],
                                 "conv_id long, turn long, role string, text string")
    for size in (1, 4, 1024):
        got = sorted((r.question, r.answer) for r in R.conversation_pairs(gaps, size).collect())
        assert got == [("q1", "a1"), ("q2", "a2")]


def test_exchanges_newest_first(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.randrange(300), f"q{i}", "a") for i in range(200)]
    pairs = spark.createDataFrame(rows, "conv_id long, user_turn long, question string, answer string")
    want = set()
    for conv in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (-r[1], r[2]))
        want |= {(*r, n) for n, r in enumerate(mine, 1)}
    for size in (1, 7, 1024):
        assert {tuple(r) for r in R.newest_first(pairs, size).collect()} == want


def test_run_summary_counts_questions_without_hits(spark):
    asked = spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, text string")
    hits = spark.createDataFrame([(1, 5, 2.0), (1, 6, 3.0)], "query_id long, doc_id long, score double")
    assert sorted(tuple(r) for r in R.run_summary(asked, hits).collect()) == [(1, 2, 3.0, True), (2, 0, None, False)]


def test_a_run_reports_failed_questions_and_its_time(spark):
    docs = spark.createDataFrame([(1, "cash deposit"), (2, "wire")], "doc_id long, content string")
    asked = spark.createDataFrame([(1, "cash"), (2, "gold"), (3, "")], "query_id long, text string")
    each, totals = R.run_report(R.write_index(docs), asked, k=3)
    assert sorted((r.query_id, r.hits, r.passed) for r in each.collect()) == [(1, 1, True), (2, 0, False), (3, 0, False)]
    t = totals.first()
    assert (t.asked, t.passed, t.failed) == (3, 1, 2) and t.seconds > 0 and all(r.latency_seconds == t.seconds for r in each.collect())


def test_profiles_are_observed_when_tables_are_stored(spark):
    """The stored tables' counts and domain checks come with the write; what is observed equals a scan."""
    from ledgerguard.operators import quality as DQ
    from ledgerguard.plans.context import RiskContext
    ctx = RiskContext(spark, "/root/testdata/sf0.001")
    tables = {"transactions": ctx.transactions, "credit_exposures": ctx.credit_exposures, "customers": ctx.customers}
    assert set(ctx.observed) == {"transactions", "credit_exposures"}
    rows = lambda df: sorted(map(tuple, df.collect()))
    observed, scanned = DQ.profile(tables, ctx.observed), DQ.profile(tables)
    assert rows(observed) == rows(scanned)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().toString().count("parquet")
    assert scans(scanned) == 4 and scans(observed) == 2     # customers join nation; the two others are one scan each


def test_agent_log_extract(spark):
    body = '{"content":[{"type":"text","text":"short"},{"type":"tool_use","name":"search"},' \
           '{"type":"text","text":"the longest part"},{"type":"tool_use","name":"analyst"}]}'
    df = spark.createDataFrame([(1, body)], "response_id long, body string")
    r = R.agent_log_extract(df).collect()[0]
    assert r.answer == "the longest part" and r.tools == "analyst,search"


def test_cached_table_ttl(spark):
    from ledgerguard.sources.sinks import CachedTable
    calls = []

    def load():
        calls.append(1)
        return spark.range(5)

    t = CachedTable(load, ttl_seconds=3600)
    assert t.get().count() == 5 and t.get().count() == 5 and len(calls) == 1
    t.ttl = -1
    t.get()
    assert len(calls) == 2
    t.invalidate()


def test_index_matches_explode_group_by_on_whole_documents(spark):
    """The map-only index equals the textbook explode + group-by over the full driver texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text")
                                                                                  .alias("content"))
    got = R.build_index(docs)
    toks = docs.select("doc_id", R.tokenize(F.col("content")).alias("t"))
    want = (toks.select("doc_id", F.size("t").alias("doc_len"), F.explode("t").alias("term"))
                .groupBy("doc_id", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))
                .select("doc_id", "term", "tf", "doc_len"))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def brute_neighbours(vecs, qs, k):
    import math

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))
    out = []
    for q, qv in qs:
        best = sorted((-round(cos(v, qv), 5), i) for i, v in vecs if any(v))[:k] if any(qv) else []
        out += [(q, i, r, -x) for r, (x, i) in enumerate(best, 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.vec_id, r["rank"], r.score) for r in df.collect())


def test_vector_search_matches_brute_force(spark):
    """Spread vectors, ties, zero vectors, fewer vectors than k, any number of clusters and of probed ones."""
    rnd = random.Random(11)
    vecs = [(i, [rnd.randrange(-4, 5) / 4 for _ in range(6)]) for i in range(300)] + [(900, [0.0] * 6), (901, [1.0] * 6), (902, [1.0] * 6)]
    qs = [(q, [rnd.randrange(-4, 5) / 4 for _ in range(6)]) for q in range(150)] + [(500, [0.0] * 6), (501, [1.0] * 6)]
    v = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    q = spark.createDataFrame(qs, "query_id long, qvec array<double>")
    want = brute_neighbours(vecs, qs, 5)
    for clusters, probe in ((1, 1), (8, 1), (32, 3), (400, 2)):
        got = found(R.vector_search(R.write_vector_index(v, clusters=clusters), q, k=5, probe=probe))
        assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(x[3] - y[3]) < 1.1e-5 for x, y in zip(got, want))
    few = R.write_vector_index(v.limit(3), clusters=2)
    assert R.vector_search(few, q.filter("query_id < 2"), k=5).count() == 6
    assert R.vector_search(R.write_vector_index(v.limit(0)), q, k=5).count() == 0


def test_vector_search_leaves_clusters_out(spark):
    """On vectors in bundles far fewer pairs are scored than vectors times queries, and the result is exact; the plan does
    not grow with the queries."""
    rnd = random.Random(12)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    vecs = [(i, [x + rnd.gauss(0, 0.03) for x in centres[i % 12]]) for i in range(1200)]
    qs = [(q, [x + rnd.gauss(0, 0.03) for x in centres[q % 12]]) for q in range(300)]
    v = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    q = spark.createDataFrame(qs, "query_id long, qvec array<double>")
    index = R.write_vector_index(v, clusters=40)
    pairs = []
    got = R.vector_search(index, q, k=5, pairs=pairs)
    assert [x[:3] for x in found(got)] == [x[:3] for x in brute_neighbours(vecs, qs, 5)]
    scored = sum(p.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for p in pairs)
    assert scored < 0.25 * 1200 * 300, scored
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString().split("\n"))
    assert size(got) == size(R.vector_search(index, q.limit(1), k=5))


def test_agent_messages_are_one_row_per_turn(spark):
    from ledgerguard.plans.context import RiskContext
    from ledgerguard.plans.search_queries import agent_responses
    ctx = RiskContext(spark, "/root/testdata/sf0.001")
    conv = ctx.bank.raw("conversations")
    assert agent_responses(ctx).count() == conv.count()


def test_granules_match_brute_force(spark):
    """Keys cut by their density (all of them, the dense ones among others, with a density table of other buckets, a
    null key) give the same trailing counts, sums and forward maxima."""
    from ledgerguard.operators.timewin import density, forward_max
    data = _random_rows(n=500, keys=3, seed=5)
    data += [(1000 + i, 7, dt.datetime(2024, 1, 2) + dt.timedelta(seconds=37 * i), i % 5) for i in range(300)]
    data += [(2000 + i, None, dt.datetime(2024, 1, 2) + dt.timedelta(seconds=60 * (i // 3)), i % 5) for i in range(60)]
    df = spark.createDataFrame(data, "id long, k long, ts timestamp_ntz, v long")
    w = dt.timedelta(hours=6)
    given = density(df, ["k"], "ts", "1 hour")
    want = {}
    for i, k, t, v in data:
        same = [(t2, v2) for _, k2, t2, v2 in data if k2 == k]
        back = [v2 for t2, v2 in same if t - w <= t2 <= t]
        fwd = [v2 for t2, v2 in same if t <= t2 <= t + w]
        want[i] = (len(back), sum(back), len(fwd), sum(fwd), max(fwd))
    for split in ({"rows_per_granule": 1}, {"rows_per_granule": 100}, {"dense": given, "rows_per_granule": 20}, {}):
        tc = {r.id: (r.c, r.s) for r in trailing_count(df, ["k"], "ts", "6 hours", "c", "v", "s", **split).collect()}
        fw = {r.id: (r.n, r.s) for r in range_sums(df, ["k"], "ts", "6 hours", {"n": F.lit(1), "s": F.col("v")},
                                                    "forward", **split).collect()}
        fm = {r.id: r.mx for r in forward_max(df, ["k"], "ts", "6 hours", "v", "mx", **split).collect()}
        assert {i: (*tc[i], *fw[i], fm[i]) for i in tc} == want, split


def test_windows_have_no_frame_that_ends_unbounded(spark):
    """A frame from the current row to the end is summed anew for every row: rows times rows of a bucket.  Counts and sums
    (integers, decimals), sums of doubles and maxima do without it, in both directions, also before 1970 and with nulls."""
    from ledgerguard.operators.timewin import forward_max
    rnd = random.Random(11)
    t0 = dt.datetime(1969, 12, 30)
    data = [(i, rnd.randrange(3), t0 + dt.timedelta(minutes=rnd.randrange(4 * 1440)), rnd.choice([None, -3, 0, 2, 7])) for i in range(300)]
    df = spark.createDataFrame(data, "id long, k long, ts timestamp_ntz, v long")
    w = dt.timedelta(hours=6)
    measures = {"n": F.lit(1), "s": F.col("v"), "m": F.col("v").cast("decimal(18,2)"), "d": F.col("v").cast("double") / 2}
    for split in ({"rows_per_granule": 5}, {}):
        for direction in ("trailing", "forward"):
            out = range_sums(df, ["k"], "ts", "6 hours", measures, direction, **split)
            got = {r.id: (r.n, r.s, r.m, r.d) for r in out.collect()}
            plans = [out._jdf.queryExecution().optimizedPlan().toString()]
            for i, k, t, _ in data:
                lo, hi = (t - w, t) if direction == "trailing" else (t, t + w)
                hit = [v2 for _, k2, t2, v2 in data if k2 == k and lo <= t2 <= hi]
                total = sum(v2 or 0 for v2 in hit)
                assert got[i] == (len(hit), total, total, total / 2), (direction, split)
            if direction == "forward":
                top = forward_max(df, ["k"], "ts", "6 hours", "v", "mx", **split)
                plans.append(top._jdf.queryExecution().optimizedPlan().toString())
                for r in top.collect():
                    assert r.mx == max((v2 for _, k2, t2, v2 in data if k2 == r.k and r.ts <= t2 <= r.ts + w and v2 is not None), default=None)
            assert all("RangeFrame" in p and "currentrow$(), unboundedfollowing$()" not in p for p in plans)


def test_density_decides_the_granules(spark):
    """A dense key is cut, a long one with few rows a window is not."""
    from ledgerguard.operators.timewin import _granules, density, duration_micros
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(seconds=i)) for i in range(2000)]          # 2,000 rows in one hour
    rows += [(2, start + dt.timedelta(hours=i)) for i in range(5000)]           # more rows, one an hour
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz")
    d = density(df, ["k"], "ts", "1 hour")
    assert {r.k: r.peak for r in d.collect()} == {1: 2000, 2: 1}
    cut = lambda window: {r._lg_key_k: r._lg_m for r in _granules(d, ["k"], duration_micros(window), 100).collect()}
    assert cut("1 hour") == {1: 32}
    assert cut("21 days") == {1: 1024, 2: 8}


def brute_bm25(texts, queries, k, allowed=None):
    """(query_id, doc_id, score, rank) by scoring every document."""
    import collections
    import math
    import re
    toks = lambda t: [x for x in re.split("[^a-z0-9]+", t.lower()) if x]
    docs = {i: t for i, t in ((i, toks(t)) for i, t in texts) if t}
    avg = sum(map(len, docs.values())) / len(docs)
    tfs = {i: collections.Counter(t) for i, t in docs.items()}
    df = collections.Counter(x for t in tfs.values() for x in t)
    out = []
    for q, text in queries:
        scores = []
        for i, tf in tfs.items():
            hits = [x for x in set(toks(text)) if x in tf]
            if hits and (allowed is None or i in allowed):
                scores.append((-round(sum(math.log(1 + (len(docs) - df[x] + .5) / (df[x] + .5)) * tf[x] * 2.2
                                          / (tf[x] + 1.2 * (.25 + .75 * len(docs[i]) / avg)) for x in hits), 4), i))
        out += [(q, -s, r) for r, (s, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_bm25_is_exact_however_it_is_pruned(spark):
    """Passages and questions as queries against scoring every document, with ranges of several sizes and more or fewer
    of them probed, with and without a filter of the documents."""
    from ledgerguard.plans.search_queries import QUESTIONS
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text").alias("content"))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    qs = bench.unionByName(spark.createDataFrame([(10_000 + i, q) for i, q in enumerate(QUESTIONS)] + [(20_000, "zzz qqq"), (20_001, "")],
                                                 "query_id long, text string"))
    texts, asked = ([tuple(r) for r in x.collect()] for x in (docs, qs))
    texts = [(i, t or "") for i, t in texts]
    half = docs.filter("doc_id < 100")
    want, want_half = brute_bm25(texts, asked, 5), brute_bm25(texts, asked, 5, set(range(100)))
    short = lambda df: sorted((r.query_id, round(r.score, 4), r["rank"]) for r in df.collect())

    def near(a, b):
        return len(a) == len(b) and all(x[0] == y[0] and x[2] == y[2] and abs(x[1] - y[1]) < 2e-4 for x, y in zip(a, b))
    for range_docs, probe in ((16, 1), (16, 4), (64, 2), (1000, 1)):
        index = R.write_index(docs, range_docs=range_docs)
        assert near(short(R.bm25(index, qs, k=5, probe=probe)), want), (range_docs, probe)
    assert near(short(R.bm25(R.write_index(docs, range_docs=16), qs, k=5, docs=half, probe=1)), want_half)


def test_bm25_reads_two_times_and_prunes(spark):
    """The ranges that can't reach the k-th score are not scored; statistics come from the blocks."""
    rows = [(i, "common words here " + ("rare " * 5 if i < 12 else "") + f"own{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, content string")
    index = R.write_index(docs, range_docs=100)
    q = spark.createDataFrame([(1, "rare common words")], "query_id long, text string")
    got = R.bm25(index, q, k=10, probe=1)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == list(range(10))
    assert (index.n_docs, index.total_len) == (3000, sum(len(t.split()) for _, t in rows))
    block = index.blocks.filter("term = 'rare'").collect()
    assert [(r.doc_range, r.n) for r in block] == [(0, 12)]
    path = index.postings.inputFiles()[0].rsplit("/", 1)[0].split(":", 1)[1].lstrip("/")
    # the probe is stored; what is left of the plan reads the postings once more
    assert got._jdf.queryExecution().optimizedPlan().toString().count("doc_len#") and path
    scans = got._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
    assert scans.count("tf#") <= 1


def test_index_of_nothing(spark):
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, content string")
    index = R.write_index(none)
    q = spark.createDataFrame([(1, "rare")], "query_id long, text string")
    assert index.n_docs == 0 and R.bm25(index, q).count() == 0




def test_blocks_of_vectors_return_the_best_of_each_query():
    """A block of queries and vectors returns the k best by the rounded cosine, ties by the id, and no other pair."""
    import pyarrow as pa
    rnd = random.Random(13)
    vecs = [[rnd.randrange(-3, 4) / 3 for _ in range(4)] + [1.0] for _ in range(400)]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    queries = pa.table({"query_id": list(range(50)), "qvec": vecs[:50], "qnorm": [norm(v) for v in vecs[:50]],
                        "floor": pa.array([None] * 50, pa.float64())})
    ids = rnd.sample(range(1000), 400)
    vectors = pa.table({"vec_id": ids, "vec": vecs, "norm": [norm(v) for v in vecs]})
    got = R._best(5)(queries, vectors).to_pylist()
    for i in range(50):
        cos = [(-round(sum(a * b for a, b in zip(vecs[i], v)) / (norm(vecs[i]) * norm(v)), 5), n) for v, n in zip(vecs, ids)]
        assert sorted((-round(r["cos"], 5), r["vec_id"]) for r in got if r["query_id"] == i)[:5] == sorted(cos)[:5]
    assert len(got) < 6 * 50
    odd = pa.table({"vec_id": [1, 2], "vec": [[1.0], vecs[0]], "norm": [1.0, norm(vecs[0])]})     # another length: no cosine
    assert [(r["vec_id"], r["cos"] is None) for r in R._best(5)(queries.slice(0, 1), odd).to_pylist()] == [(2, False), (1, True)]


def test_best_documents_of_a_range():
    """A range returns the k best documents of each query (by the rounded score, then by id), not a row for each that matches;
    repeated terms of a query and repeated documents count again."""
    import pyarrow as pa
    rng = random.Random(3)
    asked = [(q, f"t{rng.randrange(12)}", rng.choice([0.5, 1.25, 2.0])) for q in range(20) for _ in range(6)]
    postings = [(rng.randrange(300), f"t{rng.randrange(15)}", rng.randrange(1, 4), rng.randrange(5, 9)) for _ in range(1500)]
    a = pa.table({"query_id": [x[0] for x in asked], "term": [x[1] for x in asked], "idf": [x[2] for x in asked]})
    p = pa.table({"doc_id": [x[0] for x in postings], "term": [x[1] for x in postings], "tf": [x[2] for x in postings],
                  "doc_len": [x[3] for x in postings]})
    want = {}
    for q, t, idf in asked:
        for d, u, tf, n in postings:
            if t == u:
                part = idf * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * n / 6.5))
                want.setdefault(q, {})[d] = want.get(q, {}).get(d, 0.0) + part
    cells = R.CELLS
    try:
        for R.CELLS in (cells, 40):                        # all documents at once; a few at a time
            found = R._best_documents(5, 6.5)(a, p).to_pylist()
            for q in want:
                best = sorted((-round(s, 5), d) for d, s in want[q].items())[:5]
                mine = sorted((-round(r["score"], 5), r["doc_id"]) for r in found if r["query_id"] == q)
                assert mine[:5] == best
                assert R.CELLS < cells or len(mine) <= 10 < len(want[q])
        assert R._best_documents(5, 6.5)(a, p.slice(0, 0)).num_rows == R._best_documents(5, 6.5)(a.slice(0, 0), p).num_rows == 0
    finally:
        R.CELLS = cells
