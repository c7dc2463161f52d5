"""Policy-document search and conversation utilities (O-R1..O-R9).

The reference delegates ranking to a managed search service; here it is
rebuilt as Spark jobs:

* an inverted index of whole documents (tokenize, explode, group by (doc, term));
* per term and range of documents the document count and the largest impact, written with the index;
* BM25 range by range: the postings of a range meet the weights of the queries that it can reach, and a range returns the
  k best documents of each query, so no row for each query and document is shuffled;
* cosine similarity of blocks of queries and vectors of a cluster by products of matrices, clusters left out by their radius;
* top-k per query in two exact stages: top-k inside (query, hash bucket of
  the candidate), then top-k over the survivors.  A single query never sends
  all candidates to one task.
"""

from __future__ import annotations

import sys
import time
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerguard.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the library
c = F.col
TOKEN_SPLIT = "[^a-z0-9]+"
K1, B = 1.2, 0.75
RANGE_DOCS = 1024    # document ids of one range of the index


def tokenize(text: Column) -> Column:
    """lower-case, split on non-alphanumerics, drop empty tokens."""
    return F.array_remove(F.split(F.lower(text), TOKEN_SPLIT), "")


# a run of one token repeated, in a space-joined sorted token list ("cash cash deposits" -> "cash cash")
_RUN = r"(\b[a-z0-9]+)(?: \1\b)*"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content", first: bool = False) -> DataFrame:
    """O-R1: postings (doc_id, term, tf, doc_len) over the whole text of every document.

    A document is one row, so its term frequencies are counted inside the row: the tokens are
    sorted and space-joined, each run of one repeated token is extracted by a regular expression,
    and the run's length gives the frequency.  Built-in expressions only; the index is a map-only
    job with no shuffle of the (large) posting list.  ``first`` adds a mark of each document's first row."""
    s = F.array_sort(tokenize(c(text_col)))
    runs = (docs.select(c(id_col).alias("doc_id"), s.alias("_lg_s"))
                .select("doc_id", F.size("_lg_s").alias("doc_len"),
                        F.posexplode(F.regexp_extract_all(F.array_join("_lg_s", " "), F.lit(_RUN), 0)).alias("_lg_at", "_lg_run")))
    term = F.substring_index(c("_lg_run"), " ", 1)
    # a run is the term repeated tf times with single spaces: length + 1 = tf * (len(term) + 1)
    tf = F.expr("(length(_lg_run) + 1) div (length(substring_index(_lg_run, ' ', 1)) + 1)")
    mark = [(c("_lg_at") == 0).alias("first")] if first else []
    return runs.select("doc_id", term.alias("term"), tf.cast("bigint").alias("tf"), "doc_len", *mark)


def top_k_per_group(df: DataFrame, group_cols: list[str], score_col: str, tie_col: str, k: int,
                    buckets: int = 64) -> DataFrame:
    """Exact top-k per group in two stages (bucket by ``tie_col`` hash first)."""
    order = [c(score_col).desc(), c(tie_col).asc()]
    b = F.pmod(F.xxhash64(c(tie_col)), F.lit(buckets))
    stage1 = (df.withColumn("_lg_b", b)
                .withColumn("_lg_r", F.row_number().over(Window.partitionBy(*group_cols, "_lg_b").orderBy(*order)))
                .filter(c("_lg_r") <= k).drop("_lg_r", "_lg_b"))
    return (stage1.withColumn("rank", F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order))
                              .cast("bigint"))
                  .filter(c("rank") <= k))


class SearchIndex(NamedTuple):
    """A stored index.  ``postings``: doc_id, term, tf, doc_len, doc_range; ``blocks``: for each term and range of
    documents the number of documents (``n``) and the largest impact, the part of a score that the term's weight is
    multiplied by; ``n_docs``, ``total_len``: the corpus."""
    postings: DataFrame
    blocks: DataFrame
    n_docs: int
    total_len: int


def write_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content", range_docs: int = RANGE_DOCS) -> SearchIndex:
    """O-R1: writes the postings, and from them the blocks.  The corpus figures are observed while the postings
    are written, so that the texts are read once.  Documents are put in ranges of ``range_docs`` ids."""
    seen = Observation()
    p = (build_index(docs, id_col, text_col, first=True)
         .observe(seen, F.count_if(c("first")).alias("n_docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("total_len"))
         .select("doc_id", "term", "tf", "doc_len", F.floor(c("doc_id") / range_docs).alias("doc_range")))
    postings = cut_lineage(p)
    n_docs, total_len = seen.get["n_docs"], seen.get["total_len"]
    blocks = postings.groupBy("term", "doc_range").agg(
        F.count(F.lit(1)).alias("n"), F.max(_impact(total_len / max(n_docs, 1))).alias("impact"))
    return SearchIndex(postings, cut_lineage(blocks), n_docs, total_len)


def _impact(avg_len: float) -> Column:
    return c("tf") * (K1 + 1) / (c("tf") + K1 * (1 - B + B * c("doc_len") / F.lit(avg_len)))


QUERY_TERMS, CELLS = 1 << 20, 1 << 22     # terms of the queries that meet a range at once; impacts (term, document) held at once


def _best_documents(k: int, avg_len: float):
    """Two tables (weighted terms of queries, and postings, of one range) -> the k best documents of each query, with the
    score unrounded.  Documents whose score may be rounded either way are returned too."""
    def run(asked: pa.Table, postings: pa.Table) -> pa.Table:
        out = [], [], []
        if asked.num_rows and postings.num_rows:
            terms = asked.column("term").unique()
            term = pc.index_in(asked.column("term"), terms).to_numpy()
            queries = asked.column("query_id").unique()
            query = pc.index_in(asked.column("query_id"), queries).to_numpy()
            order = np.argsort(query, kind="stable")
            cut = np.searchsorted(query[order], np.arange(len(queries) + 1))
            idf = asked.column("idf").to_numpy()
            postings = postings.filter(pc.is_in(postings.column("term"), terms))
            row = pc.index_in(postings.column("term"), terms).to_numpy()
            tf, doc_len = (postings.column(x).to_numpy().astype("float64") for x in ("tf", "doc_len"))
            impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))
            docs, doc = np.unique(postings.column("doc_id").to_numpy(), return_inverse=True)
            width = max(1, CELLS // len(terms))
            for x in range(0, len(docs), width):
                part = (doc >= x) & (doc < x + width)
                held = np.zeros((len(terms), min(width, len(docs) - x)))
                np.add.at(held, (row[part], doc[part] - x), impact[part])
                for q in range(len(queries)):
                    mine = order[cut[q]:cut[q + 1]]
                    score = idf[mine] @ held[term[mine]]
                    hit = np.flatnonzero(score > 0)
                    step = score[hit] * 1e5 + 0.5
                    key = np.floor(step)
                    if len(hit) > k:
                        unsure = np.floor(step - 1e-6) != np.floor(step + 1e-6)
                        best = np.lexsort((hit, -key))[:k]                     # documents are in the order of their ids
                        unsure[best] = True
                        hit = hit[unsure]
                    out[0].append(np.full(len(hit), q))
                    out[1].append(docs[hit + x])
                    out[2].append(score[hit])
        found = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64))]
        ids = asked.column("query_id").unique() if asked.num_rows else asked.column("query_id").combine_chunks()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        return pa.table({"query_id": ids.take(pa.array(found[0])), "doc_id": pa.array(found[1]), "score": pa.array(found[2])})
    return run


def bm25(index: SearchIndex, queries: DataFrame, k: int = 10, docs: DataFrame | None = None, probe: int = 4) -> DataFrame:
    """O-R2 / O-R4: BM25 top-k per query.  ``queries`` = (query_id, text); ``docs`` optionally
    restricts candidates (attribute filters) by doc_id.

    Exact, with two reads of the postings however many documents match:

    * a range of documents can score at most the sum of its blocks' impacts, each times its term's weight;
    * each query's ``probe`` best ranges by that bound are scored in full, which gives a k-th score to beat;
    * of the other ranges those whose bound, rounded like the scores, reaches it are scored too (all of them, where
      the probed ones held fewer than k documents).

    The path is the same for every corpus size, and exact for every ``probe``."""
    avg_len = index.total_len / max(index.n_docs, 1)
    # small tables are written before they are joined, so that Spark knows their size and broadcasts them if it may
    qterms = cut_lineage(queries.select("query_id", F.explode(F.array_distinct(tokenize(c("text")))).alias("term")))
    hits = cut_lineage(index.blocks.join(qterms, "term"))
    df = c("df")
    weights = (hits.groupBy("query_id", "term").agg(F.sum("n").alias("df"))
               .select("query_id", "term", F.ln(F.lit(1.0) + (F.lit(index.n_docs) - df + 0.5) / (df + 0.5)).alias("idf")))
    asked = hits.join(weights, ["query_id", "term"]).select("query_id", "term", "doc_range", "idf", "impact")
    reach = asked.groupBy("query_id", "doc_range").agg(F.sum(c("idf") * c("impact")).alias("bound"))
    postings = index.postings if docs is None else index.postings.join(docs.select("doc_id"), "doc_id", "left_semi")
    blocks = max(1, -(-qterms.count() // QUERY_TERMS))     # one number, from the stored table
    types = ", ".join(f"{x} {df.schema[x].dataType.simpleString()}" for df, x in ((qterms, "query_id"), (index.postings, "doc_id")))

    def scored(ranges: DataFrame) -> DataFrame:
        wanted = cut_lineage(asked.join(ranges, ["query_id", "doc_range"]).select(
            "query_id", "term", "doc_range", "idf", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_lg_q")))
        needed = cut_lineage(wanted.select("term", "doc_range", "_lg_q").distinct())
        given = postings.join(needed, ["term", "doc_range"]).select("doc_range", "_lg_q", "doc_id", "term", "tf", "doc_len")
        scores = (wanted.groupBy("doc_range", "_lg_q").cogroup(given.groupBy("doc_range", "_lg_q"))
                  .applyInArrow(_best_documents(k, avg_len), f"{types}, score double")
                  .select("query_id", "doc_id", F.round("score", 5).alias("score")))
        return top_k_per_group(scores, ["query_id"], "score", "doc_id", k)

    probes = top_k_per_group(reach, ["query_id"], "bound", "doc_range", probe).select("query_id", "doc_range")
    probed = cut_lineage(scored(probes))
    kth = probed.filter(c("rank") == k).select(c("query_id").alias("_q"), c("score").alias("_kth"))
    # 1e-9 absorbs summation-order differences; a bound equal to the k-th score may hold a tie
    others = (reach.join(probes, ["query_id", "doc_range"], "left_anti").join(kth, c("query_id") == c("_q"), "left")
              .filter(c("_kth").isNull() | (F.round(c("bound") + 1e-9, 5) >= c("_kth"))).select("query_id", "doc_range"))
    both = probed.drop("rank").unionByName(scored(others).drop("rank"))
    return top_k_per_group(both, ["query_id"], "score", "doc_id", k)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays as double (higher-order functions, no UDF)."""
    return _dot(a, b) / (_norm(a) * _norm(b))


class VectorIndex(NamedTuple):
    """Stored vectors by cluster.  ``vectors``: vec_id, cluster, vec, norm, row (a number of its own); ``clusters``: cluster, n, unit (its pivot) and
    least_cos, the smallest cosine of a member and the pivot (the cluster's radius is its angle)."""
    vectors: DataFrame
    clusters: DataFrame


CLUSTERS = 32
BLOCK_ROWS, SCORED_ROWS = 16384, 256     # queries and vectors of a block; queries whose scores are held at once


def _units(df: DataFrame, vec: str) -> DataFrame:
    """``vec`` as doubles with ``norm`` and ``unit``; vectors that are null, empty or zero have no direction and go."""
    d = df.withColumn(vec, F.transform(vec, lambda x: x.cast("double"))).withColumn("norm", _norm(c(vec)))
    return d.filter(c("norm") > 0).withColumn("unit", F.transform(vec, lambda x: x / c("norm")))


def write_vector_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS) -> VectorIndex:
    """Puts every vector in the cluster of its nearest pivot.  The pivots are ``clusters`` vectors, those with the
    smallest hashes of their ids: a bounded sample, which decides how much a search can leave out, never its result."""
    v = _units(vectors.select(c(id_col).alias("vec_id"), c(vec_col).alias("vec")), "vec")
    pivots = cut_lineage(v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(clusters)
                         .select(F.row_number().over(Window.orderBy("vec_id")).alias("cluster"), "unit"))
    # at most ``clusters`` vectors: a scalar subquery
    every = pivots.agg(F.sort_array(F.collect_list(F.struct("cluster", "unit")))).scalar()
    near = F.array_max(F.transform(c("_lg_p"), lambda p: F.struct(_dot(c("unit"), p["unit"]).alias("cos"), (-p["cluster"]).alias("c"))))
    placed = cut_lineage(v.withColumn("_lg_p", every).withColumn("_lg_n", near)
                         .select("vec_id", (-c("_lg_n.c")).alias("cluster"), "vec", "norm", c("_lg_n.cos").alias("cos"),
                                 F.monotonically_increasing_id().alias("row")))
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("least_cos"))
    return VectorIndex(placed.drop("cos"), cut_lineage(pivots.join(sizes, "cluster")))


def _angle(cos: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def _bounds(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """query_id, cluster, n, bound: the largest cosine that a query can have with a cluster's vectors, as angles
    obey the triangle inequality."""
    all_clusters = index.clusters.agg(F.collect_list(F.struct("cluster", "n", "unit", "least_cos"))).scalar()
    apart = _angle(_dot(c("unit"), c("_lg_x.unit"))) - _angle(c("_lg_x.least_cos"))
    return (queries.select("query_id", "unit", F.explode(all_clusters).alias("_lg_x"))
            .select("query_id", "_lg_x.cluster", "_lg_x.n", F.cos(F.greatest(apart, F.lit(0.0))).alias("bound")))


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows padded with zeros to the longest, lengths) of an array of lists."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out, sizes


def _best(k: int):
    """Two tables (queries and vectors of one cluster) -> the k best vectors of each query in it, with the cosine.

    A product of matrices leaves the vectors that may be among the k best once cosines are rounded to 5 digits; theirs
    are computed anew, component by component, and returned unrounded."""
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        def column(t, name):
            x = t.column(name).combine_chunks()
            return x.chunk(0) if isinstance(x, pa.ChunkedArray) else x

        rows, cols, cos = [], [], []
        if queries.num_rows and vectors.num_rows:
            (q, q_size), (v, v_size) = _matrix(column(queries, "qvec")), _matrix(column(vectors, "vec"))
            width = max(q.shape[1], v.shape[1])
            q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
            q_norm, v_norm = column(queries, "qnorm").to_numpy(), column(vectors, "norm").to_numpy()
            floor = column(queries, "floor").to_numpy(zero_copy_only=False).astype("float64")
            floor = np.where(np.isnan(floor), -np.inf, floor)
            ids = pc.rank(column(vectors, "vec_id"), "ascending", null_placement="at_start").to_numpy().astype(np.int64)
            for x in range(0, len(q), SCORED_ROWS):
                part = slice(x, x + SCORED_ROWS)
                with np.errstate(all="ignore"):
                    near = (q[part] @ v.T) / (q_norm[part, None] * v_norm)
                near[np.isnan(near)] = np.inf                                 # NaN is the largest in Spark's order
                near[q_size[part, None] != v_size] = -np.inf                  # null is the smallest
                least = floor[part]
                if (near >= least[:, None] - 2e-5).sum() > 8 * k * len(near) and len(v) > k:
                    least = np.maximum(least, np.partition(near, len(v) - k, axis=1)[:, len(v) - k])
                a, b = np.nonzero(near >= least[:, None] - 2e-5)
                a += x
                exact = np.zeros(len(a))
                with np.errstate(all="ignore"):
                    for i in range(width):
                        exact += v[b, i] * q[a, i]
                    exact /= v_norm[b] * q_norm[a]
                null = q_size[a] != v_size[b]
                step = np.where(null, -np.inf, np.where(np.isnan(exact), np.inf, exact * 1e5 + 0.5))
                key = np.floor(step)
                unsure = np.floor(step - 1e-6) != np.floor(step + 1e-6)       # may be rounded either way
                order = np.lexsort((ids[b], -key, unsure, a))
                group = a[order] * 2 + unsure[order]
                start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(order) else np.zeros(0, np.int64)
                place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
                keep = order[(place < k) | unsure[order]]
                rows.append(a[keep])
                cols.append(b[keep])
                cos.append(pa.array(exact[keep], mask=null[keep]))
        rows, cols = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (rows, cols))
        return pa.table({"query_id": queries.column("query_id").take(rows), "vec_id": vectors.column("vec_id").take(cols),
                         "cos": pa.chunked_array(cos, pa.float64())})
    return run


def _scored(index: VectorIndex, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The top k of each query among the clusters of its pairs (query_id, cluster, floor: a score to reach, or null).
    Queries and vectors of a cluster meet in blocks of about ``BLOCK_ROWS``; a block returns the k best of each query."""
    pairs = cut_lineage(pairs)
    blocks = (pairs.groupBy("cluster").agg(F.count(F.lit(1)).alias("_lg_n")).join(index.clusters, "cluster")
              .select("cluster", F.ceil(c("_lg_n") / BLOCK_ROWS).alias("_lg_qs"), F.ceil(c("n") / BLOCK_ROWS).alias("_lg_vs")))
    dealt = lambda n: F.pmod(F.xxhash64("row"), c(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), c(n) - 1))
    asked = pairs.join(queries, "query_id").join(blocks, "cluster").select(
        "cluster", dealt("_lg_qs").alias("_lg_q"), every("_lg_vs").alias("_lg_v"), "query_id", "qvec", c("norm").alias("qnorm"), "floor")
    given = index.vectors.join(blocks, "cluster").select(
        "cluster", every("_lg_qs").alias("_lg_q"), dealt("_lg_vs").alias("_lg_v"), "vec_id", "vec", "norm")
    key = ["cluster", "_lg_q", "_lg_v"]
    query_type, id_type = (df.schema[x].dataType.simpleString() for df, x in ((queries, "query_id"), (index.vectors, "vec_id")))
    scores = (asked.groupBy(*key).cogroup(given.groupBy(*key))
              .applyInArrow(_best(k), f"query_id {query_type}, vec_id {id_type}, cos double")
              .select("query_id", "vec_id", F.round("cos", 5).alias("score")))
    return top_k_per_group(scores, ["query_id"], "score", "vec_id", k)


def vector_search(index: VectorIndex, queries: DataFrame, k: int = 10, probe: int = 2, pairs: list | None = None) -> DataFrame:
    """O-R3: exact cosine top-k per query.  ``queries`` = (query_id, qvec), any number; the plan is the same for all.

    Each query's ``probe`` nearest clusters are scored first, which gives a k-th score to beat; of the other clusters
    only those are scored whose bound, rounded like the scores, reaches it (all, where the probed ones held fewer than k
    vectors).  Exact for every ``probe`` and every clustering.  ``pairs``, if given, gets the two frames
    (query_id, cluster, n) of what is scored."""
    q = cut_lineage(_units(queries.select("query_id", "qvec"), "qvec").withColumn("row", F.monotonically_increasing_id()))
    reach = cut_lineage(_bounds(index, q))
    probes = top_k_per_group(reach, ["query_id"], "bound", "cluster", probe).select("query_id", "cluster", "n")
    probed = cut_lineage(_scored(index, q, probes.select("query_id", "cluster", F.lit(None).cast("double").alias("floor")), k))
    kth = probed.filter(c("rank") == k).select(c("query_id").alias("_q"), c("score").alias("_kth"))
    # 1e-7 absorbs the rounding of the angles; a bound equal to the k-th score may hold a tie
    others = (reach.join(probes, ["query_id", "cluster"], "left_anti").join(kth, c("query_id") == c("_q"), "left")
              .filter(c("_kth").isNull() | (F.round(c("bound") + 1e-7, 5) >= c("_kth"))).select("query_id", "cluster", "n", c("_kth").alias("floor")))
    if pairs is not None:
        pairs += [probes, others.drop("floor")]
    both = probed.drop("rank").unionByName(_scored(index, q, others.drop("n"), k).drop("rank"))
    return top_k_per_group(both, ["query_id"], "score", "vec_id", k)


def label_centroids(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label (element-wise), as query vectors derived from the data."""
    exploded = vectors.select(label_col, F.posexplode(vec_col).alias("i", "x"))
    means = exploded.groupBy(label_col, "i").agg(F.avg(c("x").cast("double")).alias("m"))
    return (means.groupBy(label_col)
                 .agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s"))
                 .select(c(label_col).alias("query_id"), F.transform("s", lambda e: e["m"]).alias("qvec")))


def doc_tags(docs: DataFrame) -> DataFrame:
    """O-R5: documents per tag."""
    return docs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n_docs"))


def doc_snippets(docs: DataFrame, n: int = 5, chars: int = 200) -> DataFrame:
    """O-R6: title + first characters of the first documents (a bounded preview list)."""
    return (docs.orderBy("doc_id").limit(n)
                .select("doc_id", F.concat(c("title"), F.lit(": "), F.left(c("content"), F.lit(chars))).alias("snippet")))


def conversation_pairs(conv: DataFrame, rows_per_range: int = 1024) -> DataFrame:
    """O-R7: a user turn whose next turn in the conversation, gaps and repeats included, is the
    assistant's.  Turns are ordered by (turn, role, text).

    A conversation is cut into ranges of turn numbers, and the next turn is found by a window over one
    range; the last turn of a range takes the first one of the next range that has any (one row for each
    range), so a very long conversation is not one task's window.
    """
    t = conv.select("conv_id", "turn", "role", "text", F.floor(c("turn") / rows_per_range).alias("_r"))
    turn = F.struct("turn", "role", "text")
    starts = (t.groupBy("conv_id", "_r").agg(F.min(turn).alias("_start"))
              .withColumn("_after", F.lead("_start").over(Window.partitionBy("conv_id").orderBy("_r"))))
    after = starts.select(c("conv_id").alias("_c"), c("_r").alias("_q"), "_after")
    inside = t.withColumn("_next", F.lead(turn).over(Window.partitionBy("conv_id", "_r").orderBy("turn", "role", "text")))
    nxt = F.coalesce("_next", "_after")
    return (inside.filter(c("role") == "user").join(after, c("conv_id").eqNullSafe(c("_c")) & c("_r").eqNullSafe(c("_q")))
            .filter(nxt["role"] == "assistant")
            .select("conv_id", c("turn").alias("user_turn"), c("text").alias("question"), nxt["text"].alias("answer")))


def newest_first(pairs: DataFrame, rows_per_range: int = 1024) -> DataFrame:
    """O-R7: the exchanges with ``nth``, their place in the conversation when the newest comes first (equal turns by
    question and answer).  Exchanges are numbered inside ranges of turn numbers and moved by the sizes of the later
    ranges, so a very long conversation is not one task's window."""
    t = pairs.withColumn("_r", F.floor(c("user_turn") / rows_per_range))
    inside = F.row_number().over(Window.partitionBy("conv_id", "_r").orderBy(c("user_turn").desc(), "question", "answer"))
    later = Window.partitionBy("conv_id").orderBy(c("_r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (t.groupBy("conv_id", "_r").agg(F.count(F.lit(1)).alias("_n"))
             .select(c("conv_id").alias("_c"), c("_r").alias("_q"), F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later")))
    return (t.withColumn("_i", inside).join(sizes, c("conv_id").eqNullSafe(c("_c")) & c("_r").eqNullSafe(c("_q")))
            .select("conv_id", "user_turn", "question", "answer", (c("_i") + c("_later")).cast("bigint").alias("nth")))


def conversation_summary(pairs: DataFrame) -> DataFrame:
    """Exchange count and newest exchange per conversation."""
    return pairs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("exchanges"),
                                        F.max("user_turn").alias("newest_turn"))


RESPONSE_SCHEMA = "struct<content: array<struct<type: string, text: string, name: string>>>"


def agent_log_extract(responses: DataFrame, id_col: str = "response_id", json_col: str = "body") -> DataFrame:
    """O-R8: from saved JSON responses keep the longest text part and the distinct tool names."""
    parsed = responses.select(c(id_col).alias("response_id"),
                              F.from_json(c(json_col), RESPONSE_SCHEMA).alias("r"))
    parts = parsed.select("response_id", F.explode("r.content").alias("p"))
    return parts.groupBy("response_id").agg(
        F.max_by(c("p.text"), F.struct(F.length(c("p.text")), c("p.text"))).alias("answer"),
        F.array_join(F.array_sort(F.collect_set(F.when(c("p.type") == "tool_use", c("p.name")))), ",")
        .alias("tools"))


def run_summary(questions: DataFrame, results: DataFrame) -> DataFrame:
    """O-R9: per question of the run, those without hits included: hits, best score, passed (has a hit)."""
    found = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best_score"))
    return (questions.select("query_id").distinct().join(found, "query_id", "left")
            .select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), "best_score",
                    F.coalesce(c("hits") > 0, F.lit(False)).alias("passed")))


def run_report(index: SearchIndex, questions: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """O-R9: a whole run.  The questions are answered as one batch; (per question: hits, best score, passed and the seconds of
    the batch that answered it; totals: asked, passed, failed, seconds)."""
    began = time.perf_counter()
    results = cut_lineage(bm25(index, questions, k))
    seconds = F.lit(round(time.perf_counter() - began, 3))
    each = cut_lineage(run_summary(questions, results).withColumn("latency_seconds", seconds))
    totals = each.agg(F.count(F.lit(1)).alias("asked"), F.count_if("passed").alias("passed"),
                      F.count_if(~c("passed")).alias("failed"), F.max("latency_seconds").alias("seconds"))
    return each, totals
