"""Operator 2, near duplicates by a join on signature coordinates.

Every text's set of word shingles gets a signature of ``COORDINATES`` minima.  Texts with the same set
form one class.  Classes are posted under their (coordinate, value) pairs; a pair of classes is a
candidate if at least ``matches`` of its coordinates collide.  Prefix: with values ordered from rare to
common over the whole corpus, such a pair shares one of the first ``COORDINATES - matches + 1`` values of
both, so only these are posted, and values held by one class only are never posted but fill the prefix.
Skip: a list is not expanded into pairs.  Its members are compared with its most central member first;
members that are in one component already are skipped; the rest of a list is resolved by an exact prefix
join of the full shingle sets, between components only.  Every link is confirmed on full sets.

Needed collisions lie 4.2 standard deviations below the mean of a pair at the threshold (18 of 32 at 0.85,
16 at 0.8), so such a link is missed about once in 10,000 times, and a closer one more rarely still.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing;
repeated rows share a class and a component; a null doc_id counts as no smallest id; an empty table
gives an empty result; other columns are ignored.  The pipeline form decides for each row by (doc_id, hash of
the text): the first with null ids last stays, and one of its repeated rows.
"""

from __future__ import annotations

from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import fresh, releasing, row_key, stored, texts
from ledgerguard.llm.graph import components
from ledgerguard.llm.shingles import mix, shingle_sets

COORDINATES = 32
_SEEDS = np.random.default_rng(7).integers(0, 1 << 63, (COORDINATES, 2), dtype=np.uint64) | np.uint64(1)


def matches(percent: int) -> int:
    """Collisions that a candidate needs."""
    p = percent / 100
    return max(1, floor(COORDINATES * p - 4.2 * (COORDINATES * p * (1 - p)) ** 0.5))


def _class_ids(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits that equal sets share: a sum and an exclusive or of their members' hashes."""
    out: list[bytes | None] = []
    for s in sets:
        if len(s):
            x = mix(s ^ np.uint64(0x5851F42D4C957F2D))
            out.append(np.array([x.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(x))], np.uint64).tobytes())
        else:
            out.append(None)
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows: the minima of the (non-empty) sets under each coordinate's hash."""
    members = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for j, (flip, step) in enumerate(_SEEDS):
        x = (members ^ flip) * step
        x ^= x >> np.uint64(32)
        out[:, j] = np.minimum.reduceat(x * step, at)
    return out


def signatures(docs: DataFrame, shingle_words: int, rows: bool = False) -> DataFrame:
    """doc_id, row_key (if ``rows``), n_shingles, cls (id of the set; null if empty), sig."""
    own = ["doc_id", "row_key"] if rows else ["doc_id"]

    @releasing
    def run(batches):
        for batch in batches:
            for row, sets in shingle_sets(batch.column("text"), shingle_words):
                full = [s for s in sets if len(s)]
                sig = _signatures(full).view(np.int64) if full else np.zeros((0, COORDINATES), np.int64)
                sizes = np.array([len(s) for s in sets])
                at = np.concatenate([[0], np.cumsum((sizes > 0) * COORDINATES)]).astype(np.int32)
                yield pa.record_batch([*[batch.column(c).slice(row, len(sets)) for c in own], pa.array(sizes, pa.int64()),
                                       pa.array(_class_ids(sets), pa.binary()),
                                       pa.ListArray.from_arrays(at, pa.array(sig.ravel(), pa.int64()))],
                                      names=[*own, "n_shingles", "cls", "sig"])

    d = texts(docs).withColumn("row_key", row_key()) if rows else texts(docs)
    return d.mapInArrow(run, ", ".join(f"{c} long" for c in own) + ", n_shingles long, cls binary, sig array<long>")


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """(cls, n, shingles) of the wanted classes: their first documents are read again."""
    @releasing
    def run(batches):
        for batch in batches:
            for _, sets in shingle_sets(batch.column("text"), shingle_words):
                at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.record_batch([pa.array(_class_ids(sets), pa.binary()),
                                       pa.ListArray.from_arrays(at, pa.array(flat, pa.int64()))],
                                      names=["cls", "shingles"])

    t = texts(docs)
    w = wanted.select(F.col("first").alias("_first")).distinct()
    read = t.join(w, t["doc_id"].eqNullSafe(w["_first"]), "left_semi").mapInArrow(
        run, "cls binary, shingles array<long>")
    # an id may have several texts: only the wanted classes, one row each
    c = wanted.select(F.col("cls").alias("_cls")).distinct()
    return (read.join(c, read["cls"] == c["_cls"], "left_semi")
            .groupBy("cls").agg(F.any_value("shingles").alias("shingles"))
            .withColumn("n", F.size("shingles")))


def postings(classes: DataFrame, needed: int) -> DataFrame:
    """(coord, value, cls, central): the prefix postings of lists with at least two members."""
    all_ = classes.select("cls", F.posexplode("sig").alias("coord", "value"))
    common = (all_.groupBy("coord", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
              .withColumnsRenamed({"coord": "_c", "value": "_v"}))
    shared = (all_.join(common, (F.col("coord") == F.col("_c")) & (F.col("value") == F.col("_v")))
              .groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("n", "coord", "value"))).alias("l")))
    room = F.greatest(F.lit(1 - needed) + F.size("l"), F.lit(0))  # singletons fill the prefix first
    prefix = (shared.filter(room > 0)
              .select("cls", F.aggregate("l", F.lit(0.0), lambda s, x: s + F.log(x["n"])).alias("central"),
                      F.explode(F.slice("l", F.lit(1), room)).alias("x"))
              .select("cls", "central", "x.coord", "x.value"))
    prefix = stored(prefix)
    lists = prefix.groupBy(F.col("coord").alias("_c"), F.col("value").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("cls", F.struct("central", "cls")).alias("hub")).filter("_n > 1")
    return prefix.join(lists, (F.col("coord") == F.col("_c")) & (F.col("value") == F.col("_v"))).drop("_c", "_v", "_n")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    x = sets.select(F.col("cls").alias("_a"), F.col("shingles").alias("_x"), F.col("n").alias("_nx"))
    y = sets.select(F.col("cls").alias("_b"), F.col("shingles").alias("_y"), F.col("n").alias("_ny"))
    both = (pairs.join(x, F.col("a") == F.col("_a")).join(y, F.col("b") == F.col("_b"))
            .filter(100 * F.least("_nx", "_ny") >= percent * F.greatest("_nx", "_ny"))
            .withColumn("_i", F.size(F.array_intersect("_x", "_y"))))
    return both.filter(100 * F.col("_i") >= percent * (F.col("_nx") + F.col("_ny") - F.col("_i"))).select("a", "b")


def _colliding(pairs: DataFrame, classes: DataFrame, needed: int) -> DataFrame:
    """The pairs with enough equal coordinates."""
    x = classes.select(F.col("cls").alias("_a"), F.col("sig").alias("_x"))
    y = classes.select(F.col("cls").alias("_b"), F.col("sig").alias("_y"))
    same = F.size(F.filter(F.zip_with("_x", "_y", lambda p, q: p == q), lambda t: t))
    return (pairs.join(x, F.col("a") == F.col("_a")).join(y, F.col("b") == F.col("_b"))
            .filter(same >= needed).select("a", "b"))


def _rest(posted: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs between components that share a list: an exact prefix join of their sets.

    A set's prefix are its rarest shingles, so many that two linked sets share one.  In a shingle's list
    only members outside the list's largest component are paired, and only where the members' private
    shingles (held by no other open set) leave room for the needed intersection.
    """
    member = (posted.join(labels, posted["cls"] == labels["node"], "left")
              .select("coord", "value", "cls", F.coalesce("component", "cls").alias("comp")))
    open_ = (member.groupBy("coord", "value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .filter("lo < hi").select(F.col("coord").alias("_c"), F.col("value").alias("_v")))
    classes = (member.join(open_, (F.col("coord") == F.col("_c")) & (F.col("value") == F.col("_v")), "left_semi")
               .select("cls", "comp").distinct())
    sets_ = stored(sets.join(classes.withColumnRenamed("cls", "_k"), F.col("cls") == F.col("_k")).drop("_k"))
    held = sets_.select("cls", F.explode("shingles").alias("s"))
    freq = held.groupBy("s").agg(F.count(F.lit(1)).alias("f")).filter("f > 1").withColumnRenamed("s", "_s")
    ranked = (held.join(freq, F.col("s") == F.col("_s")).groupBy("cls")
              .agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("l")))
    ranked = ranked.join(sets_.select(F.col("cls").alias("_k"), "comp", "n"), F.col("cls") == F.col("_k")).drop("_k")
    # floor(n * (1 - p)) + 1 shingles; private ones come first and fill it
    room = F.greatest(F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1 - (F.col("n") - F.size("l")), F.lit(0))
    post = stored(ranked.filter(room > 0)
                  .withColumn("prefix", F.transform(F.slice("l", F.lit(1), room), lambda x: x["s"]))
                  .select("cls", "comp", "n", F.size("l").alias("open"), "prefix", F.posexplode("prefix").alias("i", "s")))
    largest = (post.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("k"))
               .groupBy(F.col("s").alias("_s")).agg(F.max_by("comp", F.struct("k", "comp")).alias("_big"),
                                                    F.count(F.lit(1)).alias("_m")).filter("_m > 1"))
    out = (post.join(largest, F.col("s") == F.col("_s")).filter(F.col("comp") != F.col("_big"))
           .select(F.col("s").alias("_s"), F.col("cls").alias("a"), F.col("comp").alias("_ca"), F.col("n").alias("_na"),
                   F.col("open").alias("_oa"), F.col("prefix").alias("_pa"), F.col("i").alias("_ia")))
    # a pair comes from its first common shingle only, and shares nothing before it: what follows must do
    first = F.get(F.array_intersect("_pa", "prefix"), F.lit(0)) == F.col("s")
    room_left = F.least(F.col("_oa") - F.col("_ia"), F.col("open") - F.col("i"))
    return (out.join(post, (F.col("_s") == F.col("s")) & (F.col("_ca") != F.col("comp"))
                     & ((100 + percent) * room_left >= percent * (F.col("_na") + F.col("n"))) & first)
            .select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct())


def _labelled(docs: DataFrame, shingle_words: int, percent: int, rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """The signatures, and (cls, first, comp) of the classes: first is the smallest doc_id; if ``rows``, best
    is the first row with null ids last."""
    sig = stored(signatures(docs, shingle_words, rows))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    best = {"best": F.min(row)} if rows else {}
    classes = stored(sig.filter(F.col("cls").isNotNull()).groupBy("cls")
                     .agg(F.min("doc_id").alias("first"), *[v.alias(k) for k, v in best.items()], F.any_value("sig").alias("sig")))
    posted = stored(postings(classes, matches(percent)))
    chosen = posted.select("cls").distinct().withColumnRenamed("cls", "_k")
    sets = stored(_sets_of(docs, classes.join(chosen, F.col("cls") == F.col("_k"), "left_semi"), shingle_words))
    pairs = (posted.filter(F.col("cls") != F.col("hub"))
             .select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct())
    links = stored(_confirmed(_colliding(pairs, classes, matches(percent)), sets, percent))
    labels = components(links)
    more = stored(_confirmed(_rest(posted, labels, sets, percent), sets, percent))
    if not more.isEmpty():
        labels = components(links.union(more))
    return sig, classes.join(labels, F.col("cls") == F.col("node"), "left").select(
        "cls", "first", *best, F.coalesce("component", "cls").alias("comp"))


def near_duplicates(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id)."""
    sig, named = _labelled(docs, shingle_words, percent)
    smallest = named.groupBy(F.col("comp").alias("_comp")).agg(F.min("first").alias("component_id"))
    of = named.join(smallest, F.col("comp") == F.col("_comp")).select(F.col("cls").alias("_cls"), "component_id")
    out = sig.select("doc_id", "n_shingles", "cls").join(of, F.col("cls") == F.col("_cls"), "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return (out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select("doc_id", "n_shingles", "component_id", "kept"))


def one_of_each(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Pipeline form: the documents without the rows that are near copies of a kept one."""
    sig, named = _labelled(docs, shingle_words, percent, rows=True)
    best = named.groupBy(F.col("comp").alias("_comp")).agg(F.min("best").alias("_best"))
    of = named.join(best, F.col("comp") == F.col("_comp")).select(F.col("cls").alias("_cls"), "_best")
    rows = sig.select("doc_id", "row_key", "cls").join(of, F.col("cls") == F.col("_cls"))
    kept = F.col("doc_id").eqNullSafe(F.col("_best.doc_id")) & (F.col("row_key") == F.col("_best.row_key"))
    # one row for each that goes or is there again
    d_, k_, kept_, n_, row_ = fresh(docs, "_d", "_k", "_kept", "_n", "_row")
    decided = stored(rows.groupBy(F.col("doc_id").alias(d_), F.col("row_key").alias(k_))
                     .agg(F.bool_and(kept).alias(kept_), F.count(F.lit(1)).alias(n_)).filter(~F.col(kept_) | (F.col(n_) > 1)))
    key = F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(d_)) & (key == F.col(k_))
    out = docs.join(decided, same, "left_anti")
    again = decided.filter(F.col(kept_))
    if again.isEmpty():
        return out
    # of repeated rows the first one by a stored number
    copies = stored(docs.join(again, same).drop(kept_, n_).withColumn(row_, F.monotonically_increasing_id()))
    first = copies.groupBy(d_, k_).agg(F.min(row_).alias(row_)).select(row_)
    return out.union(copies.join(first, row_, "left_semi").select(*docs.columns))
