"""Operator 7, benchmark passages in documents by SimHash windows (built-in functions only).

Texts are cut into lower-cased words and five-word shingles.  A shingle of the benchmark weighs
1 + floor(log2(items / items that hold it)); any other weighs the most.  Windows have an item's number of
words (fewer at a text's end) and start at a shingle of that item; one whose benchmark shingles are fewer
than 0.8 of all cannot reach a weighted similarity of 0.8 and is left out, and moving a window's start to
the first shingle of its item never lowers its similarity, so no passage is lost.  So a window only meets items that
have its first shingle: with blocks of four bits alone, two thirds of all windows and items would meet.  Fingerprints have 64
bits, one for each sign of the weighted sum over the window's benchmark shingles, which is the difference of two running
sums over the document: no window is written out shingle by shingle before it has met an item.  With ``RADIUS`` + 1
blocks of bits, two fingerprints within ``RADIUS`` agree in one block, so a join on (window size, first
shingle, block, bits) finds all of them.  Candidates are verified by the exact weighted Jaccard similarity of the bags of
shingles.

Only shingles that the benchmark holds leave a document's row.  The benchmark's shingle table is joined
without a hint: Spark broadcasts it if it is small and shuffles otherwise.

Defined cases: null or empty texts have no words; items of fewer than five words are too short to be
evidence and match nothing; a text of any length is read whole; of a document's windows that are equally similar to
an item the one of smaller distance is reported, then the earlier; rows repeated with id and text are reported once; a null id, of a document or an
item, is one like any other; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerguard.llm.common import SHINGLE_WORDS, SIMILARITY, SPACES, fresh, row_key, stored, texts

RADIUS, BITS = 15, 64
#: A document's row; doc_id is 0 where there is none, so that plain joins keep it.
KEY = ["doc_id", "no_id", "row_key"]


def _shingled(d: DataFrame) -> DataFrame:
    """d with n_words and h, the hashes of its shingles in order."""
    d = d.withColumn("_t", F.btrim(F.lower("text"), F.lit(" \t\n\x0b\x0c\r")))
    d = d.withColumn("_w", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", SPACES)))
    d = d.withColumn("_x", F.transform("_w", lambda w: F.xxhash64(w)))
    parts = ", ".join(["x", *[f"get(_x, i + {j})" for j in range(1, SHINGLE_WORDS)]])
    d = d.withColumn("n_words", F.size("_w")).withColumn("h", F.expr(
        f"slice(transform(_x, (x, i) -> xxhash64({parts})), 1, greatest(size(_x) - {SHINGLE_WORDS - 1}, 0))"))
    return d.drop("_t", "_w", "_x")


LANES = [f"l{j}" for j in range(BITS // 2)]


def _lane(j: int) -> Column:
    """The weight w of a shingle h at a pair of its bits: two counters of 32 bits in one number."""
    bit = lambda b: F.shiftright("h", b).bitwiseAND(F.lit(1)) * F.col("w")
    return bit(2 * j) + F.shiftleft(bit(2 * j + 1), 32)


def _signs() -> Column:
    """The sign bits of weighted sums: ``LANES`` and their ``weight``."""
    fp = F.lit(0).cast("long")
    for j, name in enumerate(LANES):
        for b, lane in ((2 * j, F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))), (2 * j + 1, F.shiftright(name, 32))):
            fp = fp.bitwiseOR(F.when(2 * lane > F.col("weight"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return fp


def _fingerprint(d: DataFrame, *keys) -> DataFrame:
    """(keys, weight, fp): the sign bits of the weighted sums over the rows (h, w) of a key."""
    s = d.groupBy(*keys).agg(F.sum("w").alias("weight"), *[F.sum(_lane(j)).alias(name) for j, name in enumerate(LANES)])
    return s.select(*keys, "weight", _signs().alias("fp"))


def _windows(seeds: DataFrame, similarity: float) -> DataFrame:
    """(KEY, m, p, start, size, window_weight, fp): the windows that begin at a benchmark shingle and have enough of them.

    Sums run over a document's shingles in order, and a window's sum is what they have grown by between its ends: a window
    is two rows, however many words it has.  The rows are dealt by document to the session's number of partitions, as few bytes
    of them give many windows, and stay so."""
    n = max(1, int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    seeds, own = seeds.repartition(n, *KEY), Window.partitionBy(*KEY)
    last = F.expr(f"p + m - {SHINGLE_WORDS}")
    # a row of m = 0 for each shingle, and one for each window at the place of its last possible shingle
    ends = (seeds.withColumn("before", F.row_number().over(own.orderBy("pos")) - 1).withColumnRenamed("pos", "p")
            .withColumn("m", F.explode(F.concat(F.array(F.lit(0)), "sizes")))
            .withColumn("at", F.when(F.col("m") > 0, last).otherwise(F.col("p"))))
    ends = (ends.withColumn("places", F.sum(F.when(F.col("m") == 0, 1).otherwise(0)).over(own.orderBy("at", "m").rowsBetween(
                Window.unboundedPreceding, Window.currentRow)) - F.col("before"))
            .withColumn("size", F.expr("least(m, n_words - p)"))
            .filter(F.expr(f"m = 0 or places >= ceil({similarity} * (size - {SHINGLE_WORDS - 1}))")))
    # side: -1 before a window's first shingle, 1 after its last one, 0 a shingle
    sides = ends.withColumn("side", F.explode(F.when(F.col("m") > 0, F.array(F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(0)))))
    sides = sides.withColumn("at", F.when(F.col("side") < 0, F.col("p")).otherwise(F.col("at")))
    run = own.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = lambda x: F.sum(F.when(F.col("side") == 0, x).otherwise(0)).over(run)
    sides = sides.select(*KEY, "m", "p", F.col("h").alias("start"), "size", "top", "places", "side", grown(F.col("w")).alias("weight"),
                         *[grown(_lane(j)).alias(name) for j, name in enumerate(LANES)]).filter("side <> 0")
    sums = sides.groupBy(*KEY, "m", "p", "start", "size", "top", "places").agg(
        *[F.sum(F.col("side") * F.col(c)).alias(c) for c in ("weight", *LANES)])
    return sums.select(*KEY, "m", "p", "start", "size", _signs().alias("fp"), (F.col("weight") + F.col("top") * (
        F.col("size") - (SHINGLE_WORDS - 1) - F.col("places"))).alias("window_weight"))


def _blocks(d: DataFrame, fp: str) -> DataFrame:
    """A row for each block of the fingerprint: its number and bits."""
    cut = [b * BITS // (RADIUS + 1) for b in range(RADIUS + 2)]
    parts = [F.struct(F.lit(i).alias("block"), F.shiftright(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
             for i, (a, b) in enumerate(zip(cut, cut[1:]))]
    return d.withColumn("_b", F.explode(F.array(*parts))).select("*", "_b.block", "_b.bits").drop("_b")


def met(windows: DataFrame, starts: DataFrame) -> DataFrame:
    """The windows beside the items that hold their first shingle and agree with them in a block."""
    return _blocks(windows, "fp").join(_blocks(starts, "item_fp"), ["m", "start", "block", "bits"])


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, row_key, item_id, start_word, n_words, hamming, similarity: the best window of every
    document and item that reach the similarity."""
    # item_id in a struct: equal even if null
    items = stored(_shingled(benchmark.select(F.struct("item_id").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
                             .distinct()).select("item_id", F.col("n_words").alias("m"), "h")).filter(F.size("h") > 0)
    bag = stored(items.select("item_id", "m", F.explode("h").alias("h"))
                 .groupBy("item_id", "m", "h").agg(F.count(F.lit(1)).alias("c")))
    n_items = items.select(F.countDistinct("item_id").alias("n")).scalar()
    top = F.lit(1) + F.floor(F.log2(n_items)).cast("long")
    known = stored(bag.groupBy(F.col("h").alias("bh")).agg(
        (F.lit(1) + F.floor(F.log2(n_items / F.countDistinct("item_id"))).cast("long")).alias("w"),
        F.collect_set("m").alias("sizes")).withColumn("top", top))
    item_rows = bag.join(known, F.col("h") == F.col("bh")).select("item_id", "m", "h", "c", "w")
    item_fp = _fingerprint(item_rows.withColumn("w", F.col("w") * F.col("c")), "item_id", "m").withColumnsRenamed(
        {"weight": "item_weight", "fp": "item_fp"})

    d = texts(docs).withColumn("row_key", row_key()).withColumn("no_id", F.col("doc_id").isNull())
    d = _shingled(d.withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long"))))
    # outer: the filter that Spark infers for an inner one would compute h a second time, in each place
    seeds = stored(d.select(*KEY, "n_words", F.posexplode_outer("h").alias("pos", "h")).join(known, F.col("h") == F.col("bh"))
                   .select(*KEY, "n_words", "pos", "h", "w", "sizes", "top").distinct())
    fp, window = _windows(seeds, similarity), [*KEY, "m", "p"]
    starts = item_fp.join(bag.select("item_id", "m", F.col("h").alias("start")), ["item_id", "m"])
    near = (met(fp, starts).select(*window, "size", "window_weight", "item_id", "item_weight", F.bit_count(
                F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("hamming"))
            .filter(F.col("hamming") <= RADIUS).distinct())
    pair = ["item_id", *window, "size", "window_weight", "item_weight", "hamming"]
    common = (near.select(*pair, F.explode(F.expr(f"sequence(p, p + size - {SHINGLE_WORDS})")).alias("pos"))
              .join(seeds.select(*KEY, "pos", "h", "w"), [*KEY, "pos"])
              .join(bag.select("item_id", "m", "h", F.col("c").alias("ic")), ["item_id", "m", "h"])
              .groupBy(*pair, "h", "w", "ic").agg(F.count(F.lit(1)).alias("c"))
              .groupBy(*pair).agg(F.sum(F.col("w") * F.least("c", "ic")).alias("common")))
    found = common.withColumn("similarity", F.col("common") / (F.col("window_weight") + F.col("item_weight") - F.col("common")))
    best = (found.filter(F.col("similarity") >= similarity).groupBy(*KEY, "item_id")
            .agg(F.max(F.struct("similarity", (-F.col("hamming")).alias("d"), (-F.col("p")).alias("p"), "size")).alias("b")))
    return best.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "row_key", "item_id.item_id", (-F.col("b.p")).cast("long").alias("start_word"), F.col("b.size").cast("long").alias("n_words"),
                       (-F.col("b.d")).cast("long").alias("hamming"), F.col("b.similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline form: the documents that hold no benchmark passage."""
    d_, k_ = fresh(docs, "_d", "_k")
    found = stored(contaminated(docs, benchmark).select(F.col("doc_id").alias(d_), F.col("row_key").alias(k_)).distinct())
    key = F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col(d_)) & (key == F.col(k_)), "left_anti")
