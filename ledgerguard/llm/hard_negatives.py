"""Operator 13, hard negatives of anchors by BOND: vertical scans of vectors kept by dimension.

Vectors are whole numbers (256 times each component, rounded down); the score of two rows is their inner product.
Rows are dealt into slices, anchors into groups, both of bounded size, and every slice meets every group once, in a
task that holds both: a slice's dimensions as columns with each column's least and largest number.  For one anchor
the columns are read in descending order of the anchor's magnitude.  After each ``STEP`` columns a row's score lies
between its partial sum plus the least and plus the largest that the other columns can contribute, and rows that
cannot be wanted leave the candidate bitmap; what is left at the end has exact scores.  The first scan wants the
nearest rows of the anchor's label, the second, for each positive, the first rows of other labels whose scores lie
in its window (whole-number bounds); a slice's findings are the first of the slice, and Spark ranks all slices'.

Slices and groups are dealt by a hash of the row's number, not by label or id, so a frequent label, vector or id does not
make a large one.  Every row is read, none is left out unscored but by its bounds.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; a vector
that is shorter than the longest counts as zero beyond its end; scores are exact as long as sums of products
stay below 2^62, others raise an error; rows with one id are rows of their own (another row with the anchor's id may
be found); a null id is no anchor and stands after all ids among equal scores; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerguard.llm.common import stored

#: Rows of a slice, anchors of a group (both on average), columns read between two looks at the bitmap.
SLICE, GROUP, STEP = 4096, 1024, 8
SCALE, LIMIT = 256, float(2 ** 62)
MOST = np.iinfo(np.int64).max


def vectors(embeddings: DataFrame, moved: int | None = None, labels: int = 10) -> DataFrame:
    """row, vec_id, label, v: the rows that take part, with whole-number vectors.  moved: where vec_id is divisible
    by it, the label becomes (label + 1) % labels."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    whole = ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    e = e.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & whole)
    if moved:
        e = e.withColumn("label", F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    return e.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label",
                    F.transform("x", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


# ---- the scan --------------------------------------------------------------------------------------------------
def columns(vectors_: list, width: int) -> np.ndarray:
    """The vectors by dimension; shorter ones are filled with zeros."""
    out = np.zeros((width, len(vectors_)), np.int64)
    for i, v in enumerate(vectors_):
        out[:len(v), i] = v
    return out


class Slice:
    """Columns of a slice's rows, and per column the least and the largest number."""

    def __init__(self, cols: np.ndarray):
        self.cols, self.low, self.high = cols, cols.min(axis=1), cols.max(axis=1)
        self.reach = float(np.abs(cols).max(initial=0)) * len(cols)

    def scan(self, anchor: np.ndarray, wanted: np.ndarray, needless):
        """(rows, scores) of the wanted rows that the bounds do not rule out, and how many columns of rows were read.
        needless(rows, least, most) -> the rows to leave out, by their bounds."""
        if self.reach * float(np.abs(anchor).max(initial=0)) >= LIMIT:
            raise ValueError("components too large: inner products must stay below 2^62")
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        ends = np.stack([a * self.low[order], a * self.high[order]])
        # what the columns from each place on contribute at least and at most
        least = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
        most = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
        rows, read = np.flatnonzero(wanted), 0
        sums = np.zeros(len(rows), np.int64)
        for at in range(0, len(order), STEP):
            dims = order[at:at + STEP]
            sums += a[at:at + STEP] @ (self.cols[dims] if len(rows) == self.cols.shape[1] else self.cols[np.ix_(dims, rows)])
            read += len(dims) * len(rows)
            if not len(rows):
                break
            after = min(at + STEP, len(order))
            if after < len(order):
                stay = ~needless(rows, sums + least[after], sums + most[after])
                if not stay.all():
                    rows, sums = rows[stay], sums[stay]
        return rows, sums, read


def beyond_first(k: int):
    """Rows below the k-th largest of the least scores."""
    def needless(rows, least, most):
        return most < np.partition(least, -k)[-k] if len(least) > k else np.zeros(len(rows), bool)
    return needless


def outside(windows, k: int):
    """Rows that no window wants: out of it, or below k rows that are surely in it."""
    def needless(rows, least, most):
        out = np.ones(len(rows), bool)
        for low, high in windows:
            if low > high:
                continue
            sure = least[(least >= low) & (most <= high)]
            floor = max(low, np.partition(sure, -k)[-k]) if len(sure) >= k else low
            out &= (most < floor) | (least > high)
        return out
    return needless


def first(rows, scores, ids, k: int):
    """The first k of the rows: higher scores, then smaller ids."""
    at = np.lexsort((ids[rows], -scores))[:k]
    return rows[at], scores[at]


def _by_slice(table: pa.Table, width: int):
    ids = np.array([MOST if x is None else x for x in table.column("vec_id").to_pylist()], np.int64)
    return (Slice(columns(table.column("v").to_pylist(), width)), ids, np.array(table.column("row").to_pylist(), np.int64),
            np.array(table.column("label").to_pylist(), np.int64))


def _dealt(v: DataFrame, slices: int, groups: int) -> DataFrame:
    """Every row in its slice, once for each group of anchors."""
    s = F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")
    return v.select("row", "vec_id", "label", "v", s.alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))


def _asked(anchors: DataFrame, slices: int, groups: int) -> DataFrame:
    """Every anchor in its group, once for each slice; its columns under names of their own."""
    anchors = anchors.select([F.col(c).alias(f"a_{c}") for c in anchors.columns])
    g = F.pmod(F.xxhash64(F.lit(1), "a_row"), F.lit(groups)).cast("int")
    return anchors.select("*", g.alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))


FOUND = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("row", pa.int64()),
                   ("score", pa.int64()), ("read", pa.int64()), ("held", pa.int64())])
FOUND_DDL = "anchor long, anchor_id long, place int, id long, row long, score long, read long, held long"


def _scanned(v: DataFrame, anchors: DataFrame, slices: int, groups: int, each) -> DataFrame:
    """each(slice, ids, rows, labels, anchor) -> (place, rows, scores, read) for all pairs of a slice and an anchor."""
    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and asked.num_rows:
            asked = asked.to_pylist()
            width = max(max(map(len, table.column("v").to_pylist())), max(len(q["a_v"]) for q in asked))
            held, ids, rows, labels = _by_slice(table, width)
            for q in asked:
                q = {k[2:]: x for k, x in q.items() if k.startswith("a_")}
                q["v"] = np.array([*q["v"], *[0] * (width - len(q["v"]))], np.int64)
                for place, at, scores, read in each(held, ids, rows, labels, q):
                    out += [dict(anchor=q["row"], anchor_id=q["vec_id"], place=place, id=None if ids[i] == MOST else int(ids[i]),
                                 row=int(rows[i]), score=int(x), read=read, held=width * len(rows)) for i, x in zip(at, scores)]
        return pa.Table.from_pylist(out, FOUND)

    return (_dealt(v, slices, groups).groupBy("slice", "grp").cogroup(_asked(anchors, slices, groups).groupBy("slice", "grp"))
            .applyInArrow(run, FOUND_DDL))


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(v: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10,
                   window: tuple[int, int] = (30, 90), slice_rows: int = SLICE, group_rows: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (and anchor, positive: the rows'
    numbers) for vectors as ``vectors`` gives them.  Anchors: ids divisible by anchor_every; window: percentages of the
    positive's score that a negative's may have."""
    v = stored(v)
    anchors = v.filter(F.col("vec_id") % anchor_every == 0)
    n, m = v.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % anchor_every == 0, 1))).first()
    slices, groups = max(1, -(-n // slice_rows)), max(1, -(-m // group_rows))
    low, high = window

    def nearest(held, ids, rows, labels, q):
        got, scores, read = held.scan(q["v"], (labels == q["label"]) & (rows != q["row"]), beyond_first(positives))
        yield (0, *first(got, scores, ids, positives), read)

    found = _ranked(_scanned(v, anchors, slices, groups, nearest), positives, "anchor")
    chosen = stored(found.select("anchor", "anchor_id", F.col("rank").cast("int").alias("place"), F.col("row").alias("positive"),
                                 F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    asked = anchors.join(chosen.groupBy(F.col("anchor").alias("row2")).agg(
        F.sort_array(F.collect_list(F.struct("place", F.col("positive_score").alias("score")))).alias("p")), F.col("row") == F.col("row2")).drop("row2")

    def windowed(held, ids, rows, labels, q):
        # low * positive <= 100 * negative <= high * positive, in whole numbers
        bounds = [(p["place"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in q["p"]]
        got, scores, read = held.scan(q["v"], labels != q["label"], outside([b[1:] for b in bounds], negatives))
        for place, least, most in bounds:
            inside = (scores >= least) & (scores <= most)
            yield (place, *first(got[inside], scores[inside], ids, negatives), read)

    mined = _ranked(_scanned(v, asked, slices, groups, windowed), negatives, "anchor", "place")
    c = chosen.select(F.col("anchor").alias("a2"), F.col("place").alias("p2"), "positive", "positive_id", "positive_score")
    return (mined.join(c, (F.col("anchor") == F.col("a2")) & (F.col("place") == F.col("p2")))
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score"), "anchor", "positive"))
