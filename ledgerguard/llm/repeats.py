"""Operator 10, repeated byte strings by blockwise sorting of suffix buckets with cover samples.

Every string of ``LENGTH`` bytes holds a cover sample: the smallest (by hash) of its ``GRAM``-byte pieces,
the first if several are equal.  Equal strings have their sample at the same offset, which is what a
difference cover gives, with one sample in about 35 bytes instead of one in five (period 32).  So only
samples are sorted, each with the run of string starts that it serves and a hash of all bytes of these
strings (its context).

Suffix buckets are the samples' hashes: each partition sorts its buckets by (sample, context, document,
place).  Ties: samples with the same context serve equal strings, all but the first in document order are
repeats, whole runs at once.  Where one sample has several contexts, the contexts' bytes are read again,
and the strings of one bucket after another are ranked and compared one by one.

Memory: texts go in segments of about 1 MB, samples stream through the sort (which spills), and the
comparison takes one block of buckets at a time.  Copies within an Arrow batch are settled before the
shuffle, so very large groups of copies send one row for each batch.

Defined cases: a null text counts as empty; a text of fewer than ``LENGTH`` bytes has no repeats; a null
doc_id comes after all others; texts under one doc_id are ordered by a hash of the text; rows repeated with
id and text are one document and get the same result; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import row_key, stored, texts
from ledgerguard.llm.shingles import BLOCK, blocks, mix, powers

LENGTH, GRAM = 100, 32
#: Positions inside a segment take the low bits of a packed (hash, position).
_POSITION = np.uint64((1 << 24) - 1)
_BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_LAST = np.iinfo(np.int64).max


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # filled in tasks


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size not in _tables:
        _tables.clear()
        _tables[size] = powers(size, _P), powers(size, _INVERSE)
    return _tables[size]


class _Strings:
    """Hashes of any strings of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(1 << max(20, (len(data) + 1).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[:len(data)], out=self.sums[1:])

    def hash(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def _segments(column):
    """(bytes, row of each text, start of each text, its offset in the whole text, end) in blocks."""
    for row, data, at in blocks(column):
        if len(at) == 2 and len(data) > 2 * BLOCK:
            for a in range(0, len(data) - LENGTH + 1, BLOCK):
                part = data[a:a + BLOCK + LENGTH - 1]
                yield part, np.array([row]), np.array([0]), np.array([a]), np.array([len(part)])
        else:
            yield data, np.arange(row, row + len(at) - 1), at[:-1], np.zeros(len(at) - 1, np.int64), at[1:]


def _samples(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For a segment's strings: text index, sample hash, context hash, first start, sample, last start."""
    n = len(data)
    if n < LENGTH:
        return None
    s = _Strings(data)
    i = np.arange(n - GRAM + 1)
    gram = s.hash(i, i + GRAM)
    low = (gram & ~_POSITION) | i.astype(np.uint64)
    width, window = 1, LENGTH - GRAM + 1
    while 2 * width <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:len(low) - (window - width)], low[window - width:])  # one for each string
    text = np.repeat(np.arange(len(starts)), ends - starts)[:n - LENGTH + 1]
    valid = np.flatnonzero(ends[text] - np.arange(n - LENGTH + 1) >= LENGTH)
    if not len(valid):
        return None
    sample = (low[valid] & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.diff(sample, prepend=-1) != 0)
    last = np.append(first[1:], len(valid)) - 1
    p, lo, hi = sample[first], valid[first], valid[last]
    shape = ((p - lo) * 256 + (hi - lo)).astype(np.uint64)
    context = mix(s.hash(lo, hi + LENGTH) ^ (shape * np.uint64(0x9E3779B97F4A7C15)) ^ (gram[p] >> np.uint64(1)))
    return text[lo], gram[p], context, lo, p, hi


def _merged(doc, tie, a, b):
    """Intervals [a, b) of (doc, tie), joined where they touch."""
    order = np.lexsort((a, tie, doc))
    doc, tie, a, b = doc[order], tie[order], a[order], b[order]
    new = np.ones(len(a), bool)
    same = (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1])
    group = np.concatenate([[0], np.cumsum(~same)]) * (1 << 33)
    reach = np.maximum.accumulate(b + group)  # ends grow from one text to the next
    new[1:] = (a + group)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], tie[at], a[at], (reach - group)[np.append(at[1:], len(a)) - 1] if len(a) else b


#: One row is a sample (w = sample hash << 32 | first start) or, with ctx null, a repeat [w, x).
_ROW = "ctx long, w long, doc_id long, tie long, x long"


def _collect_samples(batches):
    for batch in batches:
        ids = batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
        keys = batch.column("row_key").to_numpy(zero_copy_only=False) >> 16
        found = []
        for data, rows, starts, shift, ends in _segments(batch.column("text")):
            got = _samples(data, starts, ends)
            if got is not None:
                text, gram, context, lo, p, hi = got
                found.append((context, gram >> np.uint64(32), ids[rows[text]], keys[rows[text]],
                              lo - starts[text] + shift[text], p - lo, hi - lo))
        if not found:
            continue
        ctx, gram, doc, tie, lo, ahead, span = (np.concatenate(c) for c in zip(*found))
        del found
        order = np.lexsort((lo, tie, doc, ctx))
        ctx, gram, doc, tie, lo, ahead, span = (c[order] for c in (ctx, gram, doc, tie, lo, ahead, span))
        head = np.ones(len(ctx), bool)
        head[1:] = ctx[1:] != ctx[:-1]
        of = np.flatnonzero(head)[np.cumsum(head) - 1]
        repeat = (doc != doc[of]) | (tie != tie[of]) | (lo != lo[of])
        d, t, a, b = _merged(doc[repeat], tie[repeat], lo[repeat], (lo + span + LENGTH)[repeat])
        keep = head
        n, m = int(keep.sum()), len(a)
        w = ((gram[keep] << np.uint64(32)).view(np.int64)) | lo[keep]
        x = ahead[keep] * 256 + span[keep]
        yield pa.record_batch([
            pa.array(np.append(ctx[keep].view(np.int64), np.zeros(m, np.int64)), mask=np.append(np.zeros(n, bool), np.ones(m, bool))),
            pa.array(np.append(w, a)), pa.array(np.append(doc[keep], d)), pa.array(np.append(tie[keep], t)),
            pa.array(np.append(x, b))], names=["ctx", "w", "doc_id", "tie", "x"])


_OUT = "bucket long, doc_id long, tie long, a long, b long"


def _resolve_ties(batches):
    """Sorted samples in, (null, doc_id, tie, a, b) of repeats and (bucket, doc_id, tie, lo, shape) of the
    first of each context out, where their bucket has several contexts."""
    held = None  # the first row of the current context: bucket, ctx, doc, tie, lo, shape
    several = False  # whether the bucket of the held row has had another context
    for batch in batches:
        ctx_null = batch.column("ctx").is_null().to_numpy(zero_copy_only=False)
        ctx = batch.column("ctx").fill_null(0).to_numpy(zero_copy_only=False)
        w, doc, tie, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("w", "doc_id", "tie", "x"))
        out = [(None, doc[ctx_null], tie[ctx_null], w[ctx_null], x[ctx_null])]
        rows = [c[~ctx_null] for c in (w >> 32, ctx, doc, tie, w & 0xFFFFFFFF, x)]
        if held is not None:
            rows = [np.append(np.array([h], np.int64), c) for h, c in zip(held, rows)]
        bucket, ctx, doc, tie, lo, shape = rows
        n = len(bucket)
        if n:
            new_bucket = np.ones(n, bool)
            new_bucket[1:] = bucket[1:] != bucket[:-1]
            new_ctx = new_bucket.copy()
            new_ctx[1:] |= ctx[1:] != ctx[:-1]
            of = np.flatnonzero(new_ctx)[np.cumsum(new_ctx) - 1]
            repeat = (doc != doc[of]) | (tie != tie[of]) | (lo != lo[of])
            out.append((None, doc[repeat], tie[repeat], lo[repeat], (lo + (shape & 255) + LENGTH)[repeat]))
            firsts = np.flatnonzero(new_ctx)
            b = bucket[firsts]
            alone = np.ones(len(firsts), bool)
            alone[1:] &= b[1:] != b[:-1]
            if several and held is not None:
                alone[0] = False
            ends_alone = alone.copy()
            ends_alone[:-1] &= b[:-1] != b[1:]
            # the last context may go on in the next batch; a bucket's contexts go out once it has two
            go = firsts[:-1][~ends_alone[:-1]]
            out.append((bucket[go], doc[go], tie[go], lo[go], shape[go]))
            k = firsts[-1]
            several = not alone[-1]
            held = [bucket[k], ctx[k], doc[k], tie[k], lo[k], shape[k]]
        yield from _resolved(out)
    if held is not None and several:
        yield from _resolved([tuple(np.array([held[k]], np.int64) for k in (0, 2, 3, 4, 5))])


def _resolved(out):
    for bucket, doc, tie, a, b in out:
        if len(doc):
            key = pa.nulls(len(doc), pa.int64()) if bucket is None else pa.array(bucket)
            yield pa.record_batch([key, pa.array(doc), pa.array(tie), pa.array(a), pa.array(b)],
                                  names=["bucket", "doc_id", "tie", "a", "b"])


def _read_contexts(batches):
    """The bytes of the chosen samples' contexts."""
    for batch in batches:
        chosen = batch.column("chosen")
        data = batch.column("text").cast(pa.large_string())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
        raw = memoryview(data.buffers()[2] or b"")
        at = np.asarray(chosen.offsets).astype(np.int64)
        c = chosen.values.slice(at[0], at[-1] - at[0])
        row = np.repeat(np.arange(len(batch)), np.diff(at))
        lo, shape = (c.field(f).to_numpy(zero_copy_only=False) for f in ("a", "b"))
        begin = offsets[row] + lo
        end = begin + (shape & 255) + LENGTH
        yield pa.record_batch([c.field("bucket"), batch.column("doc_id").take(pa.array(row)),
                               batch.column("tie").take(pa.array(row)), pa.array(lo), pa.array(shape & 255),
                               pa.array([bytes(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist())], pa.binary())],
                              names=["bucket", "doc_id", "tie", "lo", "span", "bytes"])


def _compare(batches):
    """Contexts in, sorted by bucket; repeats out.  One block of whole buckets at a time."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        bucket = t.column("bucket").to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
        rest = t.slice(cut)
        if cut:
            yield from _compared(t.slice(0, cut))
    if rest is not None and rest.num_rows:
        yield from _compared(rest)


def _compared(t: pa.Table):
    t = t.combine_chunks()
    bucket, doc, tie, lo, span = (t.column(c).to_numpy() for c in ("bucket", "doc_id", "tie", "lo", "span"))
    order = np.lexsort((lo, tie, doc))
    step = np.ones(len(order), np.int64)
    d, k, p = doc[order], tie[order], lo[order]
    step[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)  # document order; rows repeated in the input share a rank
    column = t.column("bytes").chunk(0).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    row = np.repeat(np.arange(len(bucket)), span + 1)
    j = np.arange(len(row)) - np.repeat(np.cumsum(span + 1) - (span + 1), span + 1)
    at = offsets[row] + j
    key = mix(_Strings(data).hash(at, at + LENGTH) + mix(bucket.view(np.uint64))[row])
    place = rank[row] * 256 + j
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    repeat = place != place[np.flatnonzero(head)[np.cumsum(head) - 1]]
    row, start = row[order][repeat], (lo[row] + j)[order][repeat]
    d, k, a, b = _merged(doc[row], tie[row], start, start + LENGTH)
    yield pa.record_batch([pa.array(d), pa.array(k), pa.array(a), pa.array(b)], names=["doc_id", "tie", "a", "b"])


def _remove(batches):
    for batch in batches:
        data = batch.column("text").cast(pa.large_string())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1].tolist()
        raw = memoryview(data.buffers()[2] or b"")
        spans = batch.column("spans").to_pylist()
        removed, runs, kept = [], [], []
        for i, s in enumerate(spans):
            text, digest = raw[offsets[i]:offsets[i + 1]], hashlib.sha256()
            gone = n = end = 0
            begin = 0  # of the bytes not yet hashed
            for x in sorted(s or (), key=lambda x: (x["a"], x["b"])):
                a, b = x["a"], x["b"]
                if n and a <= end:
                    if b > end:
                        gone, end = gone + b - end, b
                else:
                    digest.update(text[begin if not n else end:a])
                    n, gone, end = n + 1, gone + b - a, b
            digest.update(text[end if n else 0:])
            removed.append(gone), runs.append(n), kept.append(digest.hexdigest())
        yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                               pa.array(runs, pa.int64()), pa.array(kept, pa.string())],
                              names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(d: DataFrame) -> DataFrame:
    """(doc_id, tie, a, b): byte intervals that together cover all repeats; ``d`` is doc_id, text, row_key."""
    n = max(1, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = d.mapInArrow(_collect_samples, _ROW)
    bucket = F.when(F.col("ctx").isNull(), F.col("tie")).otherwise(F.shiftright("w", 32))
    found = stored(rows.repartition(n, bucket)
                   .sortWithinPartitions(F.shiftright("w", 32), "ctx", "doc_id", "tie", "w")
                   .mapInArrow(_resolve_ties, _OUT))
    open_ = (found.filter(F.col("bucket").isNotNull()).distinct().groupBy(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"))
             .agg(F.collect_list(F.struct("bucket", "a", "b")).alias("chosen")))
    own = d.select("text", F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), F.shiftright("row_key", 16).alias("tie"))
    chosen = own.join(open_, (F.col("doc_id") == F.col("_d")) & (F.col("tie") == F.col("_t"))).drop("_d", "_t")
    more = (chosen.mapInArrow(_read_contexts, "bucket long, doc_id long, tie long, lo long, span long, bytes binary")
            .repartition(n, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(_compare, "doc_id long, tie long, a long, b long"))
    return found.filter(F.col("bucket").isNull()).drop("bucket").union(more)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    d = texts(docs).withColumn("row_key", row_key())
    spans = (repeated_spans(d).groupBy(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"))
             .agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    tie = F.shiftright("row_key", 16)
    return (d.join(spans, (F.coalesce("doc_id", F.lit(_LAST)) == F.col("_d")) & (tie == F.col("_t")), "left")
            .select("doc_id", "text", "spans")
            .mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
