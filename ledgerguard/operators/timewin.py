"""Skew-safe range windows over event time: counts, sums and maxima per key.

A plain ``count() over (partition by account order by ts range ...)`` puts every
row of an account into one task; one hot account holding a third of the data
would then be one task.  Here the partition key is (key, time bucket).

Cold keys use buckets of the window length W.  A trailing window ``[t - W, t]``
only touches the row's own bucket and the previous one, so every row is also
sent once to the next bucket as a "carry" row.  For an own row at ``t``:

    own rows in the bucket with time <= t
  + carry rows with time + W >= t, that is all carry rows less those with time + W < t

Own rows are ordered by 2t and carry rows by 2(t' + W) + 1, so one running frame (RANGE unbounded .. current) gives
both the own rows up to t and the carry rows before t: a bucket costs as many steps as it has rows.  A frame that ends
unbounded would be summed anew for every row, rows times rows of a bucket.  Maxima and sums of floating-point values
cannot be subtracted; their carry rows are read by a running frame in the reverse order, one more sort of the bucket.

How finely a key is cut follows from its density, the rows in its densest bucket (``density``, a histogram by
(key, bucket) summed map-side): every key gets granules of W / m, with m the least power of two that leaves about
``ROWS_PER_GRANULE`` rows in a granule; a key below that has m = 1, the bucket above.  With m > 1 the window
``[t - W, t]`` of a row in granule G covers part of granule G, part of granule G - m (reached by the carry copy,
moved m granules) and all of granules G - m + 1 .. G - 1.  Those middle granules are pre-aggregated per (key,
granule), map-side combined, and each summary row is sent to the m - 1 granules that need it, in the same shuffle
as the rows.  No join of rows, no pairs; the plan stays one shuffle on (key, bucket).  Forward windows ``[t, t + W]`` are trailing windows
over the negated time.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col

_UNITS = {
    "microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
    "hour": 3_600_000_000, "day": 86_400_000_000, "week": 7 * 86_400_000_000,
}

# Rows that a granule is meant to hold, and the most granules of a window; a cluster can set the first per session.
ROWS_PER_GRANULE = 4096
MOST_GRANULES = 1024
CONF_ROWS = "spark.ledgerguard.windows.rowsPerGranule"


_SENTINEL_K = -(2 ** 63)


def duration_micros(text: str) -> int:
    """'1 hour', '30 minutes', '24 hours', '21 days' -> microseconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", text.lower())
    if not m or m.group(2) not in _UNITS:
        raise ValueError(f"bad duration: {text!r}")
    return int(m.group(1)) * _UNITS[m.group(2)]


def epoch_micros(df: DataFrame, ts_col: str) -> Column:
    """Microseconds since epoch, without any time-zone conversion for TIMESTAMP_NTZ."""
    dtype = df.schema[ts_col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts_col}`)")
    return F.unix_micros(F.col(ts_col))


def density(df: DataFrame, keys: list[str], ts_col: str, bucket: str) -> DataFrame:
    """``keys``, ``peak``, ``bucket``: for every key the rows of its densest bucket of time, and the bucket's
    microseconds.  One table serves every window over the same rows: a window of several buckets is taken to be as dense
    all along.  It only decides how finely a key is cut, never a result."""
    B = duration_micros(bucket)
    t = epoch_micros(df, ts_col)
    return (df.groupBy(*keys, F.floor(t / F.lit(B)).alias("_lg_b")).agg(F.count(F.lit(1)).alias("_lg_n"))
              .groupBy(*keys).agg(F.max("_lg_n").alias("peak")).withColumn("bucket", F.lit(B).cast("bigint")))


def _granules(dense: DataFrame, keys: list[str], W: int, rows: int) -> DataFrame:
    """``keys``, ``_lg_m`` of the keys that are cut into more than one granule; m divides W."""
    most = min(W & -W, MOST_GRANULES)   # the largest power of two in W
    need = c("peak") * F.ceil(F.lit(W) / c("bucket")) / F.lit(rows)
    m = F.least(F.pow(F.lit(2.0), F.ceil(F.log2(need))), F.lit(float(most))).cast("bigint")
    # keys are compared null-safe, so they get names of their own
    return dense.filter(need > 1).select(*[c(k).alias(f"_lg_key_{k}") for k in keys], m.alias("_lg_m"))


def _matched(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & c(k).eqNullSafe(c(f"_lg_key_{k}"))
    return cond


def _windowed(df: DataFrame, keys: list[str], ts_col: str, window: str, direction: str,
              measures: list[tuple[str, Column, str]], *, dense: DataFrame | None = None,
              rows_per_granule: int | None = None) -> DataFrame:
    """``df`` plus one column per measure ``(name, value, 'sum' | 'max')``: the aggregate of ``value`` over
    the rows with the same ``keys`` whose time lies in ``[t - W, t]`` (trailing) or ``[t, t + W]`` (forward).
    Ties on time are peers and all included (RANGE semantics); sums of an empty frame are 0.
    ``dense`` is a :func:`density` table of the same rows (or of more); without it one is made here."""
    if direction not in ("trailing", "forward"):
        raise ValueError(direction)
    rows_per_granule = rows_per_granule or int(df.sparkSession.conf.get(CONF_ROWS, str(ROWS_PER_GRANULE)))
    W = duration_micros(window)
    sign = 1 if direction == "trailing" else -1
    cols = df.columns
    vnames = [f"_lg_v{i}" for i in range(len(measures))]
    base = df.select("*", *[expr.alias(v) for (_, expr, _), v in zip(measures, vnames)])
    out_types = {}
    for (name, _, how), v in zip(measures, vnames):
        probe = (F.sum(c(v)) + F.sum(c(v))) if how == "sum" else F.max(c(v))
        out_types[name] = base.select(probe.alias("x")).schema["x"].dataType
    if dense is None:
        dense = density(df, keys, ts_col, window)
    # broadcast by Spark if its measured size allows, else a skew-split join; empty if no key is dense
    cut = _granules(dense, keys, W, rows_per_granule)
    drop = [f"_lg_key_{k}" for k in keys]
    plain = base
    base = (plain.join(cut, _matched(keys), "left").drop(*drop)
            .withColumn("_lg_m", F.coalesce(c("_lg_m"), F.lit(1).cast("bigint"))))

    t = epoch_micros(base, ts_col)
    width = F.expr(f"CAST({W} AS BIGINT) div _lg_m")        # exact: m divides W
    copies = base.select("*", t.alias("_lg_t"), width.alias("_lg_w"),
                         F.explode(F.array(F.lit(1), F.lit(0))).alias("_lg_own"))
    own = c("_lg_own") == 1
    b = F.expr("(_lg_t - pmod(_lg_t, _lg_w)) div _lg_w")      # exact floor division, also before 1970
    keep = set(keys)
    rows = copies.select(
        *[c(x) if x in keep else F.when(own, c(x)).alias(x) for x in cols], *vnames, "_lg_own",
        F.when(own, b).otherwise(b + sign * c("_lg_m")).alias("_lg_b"),
        F.when(own, c("_lg_t") * (2 * sign)).otherwise(c("_lg_t") * (2 * sign) + F.lit(2 * W + 1)).alias("_lg_k"))
    # an inner join: with no dense key Spark finds it empty and reads nothing for it
    dense_rows = plain.join(cut, _matched(keys)).drop(*drop).select(*keys, "_lg_m", *vnames, t.alias("_lg_t"), width.alias("_lg_w"))
    per = (dense_rows.groupBy(*keys, "_lg_m", b.alias("_lg_g"))
              .agg(*[(F.sum if how == "sum" else F.max)(v).alias(v)
                     for (_, _, how), v in zip(measures, vnames)]))
    g, mm = c("_lg_g"), c("_lg_m")
    targets = F.sequence(g + 1, g + mm - 1) if sign == 1 else F.sequence(g - mm + 1, g - 1)
    summaries = per.select(*keys, F.explode(targets).alias("_lg_b"), F.lit(2).alias("_lg_own"),
                           F.lit(_SENTINEL_K).cast("bigint").alias("_lg_k"), *vnames)
    rows = rows.unionByName(summaries, allowMissingColumns=True)

    w = Window.partitionBy(*keys, "_lg_b")
    running = w.orderBy("_lg_k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reverse = w.orderBy(c("_lg_k").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.orderBy("_lg_k").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_own, is_carry, is_summary = c("_lg_own") == 1, c("_lg_own") == 0, c("_lg_own") == 2
    results = []
    for (name, _, how), v in zip(measures, vnames):
        agg = F.sum if how == "sum" else F.max
        own_part = agg(F.when(is_own, c(v))).over(running)
        if how == "sum" and not isinstance(out_types[name], (T.FloatType, T.DoubleType)):
            # the carry rows of a row without a time are its peers: none is before it
            before = agg(F.when(is_carry & c("_lg_k").isNotNull(), c(v))).over(running)
            zero = F.lit(0)
            expr = (F.coalesce(own_part, zero) + F.coalesce(agg(F.when(~is_own, c(v))).over(whole), zero)
                    - F.coalesce(before, zero))
        else:
            parts = [own_part, agg(F.when(is_carry, c(v))).over(reverse), agg(F.when(is_summary, c(v))).over(whole)]
            expr = reduce(add, [F.coalesce(p, F.lit(0)) for p in parts]) if how == "sum" else F.greatest(*parts)
        results.append(expr.cast(out_types[name]).alias(name))
    names = [name for name, _, _ in measures]
    return (rows.select(*[c(x) for x in cols], "_lg_own", *results).filter(is_own)
                .select(*[c(x) for x in cols], *names))


def trailing_count(df: DataFrame, keys: list[str], ts_col: str, window: str, out_col: str,
                   value_col: str | None = None, sum_col: str | None = None, **split) -> DataFrame:
    """Add ``out_col`` = number of rows with the same ``keys`` and time in ``[t - W, t]``.

    If ``value_col``/``sum_col`` are given, also add the sum of ``value_col`` over the same frame.
    Ties on time are peers and are all counted (RANGE semantics).
    """
    measures = [(out_col, F.lit(1), "sum")]
    if value_col and sum_col:
        measures.append((sum_col, c(value_col), "sum"))
    return _windowed(df, keys, ts_col, window, "trailing", measures, **split)


def forward_max(df: DataFrame, keys: list[str], ts_col: str, window: str, value_col: str,
                out_col: str, **split) -> DataFrame:
    """Add ``out_col`` = max of ``value_col`` over rows with the same keys and time in ``[t, t + W]``."""
    return _windowed(df, keys, ts_col, window, "forward", [(out_col, c(value_col), "max")], **split)


def range_sums(df: DataFrame, keys: list[str], ts_col: str, window: str, measures: dict[str, Column],
               direction: str = "trailing", **split) -> DataFrame:
    """Add, per measure, the sum of the measure over rows with the same ``keys`` whose time lies in
    ``[t - W, t]`` (``trailing``) or ``[t, t + W]`` (``forward``)."""
    return _windowed(df, keys, ts_col, window, direction, [(n, e, "sum") for n, e in measures.items()], **split)
