"""Operator 1, quality rules with host verdicts (built-in functions only).

Per document: word and line counts and the base rules.  Per host (``source``): the share of its
documents that fail each rule, shrunk towards the corpus with a beta prior fitted to all hosts by the
method of moments.  A host whose shrunk rate of any rule reaches ``host_limit`` is rejected, and the
verdict is joined back to its documents.

Work per document stays inside its row (no shuffle of words).  The counts are stored once; hosts are
summed map-side first, and the join back spreads every host over ``SALTS`` keys, so one host with a
third of all rows is not one task.

Defined cases: a null or empty text has no words (and fails the word rule); a text of any length is measured
whole inside its row; hosts with equal counts get equal verdicts; a null host is judged by no
host verdict; repeated rows are kept as they are and each counts for its host; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import SPACES, stored, texts

MIN_WORDS = 50          # base rule
MAX_REPEAT_PERCENT = 50  # base rule
MAX_SYMBOL_PERCENT = 10  # of the characters in words; host rules only
HOST_LIMIT = 0.9
#: Bounds of the fitted prior's weight (alpha + beta), in documents.
PRIOR_WEIGHT = (2.0, 1e6)
SALTS = 32
#: Repeated windows of one text up to which they are looked up in a list (results are the same).
LOOKED_UP = 64
RULES = ["short", "repeats", "symbols"]


def base_measures(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, *more, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    d = texts(docs, *more).withColumn("_t", F.btrim("text", F.lit(" \t\n\x0b\x0c\r")))
    d = d.withColumn("_w", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", SPACES)))
    d = d.withColumn("_l", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # one 64-bit hash for each three-word window of the text, made of the words' hashes
    d = d.withColumn("_x", F.transform("_w", lambda w: F.xxhash64(w)))
    d = d.withColumn("_h", F.expr(
        "slice(transform(_x, (x, i) -> xxhash64(x, get(_x, i + 1), get(_x, i + 2))), 1, greatest(size(_x) - 2, 0))"))
    d = d.select("doc_id", *more, "_h",
                 F.size("_w").cast("long").alias("n_words"),
                 F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
                 F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                 (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"))
    # windows that occur again (_d, by sorting); the places of their words (_p).  A text with many
    # such windows finds the places by sorting (window, place) instead of looking each one up in _d
    d = d.withColumn("_o", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array("_h")))
    d = d.withColumn("_d", F.expr("array_distinct(filter(_o, (x, k) -> x = get(_o, k + 1)))")).drop("_o")
    d = d.withColumn("_s", F.when(F.size("_d") > LOOKED_UP, F.sort_array(
        F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("_p", F.when(F.size("_d") > LOOKED_UP, F.expr(
        "sort_array(transform(filter(_s, (x, k) -> coalesce(x.h = get(_s, k - 1).h, false)"
        " or coalesce(x.h = get(_s, k + 1).h, false)), x -> x.i))")).when(F.size("_d") > 0, F.expr(
            "filter(transform(_h, (h, i) -> if(array_contains(_d, h), i, -1)), i -> i >= 0)")))
    covered = F.expr("coalesce(aggregate(transform(_p, (x, k) -> least(3, coalesce(get(_p, k + 1) - x, 3))),"
                     " 0L, (a, x) -> a + x), 0L)")
    d = d.withColumn("n_repeat_words", covered).drop("_h", "_d", "_s", "_p")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def rule_failures(d: DataFrame) -> dict[str, Column]:
    n = F.col("n_words")
    return {"short": n < MIN_WORDS,
            "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
            "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")}


def host_verdicts(measured: DataFrame, host: str, host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: documents, failures and the shrunk failure rate of every rule, verdict."""
    failures = rule_failures(measured)
    hosts = (measured.filter(F.col(host).isNotNull()).groupBy(host)
             .agg(F.count(F.lit(1)).alias("n_docs"),
                  *[F.sum(c.cast("long")).alias(f"fails_{r}") for r, c in failures.items()]))
    rates = hosts.agg(*[a for r in RULES for a in (
        F.avg(F.col(f"fails_{r}") / F.col("n_docs")).alias(f"mean_{r}"),
        F.var_pop(F.col(f"fails_{r}") / F.col("n_docs")).alias(f"var_{r}"))])
    rates = rates.select(F.struct("*").alias("m")).scalar()  # one row: the fitted prior of every rule
    out = hosts.withColumn("_m", rates)
    for r in RULES:
        m, v = F.col(f"_m.mean_{r}"), F.col(f"_m.var_{r}")
        weight = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(PRIOR_WEIGHT[0])),
                                       F.lit(PRIOR_WEIGHT[1]))).otherwise(F.lit(PRIOR_WEIGHT[1]))
        out = out.withColumn(f"rate_{r}", (F.col(f"fails_{r}") + m * weight) / (F.col("n_docs") + weight))
    return (out.drop("_m").withColumn("host_rate", F.greatest(*[F.col(f"rate_{r}") for r in RULES]))
            .withColumn("host_failed", F.col("host_rate") >= host_limit))


def quality_rules(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The documents' measures with their host's verdict: ``host_rate`` (null without a host),
    ``host_failed``, and ``kept`` = passes the base rules and the host's verdict."""
    d = texts(docs, F.col(host).cast("string").alias("_host"))
    measured = stored(base_measures(d, "_host"))
    verdicts = host_verdicts(measured, "_host", host_limit).select(
        F.col("_host").alias("_h"), "host_rate", "host_failed",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    joined = measured.withColumn("_salt", salt).join(
        verdicts, (F.col("_host") == F.col("_h")) & (F.col("_salt") == F.col("_s")), "left")
    return (joined.withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
            .drop("_h", "_s", "_salt").withColumnRenamed("_host", "host"))


def drop_rejected(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Pipeline form: the documents, with all their columns, that the rules keep.  Their rows travel
    beside the measures in one stored pass; only rejected hosts are joined back (an anti join)."""
    d = texts(docs, F.col("source").cast("string").alias("_host"), F.struct(*docs.columns).alias("_doc"))
    measured = stored(base_measures(d, "_host", "_doc"))
    # stored, so that its size is known when the join is planned
    rejected = stored(host_verdicts(measured, "_host", host_limit).filter("host_failed").select(F.col("_host").alias("_h")))
    return (measured.filter(~F.col("base_failed"))
            .join(rejected, F.col("_host") == F.col("_h"), "left_anti").select("_doc.*"))
