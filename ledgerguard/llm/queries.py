"""The operators' registered queries (production parameters, whole tables) and their SQL."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import functions as F

from ledgerguard.llm import (bpe, decontaminate, hard_negatives, html_text, licenses, near_dedup, passages, pii, quality,
                             repeats, sharding, token_counts, turns)
from ledgerguard.llm.common import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark, sf_dir):
    return quality.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle_words=3, percent=85)


def op3_substring_dedup(spark, sf_dir):
    return passages.repeated_passages(documents(spark, sf_dir))


def op4_pii(spark, sf_dir):
    return pii.find_pii(documents(spark, sf_dir))


def op5_bpe(spark, sf_dir):
    return bpe.encode_decode(documents(spark, sf_dir), BYTE_BPE)


def op6_sharding(spark, sf_dir):
    return sharding.shard_by_bytes(documents(spark, sf_dir), shards=8)


def op7_decontamination(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark).drop("row_key")


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), BYTE_BPE, limit=512)


def op9_license_scan(spark, sf_dir):
    return licenses.license_scan(documents(spark, sf_dir))


def op10_suffix_dedup(spark, sf_dir):
    return repeats.without_repeats(documents(spark, sf_dir))


def op11_html_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_conversation_repair(spark, sf_dir):
    return turns.repair_audit(turns.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.hard_negatives(hard_negatives.vectors(
        spark.read.parquet(f"{sf_dir}/embeddings.parquet"), moved=7)).drop("anchor", "positive")


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_minhash_near_dedup, op3_substring_dedup, op4_pii, op5_bpe, op6_sharding,
    op7_decontamination, op8_token_counts, op9_license_scan, op10_suffix_dedup,
    op11_html_extraction, op12_conversation_repair, op13_hard_negatives)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase

ORACLE: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS s
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n
          FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.doc_id, d.source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
        coalesce(covered.n, 0) AS n_repeat_words
      FROM d LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
f AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 100 * n_symbols > 10 * word_chars AS f3 FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (f1) AS c1, count(*) FILTER (f2) AS c2, count(*) FILTER (f3) AS c3
      FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(c1 / n) AS m1, var_pop(c1 / n) AS v1, avg(c2 / n) AS m2, var_pop(c2 / n) AS v2, avg(c3 / n) AS m3, var_pop(c3 / n) AS v3 FROM h),
k AS (SELECT *, CASE WHEN v1 > 0 THEN least(greatest(m1 * (1 - m1) / v1 - 1, 2.0), 1e6) ELSE 1e6 END AS k1,
        CASE WHEN v2 > 0 THEN least(greatest(m2 * (1 - m2) / v2 - 1, 2.0), 1e6) ELSE 1e6 END AS k2,
        CASE WHEN v3 > 0 THEN least(greatest(m3 * (1 - m3) / v3 - 1, 2.0), 1e6) ELSE 1e6 END AS k3 FROM p),
bad AS (SELECT source FROM h, k WHERE greatest((c1 + m1 * k1) / (n + k1), (c2 + m2 * k2) / (n + k2), (c3 + m3 * k3) / (n + k3)) >= 0.9)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
  NOT (f1 OR f2) AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM f
""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
        CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other)
QUALIFY row_number() OVER w <= 10
""",
    "op2_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS sh FROM d),
k AS (SELECT doc_id, len(sh) AS n, CASE WHEN len(sh) > 0 THEN md5(array_to_string(sh, chr(10))) END AS cls FROM s),
c AS (SELECT cls, any_value(n) AS n, min(doc_id) AS first FROM k WHERE cls IS NOT NULL GROUP BY cls),
u AS (SELECT c.cls, c.n, unnest(s.sh) AS x FROM c JOIN s ON s.doc_id = c.first),
p AS (SELECT a.cls AS a, b.cls AS b FROM u a JOIN u b ON a.x = b.x AND a.cls < b.cls
      GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, root) AS (SELECT cls, cls FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
m AS (SELECT r.node AS cls, min(c.first) AS component_id FROM r JOIN c ON c.cls = r.root GROUP BY 1)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(m.component_id, k.doc_id) AS component_id,
  k.doc_id = coalesce(m.component_id, k.doc_id) AS kept
FROM k LEFT JOIN m ON m.cls = k.cls
""",
    "op10_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 200)) AS x
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS n FROM s) WHERE n > 1),
edge AS (SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 AS new FROM again),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b
         FROM (SELECT doc_id, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM edge) GROUP BY doc_id, run),
gaps AS (SELECT r.doc_id, r.a, r.b, coalesce(lag(r.b) OVER (PARTITION BY r.doc_id ORDER BY r.a), 0) AS before FROM runs r),
kept AS (SELECT g.doc_id, sum(g.b - g.a) AS n_removed, count(*) AS n_spans, max(g.b) AS tail,
           string_agg(substr(d.h, 2 * g.before + 1, 2 * (g.a - g.before)), '' ORDER BY g.a) AS front
         FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN d.h ELSE k.front || substr(d.h, 2 * k.tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
}
