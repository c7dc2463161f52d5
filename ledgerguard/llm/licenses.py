"""Operator 9, license scan: phrases, and an exact set-similarity join of text blocks with templates
(built-in functions only).

A block is a line of a text, or a run of lines (those without words do not count) whose lines between the
first and the last hold fewer words than the template: a notice wrapped over any number of lines lies in one.  It is taken as the set of its words.  A template matches a block that
holds at least ``CONTAINMENT`` of the template's words.  Template words are ordered from rare to frequent by the
number of blocks of the whole corpus that hold them.  Prefix filter: a block that matches holds one of the
template's rarest m - o + 1 words (o: the words needed of m); length filter: it has at least o words;
positional filter: the words before, at and after the common word leave room for o.  What passes is
verified by intersecting the sets.  Only the longest run from each line is looked at, as it holds the shorter
ones, and only in texts and near lines with a prefix word.  The index over the templates' prefixes is bounded by the templates.

Defined cases: a null or empty text has no words, no labels and score 0; a text of any length is read whole;
of equal labels one stands, sorted; repeated rows each give their
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import literal_rows, row_key, same_row, texts

#: Fixed values of the contract: phrase, label.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Words of public license notices, label.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and"
     " associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided"
     " that the following conditions are met", "bsd"),
]
CONTAINMENT = 0.9
#: What stands between words; A-Z count as words, they are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _array(words) -> F.Column:
    return F.array(*[F.lit(w) for w in words])


def phrase_places(d: DataFrame, phrases=PHRASES) -> DataFrame:
    """d with n_words and places, the array of (start, label) of every phrase in the text."""
    d = d.withColumn("_w", F.split("text", SEPARATORS))
    lead = F.when(F.get("_w", F.lit(0)) == "", 1).otherwise(0)
    tail = F.when((F.size("_w") > 1) & (F.element_at("_w", -1) == ""), 1).otherwise(0)
    d = d.withColumn("_lead", lead).withColumn("n_words", (F.size("_w") - F.col("_lead") - tail).cast("long"))
    some = F.col("text").rlike("(?i)" + "|".join(p.replace(" ", SEPARATORS) for p, _ in phrases))
    d = d.withColumn("_lw", F.when(some, F.transform("_w", lambda w: F.lower(w))))
    found = []
    for phrase, label in phrases:
        at = " and ".join(f"get(_lw, i + {k}) = '{w}'" for k, w in enumerate(phrase.split()))
        found.append(F.expr(f"transform(filter(sequence(0, size(_lw) - 1), i -> {at}),"
                            f" i -> struct(cast(i - _lead as long) as start, '{label}' as label))"))
    return (d.withColumn("places", F.when(F.col("_lw").isNotNull(), F.concat(*found)))
            .drop("_w", "_lw", "_lead"))


def _posted(blocks: DataFrame, order: list[str], prefix: list[str]) -> DataFrame:
    """A row for each block and prefix word in it."""
    return (blocks.withColumn("_p", F.array_intersect("_set", _array(prefix))).filter(F.size("_p") > 0)
            .withColumn("_n", F.size(F.array_remove("_set", "")))
            .withColumn("_known", F.array_intersect(_array(order), F.col("_set")))
            .withColumn("_w", F.explode_outer("_p")))


def _runs(d: DataFrame, templates, prefix: list[str]) -> DataFrame:
    """(doc_id, row_key, block, _length, _set): the longest run from every line, for each length of a template."""
    lengths = sorted({len(t.split()) for t, _ in templates})
    # words of lines, as often as they stand there; a run's following lines are one more than its words at most
    lines = F.filter(F.transform(F.split(F.lower("text"), "\n"), lambda x: F.array_remove(F.split(x, SEPARATORS), "")),
                     lambda x: F.size(x) > 0)
    near = (d.filter(F.lower("text").rlike("|".join(prefix))).select("doc_id", "row_key", lines.alias("_l"))
            .withColumn("_has", F.transform("_l", lambda x: F.arrays_overlap(x, _array(prefix))))
            .filter((F.size("_l") > 1) & F.array_contains("_has", True))
            .select("*", F.posexplode_outer("_has").alias("block", "_own"))
            .filter(F.array_contains(F.slice("_has", F.col("block") + 1, max(lengths) + 1), True))
            .withColumn("_l", F.slice("_l", F.col("block") + 1, max(lengths) + 1))
            .select("doc_id", "row_key", "block", "_l", F.explode_outer(F.array(*[F.lit(n) for n in lengths])).alias("_length")))
    run = F.expr("aggregate(slice(_l, 2, _length), named_struct('n', 0, 'w', _l[0]),"
                 " (a, x) -> if(a.n < _length, named_struct('n', a.n + size(x), 'w', concat(a.w, x)), a), a -> a.w)")
    return near.select("doc_id", "row_key", "block", "_length", F.array_distinct(run).alias("_set"))


def matching_blocks(d: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, row_key, block, label, containment) of every block and template that match."""
    sets = [sorted(set(t.split())) for t, _ in templates]
    vocabulary = sorted({w for s in sets for w in s})
    blocks = (d.select("doc_id", "row_key", F.posexplode_outer(F.split("text", "\n")).alias("block", "_line"))
              .withColumn("_length", F.lit(None).cast("int"))
              .withColumn("_set", F.array_distinct(F.split(F.lower("_line"), SEPARATORS))).drop("_line"))
    # one row for each word of the templates
    counts = {r["w"]: r["n"] for r in blocks.select(F.explode_outer(F.array_intersect("_set", _array(vocabulary))).alias("w"))
              .filter(F.col("w").isNotNull()).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    index = []
    for (t, label), words in zip(templates, sets):
        words = sorted(words, key=order.index)
        need = ceil(containment * len(words) - 1e-9)
        index += [{"w": w, "i": i, "m": len(words), "need": need, "words": words, "label": label, "length": len(t.split())}
                  for i, w in enumerate(words[:len(words) - need + 1])]
    prefix = sorted({x["w"] for x in index})
    rows = literal_rows(d.sparkSession, index, "w: string, i: int, m: int, need: int, words: array<string>, label: string, length: int")
    posted = _posted(blocks.unionByName(_runs(d, templates, prefix)), order, prefix)
    j = F.array_position("_known", F.col("_w")) - 1
    hit = F.size(F.array_intersect("words", "_set"))
    room = F.least(F.col("i"), j) + 1 + F.least(F.col("m") - F.col("i") - 1, F.size("_known") - j - 1)
    return (posted.join(F.broadcast(rows), F.col("_w") == F.col("w"))
            .filter(F.coalesce(F.col("_length") == F.col("length"), F.lit(True)))
            .filter((F.col("_n") >= F.col("need")) & (room >= F.col("need")) & (hit >= F.col("need")))
            .select("doc_id", "row_key", "block", "label", (hit / F.col("m")).alias("containment")))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    Labels are empty strings where there are none; score is the largest containment found, 1 where a
    phrase stands, 0 without either."""
    d = texts(docs).withColumn("row_key", row_key())
    own = phrase_places(d).select("doc_id", "row_key", "n_words", "places")
    found = (matching_blocks(d).groupBy("doc_id", "row_key")
             .agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment")))
    j = own.join(found, same_row(own, found), "left").select(own["*"], "more", "containment")
    starts = F.transform("places", lambda x: x["start"])
    base = F.coalesce(F.array_distinct(F.transform("places", lambda x: x["label"])), F.array().cast("array<string>"))
    n = F.coalesce(F.size("places"), F.lit(0))
    n = F.when(n > 0, n).otherwise(0).cast("long")
    none = F.array().cast("array<string>")
    return j.select(
        "doc_id", "n_words", n.alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.coalesce("containment", F.lit(0.0)), F.when(n > 0, 1.0).otherwise(0.0)).alias("score"))
