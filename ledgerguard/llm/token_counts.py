"""Operator 8, token counts without ids.

Every distinct pre-token of the corpus is encoded once and its pieces are counted.  A document's count is
the sum over its pre-tokens of frequency times pieces: frequent words from the bounded dictionary inside
the task, all others as (document, word, frequency) rows joined to the word table and summed.

Defined cases: a null text counts as empty (0 tokens); a text of any length is counted whole; equally frequent words may
stand in the dictionary or not, which changes no count; special strings inside a text are one token, as the
library has it; repeated rows are counted each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import releasing, stored, texts
from ledgerguard.llm.words_bpe import (DICTIONARY, batch_words, frequent, from_bytes, n_words, places, row_slices, source, to_bytes,
                                       with_words, word_table)


def token_counts(docs: DataFrame, tokenizer: str, limit: int, dictionary: int = DICTIONARY // 2) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document.  tokenizer: the path of its file,
    which only the driver reads; dictionary: words that are sent to the tasks, at most."""
    d, tokenizer = texts(docs), source(tokenizer)
    table = word_table(d, tokenizer)
    sent = docs.sparkSession.sparkContext.broadcast(to_bytes(frequent(table, dictionary)))

    @releasing
    def count(batches):
        known, ids = from_bytes(sent.value)
        pieces = np.append(pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64), 0)
        for batch in row_slices(batches, n_words):
            words, at = batch_words(batch, tokenizer)
            code = places(words, known)  # the last entry of pieces, 0, is that of any other word
            total = np.concatenate([[0], np.cumsum(pieces[code])])
            rare = np.flatnonzero(code < 0)
            coded = words.take(pa.array(rare)).dictionary_encode()
            row = np.searchsorted(at, rare, "right") - 1
            names = max(len(coded.dictionary), 1)
            key, freq = np.unique(row * names + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            cut = np.searchsorted(key // names, np.arange(len(at))).astype(np.int32)
            rest = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(key % names)), pa.array(freq)],
                                              ["word", "freq"])
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"),
                                   pa.array(total[at[1:]] - total[at[:-1]]),
                                   pa.ListArray.from_arrays(pa.array(cut), rest)],
                                  names=["doc_id", "n_bytes", "known", "rest"])

    words = with_words(d.withColumn("n_bytes", F.octet_length("text").cast("long")), tokenizer)
    rows = stored(words.select("doc_id", "n_bytes", "words", "odd")
                  .mapInArrow(count, "doc_id long, n_bytes long, known long, "
                                     "rest array<struct<word: string, freq: long>>")
                  .withColumn("row", F.monotonically_increasing_id()))
    pieces = table.select(F.col("word").alias("_w"), F.size("ids").alias("pieces"))
    rest = (rows.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.freq")
            .join(pieces, F.col("word") == F.col("_w"))
            .groupBy(F.col("row").alias("_r")).agg(F.sum(F.col("freq") * F.col("pieces")).alias("more")))
    n = (F.col("known") + F.coalesce("more", F.lit(0))).cast("long")
    return (rows.select("row", "doc_id", "n_bytes", "known").join(rest, F.col("row") == F.col("_r"), "left")
            .select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit")))
