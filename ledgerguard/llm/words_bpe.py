"""Pre-tokens (words) of byte-level BPE and the table of distinct words; used by operators 5 and 8.

Texts are split by Spark with the pattern of the tokenizer file family (fixed value below), which sets a mark after
each word: one string a text goes to Python, where the marks become the words' offsets.  Texts that hold the mark, a
special token or a character that the JVM's Unicode tables do not know are split by the tokenizer
library's own pre-tokenizer instead.  Each distinct word of the corpus is encoded once.  Words that occur
often (at most ``DICTIONARY`` of them or as many as asked for, together of at most ``WORD_BYTES`` times as many bytes: the
proven bound) are sent to the tasks; all other words are joined by shuffle.  More of them take memory, fewer disk.  A tokenizer is given by its file's text (``source``).
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import release, releasing, stored

#: Fixed value: the pattern of byte-level BPE pre-tokenizers; S stands for the Unicode white space.
_S = r"\s\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The most frequent kinds of words come first: neither letters nor numbers begin with an apostrophe.
PATTERN = (r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^" + _S + r"\p{L}\p{N}]+|[" + _S + r"]+(?![^" + _S
           + r"])|[" + _S + r"]+")
#: Stands after each word of a split text; every character of a text belongs to a word.
MARK = "\0"
DICTIONARY, WORD_BYTES = 1 << 19, 64
#: Words that a task handles at a time, unless one document has more.
WORDS_AT_ONCE = 1 << 19

_loaded: dict[str, object] = {}  # filled in tasks only: what a task runs is sent with it


def source(path: str) -> str:
    """The text of a tokenizer file, read by the driver; tasks get the text, as they may not see the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(text: str):
    """The tokenizer of a file's text, once per task."""
    if text not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        _loaded[text] = Tokenizer.from_str(text)
    return _loaded[text]


def specials(text: str) -> dict[str, int]:
    """The special tokens of a file's text and their ids."""
    return {t["content"]: t["id"] for t in json.loads(text)["added_tokens"]}


def with_words(d: DataFrame, tokenizer: str) -> DataFrame:
    """Columns words (the text with a mark after each word; null where the library splits it) and odd (that text, else null)."""
    odd = F.col("text").rlike(r"\p{Cn}") | F.col("text").contains(MARK)
    for s in specials(tokenizer):
        odd = odd | F.col("text").contains(s)
    return d.withColumn("odd", F.when(odd, F.col("text"))).withColumn(
        "words", F.when(F.col("odd").isNull(), F.regexp_replace("text", PATTERN, "$0" + MARK)))


def _library_words(text: str, tokenizer: str) -> list[str]:
    tok = load(tokenizer)
    marks = {t.content for t in tok.get_added_tokens_decoder().values()}
    out: list[str] = []
    for part in re.split("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")", text):
        if part in marks:
            out.append(part)
        elif part:
            out += [part[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(part)]
    return out


def row_slices(batches, weigh, most: int = WORDS_AT_ONCE):
    """The batches in slices of whole rows that weigh at most ``most`` (a single row may weigh more)."""
    for batch in batches:
        weight = np.cumsum(weigh(batch).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(weight):
            before = weight[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(weight, before + most, "right")))
            yield batch.slice(a, b - a)
            a = b


def n_words(batch: pa.RecordBatch) -> pa.Array:
    """For each row of ``with_words`` its number of words; where the library splits the text, its bytes."""
    return pc.coalesce(pc.count_substring(batch.column("words"), MARK), pc.binary_length(batch.column("odd")))


def batch_words(batch: pa.RecordBatch, tokenizer: str) -> tuple[pa.Array, np.ndarray]:
    """(all words of a batch, offsets of its rows in them)."""
    words = batch.column("words")
    odd = batch.column("odd")
    if odd.null_count < len(odd):
        w, o = words.to_pylist(), odd.to_pylist()
        words = pa.array([a.split(MARK)[:-1] if b is None else _library_words(b, tokenizer) for a, b in zip(w, o)],
                         pa.list_(pa.string()))
        at = np.asarray(words.offsets)
        return words.values.slice(at[0], at[-1] - at[0]), at.astype(np.int64) - at[0]
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    marks = np.flatnonzero(data == 0)
    # without its marks, the data are the words one after the other
    first = np.zeros(len(marks) + 1, np.int32)
    first[1:] = marks - np.arange(len(marks))
    every = pa.Array.from_buffers(pa.string(), len(marks), [None, pa.py_buffer(first), pa.py_buffer(data[data != 0])])
    return every, np.searchsorted(marks, ends - ends[0])


def places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The words' places in a dictionary, -1 for any other word.  Each look-up makes its table anew: of the distinct words,
    which are fewer than those of the dictionary."""
    coded = words.dictionary_encode()
    found = pc.index_in(known, coded.dictionary)
    at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    place = np.full(len(coded.dictionary), -1, np.int32)
    place[found.drop_null().to_numpy()] = at
    return place[coded.indices.to_numpy()]


def word_table(d: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n, ids) of every distinct word: its number in the corpus and its piece ids; stored."""
    @releasing
    def count(batches):
        for batch in row_slices(batches, n_words):
            words, _ = batch_words(batch, tokenizer)
            c = pc.value_counts(words)
            yield pa.record_batch([c.field("values"), c.field("counts")], names=["word", "n"])

    @releasing
    def encode(batches):
        tok = load(tokenizer)
        for batch in batches:
            found = tok.encode_batch_fast(batch.column("word").to_pylist(), add_special_tokens=False)
            ids = pa.array([e.ids for e in found], pa.list_(pa.int32()))
            yield pa.record_batch([batch.column("word"), batch.column("n"), ids], names=["word", "n", "ids"])

    counted = (with_words(d, tokenizer).select("words", "odd").mapInArrow(count, "word string, n long")
               .groupBy("word").agg(F.sum("n").alias("n")))
    table = stored(counted.mapInArrow(encode, "word string, n long, ids array<int>"))
    del counted
    release(d.sparkSession)
    return table


def is_frequent(table: DataFrame, size: int = DICTIONARY) -> Column:
    """Whether a row is one of at most ``size`` most frequent words, together of at most ``size * WORD_BYTES`` bytes:
    all above a count that is read off a histogram of the logarithm of the counts.  A frequent word of any length is
    one of them while there is room."""
    level = F.floor(F.log2("n") * 16).cast("int")
    room, bytes_, limit = size, size * WORD_BYTES, None
    counts = table.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word").cast("long")).alias("bytes")).collect()
    for r in sorted(counts, key=lambda r: -r["level"]):
        room -= r["words"]
        bytes_ -= r["bytes"]
        if room < 0 or bytes_ < 0:
            break
        limit = r["level"]
    return level >= limit if limit is not None else F.lit(False)


def most_first(chosen: DataFrame) -> pa.Table:
    """The (word, ids) of chosen words, most frequent ones first."""
    return chosen.select("word", "ids", "n").toArrow().sort_by([("n", "descending")]).drop_columns(["n"])


def frequent(table: DataFrame, size: int = DICTIONARY) -> pa.Table:
    """At most ``size`` of the most frequent words, as (word, ids)."""
    return table.filter(is_frequent(table, size)).select("word", "ids").toArrow()


def to_bytes(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def from_bytes(b: bytes) -> tuple[pa.Array, pa.Array]:
    t = pa.ipc.open_stream(b).read_all().combine_chunks()
    if not t.num_rows:
        return pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
    return t.column("word").chunk(0).cast(pa.string()), t.column("ids").chunk(0).cast(pa.list_(pa.int32()))
