"""Operator 5, byte-level BPE by a table of distinct words, and decoding by a piece table.

Texts are split into words, each distinct word of the corpus is encoded once, and the words' ids are put
back by position: words of the bounded dictionary inside the task, all others through rows of (document,
number of the gap, word) that are joined to the word table and come back to their document.  A document is
shuffled as its words' places in the dictionary, with gaps for the other words.  Texts are read three times
(word table, other words, codes), which costs less disk than to store the codes.  Decoding joins ids to
their pieces (a table as large as the vocabulary) and joins the pieces' bytes; bytes that are no UTF-8
become replacement characters, as the library has it.

Defined cases: a null text counts as empty (no tokens); a text of any length is encoded whole, in one task's memory;
equally frequent words may stand in the dictionary or not, which changes no id; special strings inside a text are one token;
repeated rows each give their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import release, releasing, row_key, same_row, stored, texts
from ledgerguard.llm.words_bpe import (DICTIONARY, batch_words, from_bytes, is_frequent, most_first, n_words, places, row_slices,
                                       source, specials, to_bytes, with_words, word_table)

#: Words that a task turns into ids at a time (as many as the dictionary has, if that is more), unless one document has more.
CODES_AT_ONCE = 1 << 17


def pieces(tokenizer: str) -> list[bytes]:
    """The bytes of every id.  Byte-level vocabularies write a byte as a printable character: printable
    bytes as themselves, the others as the characters from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in printable}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    vocab = json.loads(tokenizer)["model"]["vocab"]
    marks = specials(tokenizer)
    out = [b""] * (max([*vocab.values(), *marks.values()]) + 1)
    for token, i in [*vocab.items(), *marks.items()]:
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def _rows_bytes(table: pa.Array, ids: pa.Array, at: np.ndarray):
    """For each row, the joined bytes of its ids' entries in a binary table."""
    got = table.take(ids)
    offsets = np.frombuffer(got.buffers()[1], np.int64)[got.offset:got.offset + len(got) + 1]
    data = memoryview(got.buffers()[2] or b"")
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield data[offsets[a]:offsets[b]]


def _hex(data) -> str:
    return hashlib.sha256(data).hexdigest()


def _packed(code: np.ndarray, at: np.ndarray) -> pa.Array:
    """One binary for each row: its codes, seven bits a byte, low ones first; a set high bit means more follows."""
    parts = np.empty((len(code), 3), np.uint8)
    used = np.ones((len(code), 3), bool)
    for k in range(3):
        parts[:, k] = code >> 7 * k & 127
        if k:
            used[:, k] = code >= 1 << 7 * k
            parts[used[:, k], k - 1] |= 128
    ends = np.concatenate([[0], np.cumsum(used.sum(1))])[at].astype(np.int64)
    data = parts[used]
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _unpacked(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets of the rows in them)."""
    codes = codes.cast(pa.large_binary())
    ends = np.frombuffer(codes.buffers()[1], np.int64)[codes.offset:codes.offset + len(codes) + 1]
    data = np.frombuffer(codes.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].astype(np.int64)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])[:len(last)]
    code = data[first] & 127
    for k in (1, 2):
        more = first + k <= last
        code[more] += (data[first[more] + k] & 127) << 7 * k
    return code, np.searchsorted(last, ends - ends[0]).astype(np.int64)


def _rare(d: DataFrame, tokenizer: str, sent) -> DataFrame:
    """(doc_id, row_key, i, word): a row's words that are not in the dictionary, numbered in order."""
    @releasing
    def rare_words(batches):
        known, _ = from_bytes(sent.value)
        for batch in row_slices(batches, n_words):
            words, at = batch_words(batch, tokenizer)
            other = np.flatnonzero(places(words, known) < 0)
            row = np.searchsorted(at, other, "right") - 1
            i = np.arange(len(other)) - np.searchsorted(other, at)[row]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(row)), batch.column("row_key").take(pa.array(row)),
                                   pa.array(i.astype(np.int32)), words.take(pa.array(other))],
                                  names=["doc_id", "row_key", "i", "word"])

    return (with_words(d, tokenizer).select("doc_id", row_key().alias("row_key"), "words", "odd")
            .mapInArrow(rare_words, "doc_id long, row_key long, i int, word string"))


def _coded(d: DataFrame, tokenizer: str, sent) -> DataFrame:
    """(doc_id, row_key, codes): a row's words as places in the dictionary, counted from 1, 0 for any other word."""
    @releasing
    def code_words(batches):
        known, _ = from_bytes(sent.value)
        for batch in row_slices(batches, n_words):
            words, at = batch_words(batch, tokenizer)
            codes = _packed(places(words, known) + 1, at)
            yield pa.record_batch([batch.column("doc_id"), batch.column("row_key"), codes.cast(pa.binary())],
                                  names=["doc_id", "row_key", "codes"])

    return (with_words(d, tokenizer).select("doc_id", row_key().alias("row_key"), "words", "odd")
            .mapInArrow(code_words, "doc_id long, row_key long, codes binary"))


def encode_decode(docs: DataFrame, tokenizer: str, with_ids: bool = False, dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; also its ids if asked for.  tokenizer: the
    path of its file, which only the driver reads; dictionary: words that are sent to the tasks, at most."""
    d, tokenizer = texts(docs), source(tokenizer)
    table = word_table(d, tokenizer)
    sc = docs.sparkSession.sparkContext
    often = is_frequent(table, dictionary)
    sent = sc.broadcast(to_bytes(most_first(table.filter(often))))
    # repeated rows have the same words at the same places, so a set holds each place once
    found = stored(_rare(d, tokenizer, sent).join(table.filter(~often).select("word", "ids"), "word")
                   .groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("i", "ids")).alias("found")))
    release(docs.sparkSession)
    # codes of one to three bytes a word are shuffled, not texts, and never stored
    coded = _coded(d, tokenizer, sent)
    joined = coded.join(found, same_row(coded, found), "left").select(coded["doc_id"], "codes", "found")
    of_id = sc.broadcast(pieces(tokenizer))

    @releasing
    def run(batches):
        known, known_ids = from_bytes(sent.value)
        piece = pa.array(of_id.value, pa.large_binary())
        decimal = pa.array([b"%d," % i for i in range(len(piece))], pa.large_binary())
        for batch in row_slices(batches, lambda b: pc.binary_length(b.column("codes")), max(len(known), CODES_AT_ONCE)):
            code, at = _unpacked(batch.column("codes"))
            found = batch.column("found")
            r = np.asarray(found.offsets).astype(np.int64)
            rest = found.values.slice(r[0], r[-1] - r[0])
            other = np.flatnonzero(code == 0)
            row_first = np.searchsorted(other, at[:-1])
            where = other[rest.field("i").to_numpy(zero_copy_only=False) + np.repeat(row_first, np.diff(r))]
            code -= 1
            code[where] = len(known) + np.arange(len(where))
            every = pa.concat_arrays([known_ids, rest.field("ids").cast(pa.list_(pa.int32()))]).take(pa.array(code))
            end = np.concatenate([[0], np.cumsum(pc.list_value_length(every).to_numpy(zero_copy_only=False))]).astype(np.int64)
            row_at = end[at]
            ids = every.flatten()
            ids_hex = [_hex(b[:-1]) for b in _rows_bytes(decimal, ids, row_at)]
            text_hex = [_hex(str(b, "utf-8", "replace").encode()) for b in _rows_bytes(piece, ids, row_at)]
            out = [batch.column("doc_id"), pa.array(np.diff(row_at)), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(row_at.astype(np.int32)), ids))
                names.append("ids")
            yield pa.record_batch(out, names=names)

    return joined.mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
