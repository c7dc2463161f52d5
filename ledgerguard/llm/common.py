"""Helpers shared by the operators: stored intermediate tables and the identity of a row.

A document's row is known by (doc_id, text): joins back to documents use ``doc_id`` (null-safe) and
``row_key``, so that repeated ids with different texts stay apart and repeated rows get equal results.
"""

from __future__ import annotations

import gc
import json
import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.session import cut_lineage

#: Word separators of the contracts: space and the ASCII controls tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Shingle width and similarity of near-duplicate stages unless a contract says otherwise.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def stored(df: DataFrame) -> DataFrame:
    """The frame written once to the shared checkpoint folder and read back."""
    return cut_lineage(df)


def release(spark) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps now; by itself it waits for the
    driver's next garbage collection.  The JVM learns a moment later which frames Python has dropped, so that a
    second collection is needed."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more) of documents, whatever other columns they have; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def literal_rows(spark, rows: list[dict], fields: str) -> DataFrame:
    """A frame of a few rows given in the plan itself (no Python rows, no RDD)."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def releasing(run):
    """A function over Arrow batches that gives the memory that Arrow holds for later back when a task's rows are done: the
    worker stays for other tasks, which may need none of it."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
    return wrapped


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until the frame has no such column (columns are compared without case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def row_key(doc_id="doc_id", text="text") -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row_key"] == b["row_key"])


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
