"""O-ST7: a document index that a stream keeps up to date, changed and removed documents included.

The index is a folder of plain Parquet:

    postings/v=N   doc_id, term, tf, doc_len of the documents that version N added or changed
    versions/v=N   doc_id, hash: the text that those postings come from
    replaced/v=N   doc_id, old: documents whose postings of version ``old`` no longer hold since version N
    log/           a mark for each version that is whole, written last

A micro-batch keeps the last arrival of each document, leaves out those whose text has not changed, and writes the
rest as one version; a null text removes a document.  Readers merge: the postings of all versions without the
replaced ones (an anti join with the few pairs that changes leave, not with all documents).  ``compact`` writes
the merged index as a version that stands for all before it.

A batch that runs again after a failure finds no mark and writes its version's folder anew, or finds its mark and does
nothing.  One stream writes an index at a time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerguard.operators.search import build_index
from ledgerguard.session import cut_lineage

DOCS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
TABLES = {"postings": "doc_id long, term string, tf long, doc_len int", "versions": "doc_id long, hash string",
          "replaced": "doc_id long, old int"}


class DocIndex:
    """The index in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- the log: one small file for each version -----------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _marks(self) -> list[str]:
        fs, p = self._fs(f"{self.root}/log")
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _mark(self, version: int, what: str) -> None:
        fs, p = self._fs(f"{self.root}/log/{version}.{what}")
        fs.create(p, True).close()

    def state(self) -> tuple[int, list[int]]:
        """(the last version, the versions that readers need: the last compacted one and those after it)."""
        marks = sorted((int(m.split(".")[0]), m.split(".")[1] == "compact") for m in self._marks())
        base = max((v for v, whole in marks if whole), default=0)
        return max((v for v, _ in marks), default=0), [v for v, _ in marks if v >= base]

    # ---- tables ----------------------------------------------------------------------------------------------
    def _table(self, name: str, needed: list[int]) -> DataFrame:
        schema = f"{TABLES[name]}, v int"
        paths = [p for p in (f"{self.root}/{name}/v={v}" for v in needed) if self._fs(p)[0].exists(self._fs(p)[1])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _valid(self, name: str, needed: list[int]) -> DataFrame:
        gone = self._table("replaced", needed).select(F.col("doc_id").alias("_d"), F.col("old").alias("_v"))
        rows = self._table(name, needed)
        return rows.join(gone, (rows["doc_id"] == F.col("_d")) & (rows["v"] == F.col("_v")), "left_anti")

    def postings(self) -> DataFrame:
        """doc_id, term, tf, doc_len of the documents as they are now."""
        return self._valid("postings", self.state()[1]).drop("v")

    def documents(self) -> DataFrame:
        """doc_id, hash, v: the documents that are in the index and the version that last wrote them."""
        return self._valid("versions", self.state()[1])

    # ---- writing -----------------------------------------------------------------------------------------------
    def _write(self, version: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={version}")

    def apply(self, batch: DataFrame, key: str) -> int:
        """Brings (doc_id, text, arrived) rows into the index as one version; key names the batch, so that one that
        runs again changes nothing.  Rows without an id are not documents.  Returns the last version."""
        if any(m.split(".", 1)[1] == key for m in self._marks()):
            return self.state()[0]
        last, needed = self.state()
        version = last + 1
        # of rows with one arrival the greater hash holds
        latest = (batch.filter("doc_id IS NOT NULL").withColumn("hash", F.sha2("text", 256))
                  .groupBy("doc_id").agg(F.max_by(F.struct("text", "hash"), F.struct("arrived", "hash")).alias("d"))
                  .select("doc_id", "d.text", "d.hash"))
        ids = latest.select("doc_id", F.col("hash").alias("new"))
        # the batch is the small side, so that the documents there are need no shuffle
        known = self._valid("versions", needed).join(ids, "doc_id").select("doc_id", "hash", "new", F.col("v").alias("old"))
        known = cut_lineage(known)
        same = known.filter(F.col("hash") == F.col("new")).select("doc_id")
        changed = cut_lineage(latest.filter(F.col("text").isNotNull()).join(same, "doc_id", "left_anti"))
        self._write(version, postings=build_index(changed, text_col="text"), versions=changed.select("doc_id", "hash"),
                    replaced=known.filter(~F.col("hash").eqNullSafe(F.col("new"))).select("doc_id", "old"))
        self._mark(version, key)
        return version

    def compact(self) -> int:
        """Writes the merged index as a new version; readers need nothing from before it."""
        last, needed = self.state()
        version = last + 1
        self._write(version, postings=self._valid("postings", needed).drop("v"), versions=self._valid("versions", needed).drop("v"),
                    replaced=self.spark.createDataFrame([], TABLES["replaced"]))
        self._mark(version, "compact")
        return version

    def vacuum(self) -> list[int]:
        """Deletes the versions before the last compacted one, which no new reader needs, and returns them."""
        last, needed = self.state()
        old = sorted({int(m.split(".")[0]) for m in self._marks()} - set(needed))
        for v in old:
            for path in [f"{self.root}/{name}/v={v}" for name in TABLES]:
                fs, p = self._fs(path)
                fs.delete(p, True)
        return old


def run_index_refresh(spark: SparkSession, source: str, root: str, checkpoint: str, trigger: dict | None = None) -> DocIndex:
    """Streams the document files of a folder into the index (hourly in production); with the same checkpoint a
    later run goes on where this one ended.  A later file's text of a document replaces an earlier one's."""
    index = DocIndex(spark, root)
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    docs = (spark.readStream.schema(DOCS_SCHEMA).parquet(source)
            .select("doc_id", "text", F.col("_metadata.file_modification_time").alias("arrived")))

    def process(batch: DataFrame, epoch_id: int):
        index.apply(batch, f"{stream}-{epoch_id}")

    q = (docs.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
             .trigger(**(trigger or {"availableNow": True})).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return index
