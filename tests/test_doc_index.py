"""The streamed document index: changed, removed and repeated documents, runs again, compaction."""

import pytest
from pyspark.sql import functions as F

from ledgerguard.operators.search import build_index
from ledgerguard.streaming import doc_index as DI


def batch(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, arrived int")


def content(df):
    return sorted(tuple(r[x] for x in ("doc_id", "term", "tf", "doc_len")) for r in df.collect())


def plain(spark, docs):
    """Postings of a {doc_id: text} written at once."""
    return content(build_index(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), text_col="text"))


@pytest.fixture
def index(spark, tmp_path):
    return DI.DocIndex(spark, str(tmp_path / "index"))


def test_changes_and_removals(spark, index):
    index.apply(batch(spark, [(1, "cash cash deposit", 1), (2, "wire transfer", 1), (3, "loan", 1)]), "a")
    index.apply(batch(spark, [(1, "cash deposit", 2), (2, None, 2), (3, "loan", 2), (4, "new one", 2), (9, None, 2)]), "b")
    assert content(index.postings()) == plain(spark, {1: "cash deposit", 3: "loan", 4: "new one"})
    assert sorted((r["doc_id"], r["v"]) for r in index.documents().collect()) == [(1, 2), (3, 1), (4, 2)]
    index.apply(batch(spark, [(2, "back again", 3), (1, "cash cash deposit", 3)]), "c")      # one returns, one reverts
    want = plain(spark, {1: "cash cash deposit", 2: "back again", 3: "loan", 4: "new one"})
    assert content(index.postings()) == want
    index.compact()
    assert content(index.postings()) == want
    assert index.vacuum() == [1, 2, 3] and content(index.postings()) == want
    index.apply(batch(spark, [(3, None, 4), (4, "newer", 4)]), "d")
    assert content(index.postings()) == plain(spark, {1: "cash cash deposit", 2: "back again", 4: "newer"})


def test_a_batch_runs_again(spark, index):
    index.apply(batch(spark, [(1, "one", 1)]), "a")
    index.apply(batch(spark, [(1, "two", 2)]), "b")
    before = content(index.postings())
    assert index.apply(batch(spark, [(1, "two", 2)]), "b") == 2 and content(index.postings()) == before
    # a batch that failed before its mark leaves files that no reader sees and that the next try replaces
    index._write(3, postings=build_index(batch(spark, [(7, "half", 1)]), text_col="text"))
    assert content(index.postings()) == before
    index.apply(batch(spark, [(8, "whole", 3)]), "c")
    assert content(index.postings()) == sorted(before + plain(spark, {8: "whole"}))


def test_rows_of_one_batch(spark, index):
    """The last arrival of a document holds; repeats, ties, empty texts and rows without an id are defined."""
    index.apply(batch(spark, [(1, "old", 1), (1, "new", 2), (2, "same", 1), (2, "same", 1), (3, "", 1), (None, "nobody", 1),
                              (4, "gone", 1), (4, None, 2)]), "a")
    assert content(index.postings()) == plain(spark, {1: "new", 2: "same"})
    assert sorted(r["doc_id"] for r in index.documents().collect()) == [1, 2, 3]
    assert index.apply(batch(spark, []), "b") == 2 and content(index.postings()) == plain(spark, {1: "new", 2: "same"})


def test_unchanged_documents_are_not_written_again(spark, index):
    rows = [(i, f"text {i}", 1) for i in range(50)]
    index.apply(batch(spark, rows), "a")
    index.apply(batch(spark, [(i, t, 2) for i, t, _ in rows[:-1]] + [(49, "changed", 2)]), "b")
    assert spark.read.parquet(f"{index.root}/versions/v=2").count() == 1
    assert spark.read.parquet(f"{index.root}/replaced/v=2").count() == 1


def test_stream_of_files(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "index")
    docs = spark.createDataFrame([(i, f"text number {i}", "en", "s", 1) for i in range(20)], DI.DOCS_SCHEMA)
    docs.write.parquet(src)
    DI.run_index_refresh(spark, src, root, f"{root}-ckpt")
    later = docs.filter("doc_id < 4").withColumn("text", F.when(F.col("doc_id") > 0, F.lit("other words")))
    later.write.mode("append").parquet(src)
    index = DI.run_index_refresh(spark, src, root, f"{root}-ckpt")
    want = {i: "other words" if i < 4 else f"text number {i}" for i in range(1, 20)}
    assert content(index.postings()) == plain(spark, want)
    assert content(DI.run_index_refresh(spark, src, root, f"{root}-ckpt").postings()) == plain(spark, want)
