"""The pipeline's stages, each on what the one before kept."""

import pytest

import corpus_pipeline
from llm_fixtures import SF001, edges, none  # noqa: F401
from ledgerguard.llm import pii, queries
from ledgerguard.llm.common import stored
from test_operators import components_of, leaks, pairs, quality_of


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, SF001))
    return out


def test_stages(spark, stages):
    names = list(stages)
    assert names[1:] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "tokens"]
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])
    rows = {n: pairs(stages[n]) for n in names[:-1]}
    kept = {i for i, t in rows["documents"] if not quality_of(t)[-1]}
    assert {i for i, _ in rows["quality_rules"]} == kept
    kept = {i for i, _, c in components_of(rows["quality_rules"], 5, 80) if i == c}
    assert {i for i, _ in rows["near_duplicates"]} == kept
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    kept -= {d for d, _ in leaks(rows["near_duplicates"], items)}
    assert {i for i, _ in rows["decontamination"]} == kept
    before = dict(rows["decontamination"])
    for i, t in rows["personal_data"]:
        assert t == pii.masked(before[i], pii.all_spans(before[i], {})[1])
        assert not pii.scan(t)[0]
    assert {r["doc_id"]: r["n_chars"] for r in stages["personal_data"].collect()} == {i: len(t) for i, t in rows["personal_data"]}


def test_last_stage(spark, stages):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.BYTE_BPE)
    ids = {r["doc_id"]: r["ids"] for r in stages["tokens"].collect()}
    assert ids == {i: tok.encode(t, add_special_tokens=False).ids for i, t in pairs(stages["personal_data"])}


@pytest.mark.parametrize("docs", ["edges", "none"])
def test_each_stage_on_edges(spark, docs, request):
    """Every stage takes null and long texts, repeated rows, null ids and clashing columns; an empty table stays empty."""
    docs = request.getfixturevalue(docs)
    rows = {"quality_rules": 0, "near_duplicates": 8, "decontamination": 11, "personal_data": 11, "tokens": 11}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF001))
        assert name == "tokens" or out.columns == docs.columns
        assert out.count() == (0 if docs.isEmpty() else rows[name]), name


def test_near_duplicates_on_clashing_columns(spark, edges):
    """Copies, repeated rows and a null id, with columns that are named like the operator's own."""
    out = corpus_pipeline.near_duplicates(spark, edges, SF001)
    assert out.columns == edges.columns
    assert sorted((str(r["doc_id"]) for r in out.select("doc_id").collect())) == ["1", "2", "3", "4", "5", "7", "9", "None"]
