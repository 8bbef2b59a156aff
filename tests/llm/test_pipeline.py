"""Stages of the pipeline on small and awkward documents."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from impactspark.llm import bpe, queries, simhash

from conftest import PROSE

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, some_docs):
    docs = some_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.dtypes == docs.dtypes, name
        docs = out
    ids = {r.doc_id for r in docs.collect()}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in rows} == ids and len(ids) > 50
    codes = bpe.codec(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(codes.encode(r.text))
    assert all(bytes(r.ids) in texts[r.doc_id] for r in rows)


def test_awkward_rows(spark, awkward, no_docs):
    """The five rows of prose pass the rules, whatever their ids and sources;
    the four that are equal leave one, and the fifth differs in more than two bits."""
    want = {
        "quality_rules": [5, 5, 6, 10, None],
        "near_dedup": [5, 10],
        "secret_scan": [5, 10],
        "mix_sources": [5, 10],
    }
    docs, none = awkward, no_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, none = stage(spark, docs, FOLDER), stage(spark, none, FOLDER)
        assert docs.dtypes == awkward.dtypes and none.dtypes == awkward.dtypes, name
        rows = docs.collect()
        ids = [r.doc_id for r in rows] if name != "mix_sources" else {r.doc_id for r in rows}  # a row per pass
        assert sorted(ids, key=lambda i: (i is None, i)) == want[name], name
        assert all(set(r.text.split()) <= {*PROSE.split(), "other"} for r in rows) and none.collect() == []
        # later stages meet every awkward row, too
        other = stage(spark, awkward, FOLDER)
        assert other.dtypes == awkward.dtypes and len(other.collect()) >= len(rows), name
    encode = corpus_pipeline.STAGES[-1][1]
    assert {r.doc_id for r in encode(spark, docs, FOLDER).collect()} == {5, 10}
    assert sorted(str(r.doc_id) for r in encode(spark, awkward, FOLDER).collect()) == sorted(str(r.doc_id) for r in awkward.collect())
    assert encode(spark, none, FOLDER).collect() == []


def test_one_of_each_component(spark, awkward, some_docs):
    for docs in (awkward, some_docs):
        groups = {}
        found = simhash.near_duplicates(docs).collect()
        for r in found:
            groups.setdefault(r.component_id, []).append(r.doc_id)
        # rows without id come in with an equal or near text that has one
        want = sorted(min(i for i in ids if i is not None) for ids in groups.values())
        kept = simhash.one_of_each(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    alone = awkward.filter("doc_id IS NULL AND text IS NULL")
    assert simhash.one_of_each(alone.unionByName(alone)).count() == 1


def test_named_queries():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLES) <= set(queries.QUERIES)
