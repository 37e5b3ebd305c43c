"""The pipeline's stages on odd and empty tables, each against what it is to do."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import odd_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, odd_dir):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, odd_dir))
        tables.append(docs)
    return tables


def test_columns(stages):
    assert all(t.columns == COLUMNS for t in stages[1:-1])


def test_rejected_languages_go(stages):
    left = {r.doc_id for r in stages[1].collect()}
    assert not left & {62, 63, 64, 65} and set(range(60)) <= left
    assert all(r.lang for r in stages[1].collect())


def test_one_document_of_each_group_stays(stages):
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {c for i, (n, c) in brute.components(before).items() if i is not None}
    after = [r.doc_id for r in stages[2].collect()]
    assert sorted(i for i in after if i is not None) == sorted(want)
    assert after.count(None) == 1


def test_secrets_are_masked_and_nothing_else(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    changed = {i for i in before if before[i].text != after[i].text}
    assert changed == {68} and "hunter2secret" not in after[68].text and "AKIA" not in after[68].text
    assert all(not brute.secret_spans(r.text) for r in after.values())


def test_mix_meets_the_targets(stages):
    sizes: dict = {}
    for r in stages[3].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.WORDS.findall(r.text))
    given: dict = {}
    for r in stages[4].collect():
        given[r.source] = given.get(r.source, 0) + len(brute.WORDS.findall(r.text))
    assert all(abs(given.get(s, 0) - t) <= 1 for s, t in brute.mix_targets(sizes).items())


def test_ids_are_those_of_the_texts(stages, tokenizers_brute):
    texts = sorted((str(r.doc_id), r.text) for r in stages[4].collect())
    want = sorted((i, tokenizers_brute.byte.encode(t, add_special_tokens=False).ids) for i, t in texts)
    assert sorted((str(r.doc_id), list(r.ids)) for r in stages[5].collect()) == want


def test_run_and_empty_tables(spark, odd_dir, empty_dir, stages):
    key = lambda r: (str(r.doc_id), r.ids_sha256, r.decoded_sha256)
    assert sorted(map(key, corpus_pipeline.run(spark, odd_dir).collect())) == sorted(map(key, stages[5].collect()))
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
    assert len(odd_documents()) > len({r.doc_id for r in stages[2].collect()})
