import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from stocklens.llm import mixing, quality, registry, secrets, simhash
from stocklens.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The input and every stage's output."""
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], sf_dir), name.replace(" ", "-")))
    return docs


def test_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_but_the_last_keep_the_columns(stages):
    assert all(after.columns == stages[0].columns for after in stages[1:-1])


def test_rejected_documents_go(spark, sf_dir, stages):
    good = quality.classify(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1")
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in good.collect()}


def test_one_document_of_each_group_stays(stages):
    groups = simhash.near_copies(stages[1]).collect()
    assert Counter(r.doc_id for r in stages[2].collect()) == Counter({r.component_id for r in groups})


def test_secrets_are_gone_and_documents_stay(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys()
    for key, row in before.items():
        found = secrets.base_spans(row.text)
        assert not secrets.base_spans(after[key].text) and after[key].n_chars == len(after[key].text)
        assert found or after[key].text == row.text


def test_documents_are_as_many_as_the_mix_takes(stages):
    times = Counter(r.doc_id for r in stages[4].collect())
    for row in mixing.mix(stages[3]).collect():
        assert abs(times.get(row.doc_id, 0) - row.taken / max(row.size, 1)) <= 0.5
    assert max(times.values()) == 2


def test_last_stage_against_the_library(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_run_is_the_stages(spark, sf_dir, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[5].collect()))


def test_stages_take_empty_and_odd_tables(spark, sf_dir, odd_docs, no_docs):
    for start in (no_docs, odd_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf_dir), "stage")
        assert docs.count() <= 24
