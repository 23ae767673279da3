import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from stocklens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    vocabulary = bpe.Vocabulary.load(PATH)
    return bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)


def agree(own, library, whole):
    encoder, decoder = own
    packed, want = encoder.encode(whole), library.encode(whole, add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == want, whole[:80]
    assert decoder.decode(packed) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(whole=st.text(max_size=60))
def test_any_text(own, library, whole):
    agree(own, library, whole)


def test_awkward_texts(own, library):
    rng = random.Random(3)
    pool = "abcdefghi   \n\t'stredvmll0123½²٣éèñßж中文字😀́ \x1c\x1d\x85 _-!?.,<|endoftext|>﻿​"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    for whole in [*texts, "", "a" * 5000, "́" * 300, " " * 3000 + "x", "ab" * 4000, "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "<|endoftext|><|endoftext|>"]:
        agree(own, library, whole)


def test_pairs_that_stay_apart_agree_with_merging(own, library):
    encoder, _ = own
    vocabulary, rng = encoder.vocabulary, random.Random(1)
    for _ in range(3000):
        left, right = rng.randrange(len(vocabulary.words)), rng.randrange(len(vocabulary.words))
        merged = encoder.ranks(vocabulary.words[left] + vocabulary.words[right])
        assert (merged == [left, right]) == vocabulary.stays_apart(left, right)


def test_caches_stay_bounded():
    memo = bpe.Memo(lambda x: x * 2, 10)
    assert [memo[x] for x in range(100)] == [2 * x for x in range(100)]
    assert len(memo) <= 10 and len(memo.old) <= 10


def test_query_on_documents(spark, sf_dir, documents, library):
    from stocklens.llm import registry

    got = {r.doc_id: r for r in registry.queries()["op1_bpe"](spark, sf_dir).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = library.encode(row.text, add_special_tokens=False).ids
        found = got[row.doc_id]
        assert found.n_tokens == len(ids)
        assert found.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs, library):
    rows = bpe.encode_decode(odd_docs, PATH).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_tokens == by_id[2].n_tokens == 0
    assert by_id[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert by_id[5].n_tokens == len(library.encode("long text " * 30_000, add_special_tokens=False).ids)
    assert sorted(r.n_tokens for r in rows if r.doc_id == 4) == [4, 4]
    assert bpe.encode_decode(no_docs, PATH).count() == 0


def test_encode_then_decode(odd_docs):
    tokens = bpe.encode(odd_docs, PATH)
    texts = {(r.doc_id, r.text) for r in bpe.decode(tokens, PATH).collect()}
    assert texts == {(r.doc_id, r.text or "") for r in odd_docs.select("doc_id", "text").collect()}
