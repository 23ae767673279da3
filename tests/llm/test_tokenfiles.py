import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from stocklens.llm import pfor, tokenfiles
from stocklens.llm.common import shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(n=st.integers(0, 5000), top=st.sampled_from([1, 2, 100, 65536, 2**32 - 1]), share=st.sampled_from([0.5, 0.9, 0.95, 1.0]), seed=st.integers(0, 99))
def test_blocks_round_trip(n, top, share, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, top, n, dtype=np.uint32)
    values[rng.integers(0, max(n, 1), n // 40)] = rng.integers(0, 2**32, n // 40, dtype=np.uint32) if n else 0
    data, starts = pfor.pack(values, share)
    assert len(starts) == -(-n // pfor.BLOCK)
    assert np.array_equal(pfor.unpack(data, starts), values)


def test_outliers_do_not_widen_a_block():
    values = np.arange(1024, dtype=np.uint32) % 16
    plain = len(pfor.pack(values)[0])
    values[::100] = 2**31
    data, starts = pfor.pack(values)
    assert plain == pfor.HEAD.itemsize + 1024 * 4 // 8
    assert len(data) == plain + 6 * 11 and np.array_equal(pfor.unpack(data, starts), values)


def test_one_block_alone():
    values = np.arange(10_000, dtype=np.uint32)
    data, starts = pfor.pack(values)
    assert np.array_equal(pfor.unpack(data, starts[3:4]), values[3072:4096])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_agrees_with_the_library(library):
    rng = random.Random(6)
    pool = "abcdefghi   \n\t'stredvmll0123½²٣éèñßжΣÀ中文字😀́ \x1c\x1d\x85\xa0 _-!?.,<|endoftext|>﻿​"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["", " ", "x<|endoftext|> y<|startoftext|>", "J̌ Å", "A" * 3000]
    ids, counts = tokenfiles.WordEncoder(PATH, None).encode(pa.array(texts))
    ends = np.cumsum(counts)
    for whole, end, n in zip(texts, ends, counts, strict=True):
        assert ids[end - n : end].tolist() == library.encode(whole, add_special_tokens=False).ids, whole


def expected(rows, library):
    """(doc_id, start, n_tokens, crc) in ascending order of ids."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_on_documents(spark, sf_dir, documents, library):
    from stocklens.llm import registry

    got = sorted(tuple(r) for r in registry.queries()["op3_token_files"](spark, sf_dir).collect())
    rows = [tuple(r) for r in documents.select("doc_id", "text").orderBy("doc_id").collect()]
    assert got == expected(rows, library)


def test_odd_rows_and_small_files(spark, odd_docs, no_docs, library):
    folder = shared_folder(spark, "test-tokens")
    manifest = tokenfiles.write_files(odd_docs, folder, PATH, file_ids=10)
    assert manifest.count() > 1
    got = [(r.doc_id, r.start, r.n_tokens) for r in tokenfiles.read_files(spark, manifest).collect()]
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    key = lambda r: (r[0] is not None, r)
    assert sorted(got, key=lambda r: r[1]) == [r[:3] for r in expected(rows, library)]
    assert tokenfiles.token_files(no_docs, shared_folder(spark, "test-tokens"), PATH).count() == 0


def test_files_say_what_they_are():
    with pytest.raises(ValueError):
        tokenfiles.read_file(b"x" * 100)
