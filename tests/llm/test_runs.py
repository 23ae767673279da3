import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from stocklens.llm import runs


def plain_runs(words):
    """(start, length, period) of all runs by trying every period at every place."""
    shortest = {}
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at + q < len(words):
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            if at + q - start >= max(6, 4 * q):
                shortest.setdefault((start, at + q), q)
            at += 1
    return sorted((s, e - s, q) for (s, e), q in shortest.items())


def grouped(documents, modulus=None):
    lengths = [len(d) for d in documents]
    words = np.concatenate([np.zeros(0, np.int64), *(np.asarray(d, np.int64) for d in documents)])
    out = [[] for _ in documents]
    for k, *run in zip(*(c.tolist() for c in runs.find_runs(words, np.array(lengths, np.int64), modulus)), strict=True):
        out[k].append(tuple(run))
    return out


def plain_row(doc_id, text):
    """The contract, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words) if n < 3000 else grouped([np.unique(words, return_inverse=True)[1]])[0]
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *(hashlib.sha256(t.encode()).hexdigest() for t in (listed, left)))


@pytest.mark.parametrize("modulus", runs.COVERS)
def test_covers(modulus):
    cover = runs.COVERS[modulus]
    assert {(a - b) % modulus for a in cover for b in cover} == set(range(modulus))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 2), max_size=60), st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(3, 9)).map(lambda t: t[0] * t[1])), max_size=5), st.sampled_from([None, *runs.COVERS]))
def test_runs(documents, modulus):
    assert grouped(documents, modulus) == [plain_runs(d) for d in documents]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=80), st.sampled_from(list(runs.COVERS)))
def test_extensions(words, modulus):
    n = len(words)
    extend = runs.Extensions(np.array([*words, 9]), np.zeros(n + 1, np.int64), modulus)
    a, b = np.triu_indices(n, 1)
    plain = [next((k for k in range(n - y) if words[x + k] != words[y + k]), n - y) for x, y in zip(a, b, strict=True)]
    assert extend(a, b).tolist() == plain


def test_grid_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    documents = [rng.integers(0, 2, n) for n in (0, 5, 300, 40)]
    whole = grouped(documents)
    monkeypatch.setattr(runs, "PLACES", 7)
    assert grouped(documents) == whole == [plain_runs(d.tolist()) for d in documents]


def test_long_periods_and_one_word():
    assert grouped([np.zeros(200_000, np.int64)]) == [[(0, 200_000, 1)]]
    assert grouped([np.tile(np.arange(20_000), 4)]) == [[(0, 80_000, 20_000)]]


def test_query_on_documents(spark, sf_dir, documents):
    from stocklens.llm import registry

    got = {r.doc_id: tuple(r) for r in registry.queries()["op11_runs"](spark, sf_dir).collect()}
    expected = {r.doc_id: plain_row(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()}
    assert got == expected and sum(r[1] > 0 for r in expected.values()) >= len(expected) // 20


def test_texts_and_odd_rows(spark, odd_docs, no_docs, make_docs):
    rows = [tuple(r) for r in runs.collapse(odd_docs, edit=runs.repeat_tail).collect()]
    assert sorted(map(str, rows)) == sorted(str(plain_row(r.doc_id, r.text)) for r in odd_docs.select("doc_id", "text").collect())
    assert runs.collapse(no_docs).count() == 0 and runs.collapse(no_docs).columns == runs.collapse(odd_docs).columns
    text = "go " + "a b " * 5 + "x x x x x x x end"
    row = runs.collapse(make_docs([(1, text), (1, text)]), out="text").collect()
    assert row[0] == row[1] and row[0].collapsed == "go a b x end"
    assert [tuple(r) for r in row[0].runs] == [(1, 10, 2), (11, 7, 1)] and (row[0].start, row[0].period, row[0].exponent_milli) == (11, 1, 7000)
