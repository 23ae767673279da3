import hashlib
import random

import numpy as np
import pytest

from stocklens.llm import ctph


def rolled(data: bytes) -> list[int]:
    """The rolling hash place by place."""
    out = []
    for i in range(len(data)):
        h = 0
        for k in range(min(8, i + 1)):
            h += int(ctph._TABLE[data[i - k]]) * pow(ctph._FACTOR, k, 1 << 32)
        h &= 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        out.append(h ^ h >> 13)
    return out


def test_rolling_hash():
    data = "Some tëxt of a few bytes, and more.".encode()
    assert ctph.rolling(data).tolist() == rolled(data)
    assert ctph.rolling(b"xxxx" + data)[-5:].tolist() == rolled(data)[-5:]  # only the last eight bytes count


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (0 if x == y else 2)))
        row = now
    return row[-1]


def plain_likeness(a, b):
    a, b = (ctph.REPEATED.sub(r"\1\1\1", s) for s in (a, b))
    run = min(4, len(a), len(b))
    if not run or not any(a[i : i + run] in b for i in range(len(a) - run + 1)):
        return 0.0
    return 1 - distance(a, b) / (len(a) + len(b))


def test_likeness_of_signatures():
    rng = random.Random(9)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("abcd" if rng.random() < 0.5 else "abcdefghijkl") for _ in range(rng.randrange(0, 50)))
        b = list(a)
        for _ in range(rng.randrange(0, 10)):
            b[rng.randrange(len(b) + 1) : rng.randrange(len(b) + 1)] = rng.choice(["", "x", "yz"])
        pairs.append((a, "".join(b)))
    a, b = zip(*pairs, strict=True)
    assert ctph.likeness_of(list(a), list(b)) == pytest.approx([plain_likeness(x, y) for x, y in pairs])


def test_alike_texts_have_alike_fingerprints(documents):
    texts = [r.text for r in documents.select("text").collect() if len(r.text) > 300]
    prints = [ctph.fingerprint(t.encode()) for t in texts]
    changed = [ctph.fingerprint((t[: len(t) // 3] + "changed" + t[len(t) // 3 :]).encode()) for t in texts]
    other = prints[1:] + prints[:1]
    assert np.median(ctph.likeness(prints, changed)) > 0.9
    assert (ctph.likeness(prints, changed) > 0.5).mean() > 0.97
    assert np.mean(ctph.likeness(prints, other)) < 0.05
    assert ctph.likeness(prints, prints).min() == 1


@pytest.mark.parametrize("text", ["", "a", "ab", "aaaa" * 9000, "ab" * 20_000, "word " * 40_000, "é" * 10])
def test_fingerprints_are_short(text):
    whole = ctph.fingerprint(text.encode())
    assert len(whole) < 3 * ctph.MOST + 10 and whole.count(":") == 3


def expected(rows):
    out = []
    for (key, whole), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = ctph.edit(whole, following)
        own, other, next_ = (ctph.fingerprint(t.encode()) for t in (whole, edited, following))
        near = [ctph.likeness([own], [x])[0] for x in (other, next_)]
        out.append((key, len(whole), hashlib.sha256(edited.encode()).hexdigest(), own, other, *near))
    return out


def in_order(rows):
    return sorted(((r.doc_id, r.text or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_query_on_documents(spark, sf_dir, documents):
    from stocklens.llm import registry

    got = sorted(tuple(r) for r in registry.queries()["op10_fingerprints"](spark, sf_dir).collect())
    assert got == sorted(expected(in_order(documents.select("doc_id", "text").collect())))


def test_edit():
    assert ctph.edit("abcde", "XYZ") == "abcXY"
    assert ctph.edit("abcd", "X") == "abX"
    assert ctph.edit("", "X") == "" and ctph.edit("a", "X") == "a"


def test_odd_rows(odd_docs, no_docs, make_docs):
    key = lambda r: (r[0] is not None, r)
    got = sorted((tuple(r) for r in ctph.compare_with_next(odd_docs).collect()), key=key)
    assert got == sorted(expected(in_order(odd_docs.collect())), key=key)
    assert ctph.compare_with_next(no_docs).count() == 0
    assert [r.near_next for r in ctph.compare_with_next(make_docs([(1, "alone")])).collect()] == [1.0]
    assert {r.fingerprint for r in ctph.fingerprints(make_docs([(1, None), (2, "")])).collect()} == {"0:::"}
