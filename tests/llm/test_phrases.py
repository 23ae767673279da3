import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import compare, database

from stocklens.llm import phrases


def plain_words(text):
    """Words by piece, from the rule."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain_counts(rows, longest=5):
    counts = Counter()
    for lang, text in rows:
        for words in plain_words(text):
            counts[lang or "und", 0, ""] += len(words)
            counts.update((lang or "und", k, " ".join(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return counts


def plain_collocations(rows, least, longest=5, share=100, top=2000):
    counts = plain_counts(rows, longest)
    often = {key: f for key, f in counts.items() if key[1] >= 2 and f >= least}
    found = []
    for (lang, size, phrase), a in often.items():
        inside = any(g == lang and s > size and f" {phrase} " in f" {longer} " and 100 * f >= share * a for (g, s, longer), f in often.items())
        if inside:
            continue
        words, n, cuts = phrase.split(" "), counts[lang, 0, ""], []
        for k in range(1, size):
            first, rest = counts[lang, k, " ".join(words[:k])], counts[lang, size - k, " ".join(words[k:])]
            cuts.append((1000 * a * n // (first * rest), k, first, rest))
        score, _, first, rest = min(cuts)
        found.append((lang, score, a, phrase, first, rest, n))
    out = []
    for lang in {f[0] for f in found}:
        best = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[1], -f[2], f[3].encode()))[:top]
        out += [(lang, rank, phrase, a, first, rest, n, score) for rank, (_, score, a, phrase, first, rest, n) in enumerate(best, 1)]
    return sorted(out)


def texts(seed, documents=120):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "B", "c", "é", "\U0001f600", "x\x1cy", "d", "the", "ÀB"]
    marks = [" ", " ", " ", "  ", "\t", ", ", "\n", ".", "! "]
    return ["".join(vocabulary[w] + marks[m] for w, m in zip(rng.zipf(1.5, n) % 9, rng.integers(0, 9, n), strict=True)) for n in rng.integers(0, 40, documents)]


def test_words():
    for some in (texts(1), ["", "a", "", ".a.b", "a b", "B\t\tc\r\nD", "", "  "], [], [""]):
        distinct, words, owner, piece = phrases.words_of(pa.array(["skipped, text", *some], pa.string()).slice(1))
        got, names = {}, distinct.to_pylist()
        for w, k, p in zip(words.tolist(), owner.tolist(), piece.tolist(), strict=True):
            got.setdefault(k, {}).setdefault(p, []).append(names[w])
        assert [list(got.get(k, {}).values()) for k in range(len(some))] == [[p for p in plain_words(t) if p] for t in some]


def phrase_hashes(names, lang="en"):
    """The hash of each phrase, as a batch has it."""
    out = []
    for name in names:
        batch = phrases.Batch(pa.array([name]), pa.array([lang]))
        value = batch.hashes[:1]
        for k in range(1, len(batch.hashes)):
            value = phrases.extended(value, batch.hashes[k : k + 1])
        out += value.tolist()
    return np.array(out, np.uint64)


def test_hashes_and_filter(spark):
    batch = phrases.Batch(pa.array(["x ab c d", "Ab c"]), pa.array(["en", "de"]))
    pairs = phrases.extended(batch.hashes[[1, 4]], batch.hashes[[2, 5]])
    assert phrase_hashes(["ab c"]).tolist() == pairs[:1].tolist() and phrase_hashes(["ab c"], "de").tolist() == pairs[1:].tolist() and pairs[0] != pairs[1]
    assert len(set(phrase_hashes(["a b", "b a", "a b c", "ab", "a a", "a a a"]).tolist())) == 6
    rng = np.random.default_rng(0)
    members, others = rng.integers(0, 2**64, (2, 3000), np.uint64)
    frame = spark.createDataFrame([(int(h),) for h in members.view(np.int64)], "hash bigint")
    made = phrases.sized(3000).with_hashes(frame)
    assert made.has(members).all() and made.has(others).mean() < 0.02
    assert made.with_hashes(frame.limit(0)).has(members).all()


@pytest.mark.parametrize("seed, least, share, top", [(1, 3, 100, 2000), (2, 2, 60, 2000), (3, 5, 100, 7), (4, 3, 1, 5)])
def test_small_corpora(spark, seed, least, share, top):
    rows = [(k % 50, ["en", None, "de"][k % 3], t) for k, t in enumerate([*texts(seed), *texts(9, 1) * 6])]
    docs = spark.createDataFrame(rows, "doc_id int, lang string, text string").repartition(3)
    got = phrases.collocations(docs, least, share=share, top=top)
    assert sorted(map(tuple, got.collect())) == plain_collocations([r[1:] for r in rows], least, share=share, top=top)


@pytest.mark.parametrize("proposed", ["nothing", "some words", "one pair", "all"])
def test_whatever_the_sample_proposes(spark, monkeypatch, proposed):
    rows = [("en", t) for t in texts(5)]
    counts = plain_counts(rows)
    expected = {(k, s, p): f for (k, s, p), f in counts.items() if f >= 4 or s == 0}
    often = [(s, p) for (_, s, p) in expected if 1 <= s <= 4]
    chosen = {"nothing": [], "some words": [p for s, p in often if s == 1][::2], "one pair": [p for s, p in often if s == 2][:1], "all": [p for s, p in often]}[proposed]
    members = spark.createDataFrame([(int(h),) for h in phrase_hashes(chosen).view(np.int64)], "hash bigint")
    monkeypatch.setattr(phrases, "propose", lambda *_: phrases.Filter().with_hashes(members))
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, lang string, text string")
    assert {(r.lang, r["size"], r.phrase): r.f for r in phrases.mine(docs, 4).collect()} == expected


def test_sums_over_a_task():
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "size", "phrase", "f"])

    rows = [[("en", 1, f"w{k % 5}", k), (["en", "de"][k % 2], 1, f"x{k}", 1)] for k in range(40)]
    expected = Counter()
    for lang, size, phrase, f in (r for some in rows for r in some):
        expected[lang, size, phrase] += f
    for limit in (3, 30, 1000):
        out = list(phrases.summed(iter([batch(some) for some in rows]), limit))
        got = Counter()
        for b in out:
            for r in b.to_pylist():
                got[r["lang"], r["size"], r["phrase"]] += r["f"]
        assert got == expected and sum(b.num_rows for b in out) <= 80
    assert list(phrases.summed(iter([]))) == []


def test_exact_beyond_64_bits(spark):
    rows = [("en", 0, "", 10**13), ("en", 1, "a", 10**9 + 7), ("en", 1, "b", 3), ("en", 2, "a b", 3)]
    mined = spark.createDataFrame(rows, phrases.COUNTS)
    docs = spark.createDataFrame([(1, "en", "a")], "doc_id int, lang string, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(phrases, "mine", lambda *_: mined)
        (row,) = phrases.collocations(docs, 3).collect()
    assert row.score == 1000 * 3 * 10**13 // ((10**9 + 7) * 3)


def test_odd_rows(odd_docs, no_docs):
    got = phrases.collocations(odd_docs, 2)
    assert got.columns == "lang rank phrase a l r n score".split()
    assert sorted(map(tuple, got.collect())) == plain_collocations([(r.lang, r.text) for r in odd_docs.select("lang", "text").collect()], 2)
    assert phrases.collocations(no_docs).count() == 0


def test_query_on_documents(spark, sf_dir):
    from stocklens.llm import registry

    assert compare(spark, database(sf_dir), sf_dir, "op12_phrases", registry.queries()["op12_phrases"], phrases.ORACLE_SQL) == ""
