import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stocklens.llm import langid


def best_path(scores, penalty):
    """Viterbi for one document, state by state."""
    value, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(value)), key=lambda k: value[k])
        back.append([k if value[k] >= value[top] - penalty else top for k in range(len(value))])
        value = [max(value[k], value[top] - penalty) + row[k] for k in range(len(value))]
    label = max(range(len(value)), key=lambda k: value[k])
    path = [label]
    for row in reversed(back):
        label = row[label]
        path.append(label)
    return path[::-1]


def test_viterbi_of_many_documents():
    rng = np.random.default_rng(1)
    scores = -(rng.integers(0, 20, (50, 3)) + rng.random((50, 3))).astype(np.float32)
    lengths = [0, 1, 7, 3, 40, 0, 12]
    borders = np.concatenate([[0], np.cumsum(lengths)])
    words = rng.integers(0, 50, borders[-1])
    got = langid.viterbi(scores, words, borders, 9.5)
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        if b > a:
            assert got[a:b].tolist() == best_path(scores[words[a:b]].tolist(), 9.5)


def test_letters_have_scripts():
    names = list(langid.SCRIPTS)
    table = langid.letter_scripts()
    for text, name in [("aZéßÿĀẞ", "latin"), ("αΩἀ", "greek"), ("яЖ", "cyrillic"), ("שא", "hebrew"), ("عب", "arabic"), ("अक", "devanagari"), ("ไท", "thai"), ("한글", "hangul"), ("かカ", "kana"), ("中文", "han")]:
        assert {names[table[ord(c)] - 1] for c in text} == {name}
    assert all(table[ord(c)] == 0 for c in " 0.²_٣—\U0001f600")


@pytest.fixture(scope="module")
def model(documents):
    return langid.train(documents)


def test_held_out_accuracy(spark, sf_dir):
    from stocklens.llm import registry

    got = registry.queries()["op5_language"](spark, sf_dir)
    rows = got.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and held
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (pytest.importorskip("zlib").crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_mixed_language_spans(spark, documents, model, make_docs):
    texts = {r.lang: r.text for r in documents.filter(F.length("text").between(600, 3000) & F.col("lang").isin("en", "de") & ~F.col("text").contains("!!")).orderBy("lang", "doc_id").collect()}
    parts = [" ".join(texts[lang].split()[:60]) for lang in ("en", "de", "en")]
    row = langid.predict(make_docs([(1, " ".join(parts))]), model).collect()[0]
    assert [s.lang for s in row.spans] == ["en", "de", "en"] and row.lang_pred == "en"
    assert abs(row.spans[1].first_word - 60) <= 3 and abs(row.spans[1].words - 60) <= 5
    assert 0.5 < row.score < 0.8


def test_a_quotation_does_not_name_the_document(documents, model, make_docs):
    texts = {r.lang: r.text for r in documents.filter(F.length("text").between(600, 3000) & F.col("lang").isin("en", "fr") & ~F.col("text").contains("!!")).orderBy("lang", "doc_id").collect()}
    frame, quotation = texts["en"].split(), texts["fr"].split()
    around = " ".join([*frame[:25], *quotation[:80], *frame[25:50]])
    behind = " ".join([*frame[:50], *quotation[:80]])
    rows = {r.doc_id: r for r in langid.predict(make_docs([(1, around), (2, behind)]), model).collect()}
    assert rows[1].lang_pred == "en" and 0.2 < rows[1].score < 0.5
    assert rows[2].lang_pred == "fr" and rows[2].score > 0.5


def test_scripts_narrow_the_candidates(spark, make_docs):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    rows = [(i, " ".join(word("abcdefgh") for _ in range(30)), "s", "xx") for i in range(40)]
    rows += [(100 + i, " ".join(word("абвгдежз") for _ in range(30)), "s", "yy") for i in range(40)]
    model = langid.train(make_docs(rows))
    scores, letters = model.score_words(pa.array(["abc", "абв", "中文", "123", ""]))
    assert scores[0].tolist()[0] == 0 and scores[0][1] == langid.NEVER and scores[1].tolist() == [langid.NEVER, 0]
    assert not scores[2:].any() and letters.tolist() == [3, 3, 2, 0, 0]
    row = langid.predict(make_docs([(1, "中文")]), model).collect()[0]
    assert row.lang_pred in ("xx", "yy") and row.score == 0


def test_script_and_language_change_within_a_word(make_docs):
    rng = random.Random(4)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    kinds = {"xx": ("abcdefgh", 6, 30), "zz": ("中文字学生大小人", 40, 3), "yy": ("春夏秋冬山川花鳥", 40, 3)}
    rows = [(100 * k + i, " ".join(word(letters, size) for _ in range(count)), "s", lang) for k, (lang, (letters, size, count)) in enumerate(kinds.items()) for i in range(40)]
    model = langid.train(make_docs(rows))
    texts = ["abcdefgh" + word(kinds["zz"][0], 60), word(kinds["zz"][0], 64) + word(kinds["yy"][0], 40), "bad cab " + word(kinds["yy"][0], 9)]
    got = {r.doc_id: r for r in langid.predict(make_docs(list(enumerate(texts))), model).collect()}
    assert [got[k].lang_pred for k in range(3)] == ["zz", "zz", "yy"]
    assert [[tuple(s) for s in got[k].spans] for k in range(3)] == [[("xx", 0, 1), ("zz", 0, 1)], [("zz", 0, 1), ("yy", 0, 1)], [("xx", 0, 2), ("yy", 2, 1)]]


def test_pieces():
    words = pa.array(["plain", "Python中文", "м\u02bcята", "абвabc1где", "", "中" * 20, "12中", "été"])
    pieces, counts = langid._pieces(words)
    assert counts.tolist() == [1, 2, 1, 3, 1, 3, 1, 1]
    assert pieces.to_pylist() == ["plain", "Python", "中文", "м\u02bcята", "абв", "abc1", "где", "", "中" * 8, "中" * 8, "中" * 4, "12中", "été"]


def test_a_rare_language_is_learned(spark):
    common = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("abc bcd cde").alias("text"), F.lit("xx").alias("lang"))
    rare = spark.createDataFrame([(10**6 + i, "xyz yzx zxy", "rare") for i in range(6)], "doc_id bigint, text string, lang string")
    model = langid.train(common.unionByName(rare))
    assert model.languages == ["rare", "xx"]
    assert [r.lang_pred for r in langid.predict(rare, model).collect()] == ["rare"] * 6


def test_more_languages_than_a_byte_counts():
    scores = np.full((300, 300), -30, np.float32)
    np.fill_diagonal(scores, 0)
    words = np.repeat(np.arange(300), 2)
    assert langid.viterbi(scores, words, np.array([0, 600]), 1.0).tolist() == words.tolist()


def test_odd_rows(odd_docs, no_docs, make_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all((by_id[d].lang_pred, by_id[d].score, by_id[d].spans) == ("und", 0.0, []) for d in (1, 2, 3, 8))
    assert by_id[5].lang_pred == "en" and langid.identify(no_docs).count() == 0
    unlabelled = make_docs([(1, "some text", "s", None), (2, None, "s", None)])
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
