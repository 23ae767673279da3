import zlib

import numpy as np
import pyarrow as pa
import pytest

from stocklens.llm import quality


def test_gradients():
    rng = np.random.default_rng(0)
    x, bags, y = rng.normal(size=(9, 22)), np.array([2, 4, 3]), np.array([1.0, 0, 1])
    model = quality.fit([x[:2], x[2:6], x[6:]], y, epochs=1)

    def loss():
        s = model.forward(x, bags)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, gradient in model.gradients(x, bags, y, 0).items():
        w = model.weights[name]
        for at in list(np.ndindex(w.shape))[::7]:
            kept, ends = w[at], []
            for shift in (1e-5, -1e-5):
                w[at] = kept + shift
                ends.append(loss())
            w[at] = kept
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(gradient[at], abs=1e-6)


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(3)
    bags, labels = [], []
    for k in range(400):
        bag = rng.normal(size=(6, 5))
        if k % 2:
            bag[rng.integers(6), 0] += 6
        bags.append(bag)
        labels.append(k % 2 == 0)
    model = quality.fit(bags, np.array(labels, float), epochs=60)
    found = model.forward(np.concatenate(bags), np.full(400, 6))
    assert ((found["score"] > 0.5) == np.array(labels)).mean() > 0.97
    attention = found["attention"].reshape(400, 6)[1::2]
    bad = np.array([b[:, 0].argmax() for b in bags[1::2]])
    assert attention[np.arange(200), bad].mean() > 0.5


def plain_features(words):
    data = " ".join(words).replace(" ", "").encode()
    shares = [sum(b in set(members) for b in data) / max(len(data), 1) for members in quality.CLASSES.values()]
    n = max(len(words), 1)
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return shares, [sum(len(w.encode()) for w in words) / n / 10, repeated / n, len(set(words)) / n, np.log2(1 + len(words)) / 6]


def test_features(documents):
    texts = [r.text for r in documents.limit(40).collect()] + ["", " \n", "One!", " x"]
    got, bags = quality.passages(pa.array(texts))
    at = 0
    for text, n in zip(texts, bags, strict=True):
        words = text.split()
        assert n == max(1, -(-len(words) // quality.PASSAGE))
        for k in range(n):
            shares, others = plain_features(words[k * quality.PASSAGE : (k + 1) * quality.PASSAGE])
            assert got[at + k, : len(shares)] == pytest.approx(shares, abs=1e-5)
            assert got[at + k, -4:] == pytest.approx(others, abs=1e-4)
        at += n
    assert at == len(got)


def test_held_out_accuracy(spark, sf_dir, documents):
    from stocklens.llm import registry

    rows = registry.queries()["op7_quality"](spark, sf_dir).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_scores_do_not_depend_on_the_batch(documents, spark, sf_dir):
    model = quality.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = [r.text or "" for r in documents.select("text").collect()][:400]
    alone = np.concatenate([model.forward(*quality.passages(pa.array([t])))["score"] for t in texts])
    for size in (7, 250):
        parts = [model.forward(*quality.passages(pa.array(texts[at : at + size])))["score"] for at in range(0, len(texts), size)]
        assert np.array_equal(alone, np.concatenate(parts))
    assert np.array_equal(model.score(pa.array(texts)), alone.round(9))


def test_fits_agree(documents, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    first, second = (quality.train(documents.repartition(n), labels) for n in (2, 5))
    assert all(np.array_equal(first.weights[k], second.weights[k]) for k in first.weights)


def test_odd_rows(spark, odd_docs, no_docs, make_docs):
    schema = "doc_id bigint, quality int, toxic int, text string, score string"
    labels = spark.createDataFrame([(4, 1, 0, "x", "x"), (5, 0, 0, "x", "x"), (5, 0, 0, "x", "x"), (8, None, 0, "x", "x"), (None, 1, 0, "x", "x"), (999, 0, 0, "x", "x")], schema)
    rows = quality.classify(odd_docs, labels).collect()
    assert len(rows) == 12 and len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert quality.classify(no_docs, labels).count() == 0
    assert {r.score for r in quality.classify(odd_docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(odd_docs, labels.limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == 12
    assert quality.keep_good(no_docs, labels).count() == 0


def test_of_a_repeated_id_one_text_trains(spark, documents, sf_dir, monkeypatch):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda bags, y: fitted.append((len(bags), [b.tobytes() for b in bags], y.tolist())))
    one = documents.join(labels.select("doc_id"), "doc_id", "left_semi").filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0").orderBy("doc_id").limit(1)
    for docs in (documents, documents.unionByName(one.crossJoin(spark.range(50)).drop("id"))):
        quality.train(docs, labels)
    assert fitted[0] == fitted[1] and fitted[0][0] > 10
