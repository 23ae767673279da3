import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stocklens.llm import simhash


def naive(text: str, shingle: int = 3) -> int:
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    runs = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys: list[int], radius: int = 2) -> dict[int, int]:
    """Smallest key (as signed number) reachable from each key."""
    keys = sorted(set(keys))
    array, root = np.array(keys, np.int64).view(np.uint64), list(range(len(keys)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= radius).tolist():
            a, b = find(i), find(i + 1 + j)
            root[max(a, b)] = min(a, b)
    return {k: keys[find(i)] for i, k in enumerate(keys)}


@pytest.mark.parametrize("text", ["", " \n ", "One", "one TWO", "a b c", "a b a b a b a b", "ÀÉ Ünï cöde  x y\x1cz", "w " * 500, "a\x0bb\x0cc d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == naive(text)


def test_spark_hash_is_the_shingle_hash(spark):
    words = ["a b c", "", "é ü x"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()
    assert [r.h & (2**64 - 1) for r in rows] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(2)
    for _ in range(200):
        differing = sum(1 << b for b in rng.sample(range(64), 2))
        parents = {0}
        for level in simhash.band_masks(2):
            parents = {n for n, (p, mask) in enumerate(level) if p in parents and not differing & mask}
            assert parents
    assert all(mask.bit_count() >= 50 for _, mask in simhash.band_masks(2)[-1])


def test_tree_finds_what_comparing_finds():
    rng = random.Random(4)
    keys = list({rng.getrandbits(64) for _ in range(100)} | {7 ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)})
    tree = simhash.Tree(2)
    for n, key in enumerate(keys):
        assert sorted(tree.insert(key)) == [k for k in range(n) if (keys[k] ^ key).bit_count() <= 2]


@pytest.mark.parametrize("shard", [4, 256])
def test_components_of_many_near_fingerprints(spark, shard):
    rng = random.Random(5)
    keys = {rng.getrandbits(64) for _ in range(300)} | {0}
    for centre in list(keys)[:5]:
        ball = [centre]
        for _ in range(250):  # chains of near copies around one text
            ball.append(rng.choice(ball) ^ (1 << rng.randrange(64)))
        keys |= set(ball)
    signed = [k - 2**64 if k >> 63 else k for k in keys]
    distinct = spark.createDataFrame([(k,) for k in signed], "fp bigint")
    labels = {r.node: r.label for r in simhash.components(simhash.links(distinct, 2, shard)).collect()}
    want = classes(signed)
    assert {k: labels.get(k, k) for k in signed} == want


def test_long_chain(spark):
    chain = spark.range(600).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = simhash.components(chain).collect()
    assert len(labels) == 601 and {r.label for r in labels} == {0}


def test_query_against_brute_force(spark, sf_dir, documents):
    from stocklens.llm import registry

    got = {r.doc_id: r for r in registry.queries()["op2_simhash"](spark, sf_dir).collect()}
    rows = documents.select("doc_id", "text").collect()
    prints = {r.doc_id: naive(r.text) for r in rows}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    want = classes([p - 2**64 if p >> 63 else p for p in prints.values()])
    label = {d: want[p - 2**64 if p >> 63 else p] for d, p in prints.items()}
    first = {}
    for d, lab in label.items():
        first[lab] = min(first.get(lab, d), d)
    assert {d: r.component_id for d, r in got.items()} == {d: first[lab] for d, lab in label.items()}


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.digest(odd_docs).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[d].fingerprint for d in (1, 2, 3)] == ["0" * 16] * 3
    assert [by_id[d].component_id for d in (1, 2, 3)] == [1, 1, 1]
    assert sorted(r.component_id or 0 for r in rows if r.doc_id is None) == [0, 1]  # one is empty, one alone
    assert simhash.digest(no_docs).count() == 0


def test_dedup_keeps_one_of_each(odd_docs, no_docs, make_docs):
    kept = simhash.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda d: (d is None, d or 0)) == [1, 4, 5, 6, 7, 8, 2**62, None]
    assert simhash.dedup(no_docs).count() == 0
    without = simhash.dedup(make_docs([(None, "same words here again"), (None, "Same words here again"), (None, "quite another text it is")]))
    assert without.count() == 2


def test_dedup_of_an_id_with_different_texts(make_docs):
    first, second, third = (" ".join(f"{w}{k}" for k in range(40)) for w in ("apple", "river", "stone"))
    kept = simhash.dedup(make_docs([(1, first), (2, second), (2, first), (2, third), (2, third), (3, second), (4, third)]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, first), (2, second), (2, third)]


def test_dedup_reads_and_shuffles_texts_once(spark, tmp_path, documents):
    path = str(tmp_path / "docs")
    documents.unionByName(documents.limit(20)).write.parquet(path)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = simhash.dedup(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    scans = [k for k, line in enumerate(lines) if "Scan parquet" in line and path in line]
    full = [k for k in scans if "IsNull(doc_id)" not in lines[k]]
    assert len(full) == 1 and any("ReusedExchange" in line for line in lines)
    python = [line for line in lines if "ArrowEvalPython" in line]
    assert len(python) == 2  # of rows whose id several have, and of rows without id
