import pytest
from compare import compare, database
from pyspark.sql import functions as F

from stocklens.llm import mixing, registry


def test_query_against_sql(spark, sf_dir):
    con = database(sf_dir)
    assert compare(spark, con, sf_dir, "op8_mix", registry.queries()["op8_mix"], registry.oracle_sql()["op8_mix"]) == ""


def reshared(sizes, share, copies, weights):
    """Targets by sharing the excess again until none is above."""
    left, open_, out = sum(sizes) * share, set(range(len(sizes))), {}
    while open_:
        unit = left / sum(weights[i % len(weights)] for i in open_)
        above = {i for i in open_ if unit * weights[i % len(weights)] > copies * sizes[i]}
        if not above:
            return {**out, **{i: unit * weights[i % len(weights)] for i in open_}}
        for i in above:
            out[i] = copies * sizes[i]
            left -= out[i]
        open_ -= above
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 1], [1, 1000, 1], [0, 5, 7, 1, 0, 400], [3], [5] * 10])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, source_size bigint")
    got = {int(r.source[1:]): r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(reshared(sizes, 1.5, 2, (5, 2, 1)))


def test_sources_meet_their_targets(spark, make_docs):
    docs = make_docs([(i, "word " * (1 + i % 7), None if i % 5 == 0 else "" if i % 5 == 1 else f"s{i % 3}") for i in range(3000)])
    rows = mixing.mix(docs).groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert len(rows) == 5
    for row in rows:
        assert abs(row.taken - row.target) <= 8 and row.most <= 2
    total = docs.agg(F.sum(mixing.word_count("text"))).first()[0]
    assert sum(r.taken for r in rows) == int(total * 1.5)


def test_reruns_agree(documents):
    first, second = ({(r.doc_id, r.taken) for r in mixing.mix(documents.repartition(n)).collect()} for n in (3, 7))
    assert first == second


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 12
    assert all(r.taken == 0 for r in rows if r.size == 0) and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix(odd_docs.filter("doc_id in (1, 2)")).select("taken").distinct().collect()[0].taken == 0


def test_mixed_documents(odd_docs, no_docs, make_docs):
    assert mixing.mixed(odd_docs).columns == odd_docs.columns
    assert mixing.mixed(no_docs).count() == 0
    docs = make_docs([(i, "a b c d", "first" if i % 2 else "second") for i in range(200)])
    times = {r.doc_id: r["count"] for r in mixing.mixed(docs).groupBy("doc_id").count().collect()}
    taken = {r.doc_id: r.taken // 4 for r in mixing.mix(docs).collect() if r.taken}
    assert {d for d in times if d % 2} == set(range(1, 200, 2))  # weight 5: every document, twice at most
    assert all(abs(times.get(d, 0) - t) <= 1 for d, t in taken.items())
