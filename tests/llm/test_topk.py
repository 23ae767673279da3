import random

from compare import compare, database
from pyspark.sql import functions as F

from stocklens.llm import registry, topk


def test_query_against_sql(spark, sf_dir):
    con = database(sf_dir)
    assert compare(spark, con, sf_dir, "op4_topk", registry.queries()["op4_topk"], registry.oracle_sql()["op4_topk"]) == ""


def brute(rows, k):
    usable = [(i, [int(256 * x // 1) for x in v]) for i, v in rows if i is not None and v and all(x is not None and abs(x) < 1e30 and x == x for x in v)]
    out = []
    for q, w in usable:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(w, c)), i) for i, c in usable if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], start=1)]
    return sorted(out)


def test_ties_odd_vectors_and_small_blocks(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, 0.003]) for _ in range(rng.choice([6, 6, 3]))]) for i in range(400)]
    rows += [(1000, None), (1050, []), (1100, [1.0, None]), (1150, [float("nan")]), (1200, [float("inf"), 1.0]), (None, [1.0] * 6), (50, [0.5] * 6), (7, [0.5] * 6)]
    rows += [(2000 + i, [0.5] * 6) for i in range(200)]  # a hot vector
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, score string")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, query_rows=4, candidate_rows=37)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 131072)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


def test_queries_and_candidates_meet_without_a_join(spark):
    """The sides met in a join whose estimated size left out the copies of queries: they were collected to be broadcast."""
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(60)], "vec_id bigint, embedding array<double>")
    plan = topk.top_k(df, F.col("vec_id") % 50 == 0, query_rows=1, candidate_rows=7)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_many_cells_in_few_partitions(spark, monkeypatch):
    for name, value in (("CELL_QUERIES", 2), ("CELL_PAIRS", 3), ("MOST_PARTS", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(9)
    rows = [(rng.choice([50 * (i % 20), i]), [rng.choice([0.0, 0.5, -0.25, 0.003]) for _ in range(rng.choice([6, 4]))]) for i in range(500)]
    rows = [r for n, r in enumerate(rows) if r[0] % 50 or r[0] not in {x for x, _ in rows[:n]}]  # brute ranks each row that asks alone
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        found = topk.top_k(df, F.col("vec_id") % 50 == 0, query_rows=3, candidate_rows=20)
        assert sorted(tuple(r) for r in found.collect()) == brute(rows, 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_scores_of_few_and_of_many_bits_and_short_postings(spark):
    rng = random.Random(10)
    rows = [(i, [rng.choice([0.0] * 5 + [0.5, -0.25]) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, [rng.choice([0.0, 3e6, -2.5e6, 0.75]) for _ in range(8)]) for i in range(60)]
    rows += [(400, [-(2.0**20)]), (450, [2.0**20] * 12), (451, [0.0] * 11 + [2.0**22])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for blocks in ({}, {"query_rows": 2, "candidate_rows": 10}):
        assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **blocks).collect()) == brute(rows, 5)
