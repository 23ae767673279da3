import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stocklens.llm import common


def batches(sizes):
    return [pa.RecordBatch.from_arrays([pa.array([f"{n}-{k}" for k in range(n)])], names=["x"]) for n in sizes]


def test_batches_are_cut_and_put_together():
    whole = batches([1000, 3, 0, 700])
    texts = [x for b in whole for x in b.column(0).to_pylist()]
    for again, most in ((common.slices(iter(whole), 250), 250), (common.together(iter(whole), 400), 799)):
        got = list(again)
        assert [x for b in got for x in b.column(0).to_pylist()] == texts
        assert max(b.num_rows for b in got) <= most
    assert [b.num_rows for b in common.slices(iter(batches([10])), 250, size=1)] == [1] * 10


def test_words_of_texts():
    words, chosen, borders = common.split_words(pa.array(["a b  a", "", " x", "b\x0bc\x1cd"]))
    got = [[words[int(w)].as_py() for w in chosen[a:b]] for a, b in zip(borders, borders[1:], strict=False)]
    assert [[w for w in ws if w] for ws in got] == [["a", "b", "a"], [], ["x"], ["b", "c\x1cd"]]
    assert len(words) == len(set(words.to_pylist()))


def test_gather():
    values, ends = common.gather(np.array([0, 2, 2, 5]), np.arange(5), np.array([2, 0, 1, 0]))
    assert values.tolist() == [2, 3, 4, 0, 1, 0, 1] and ends.tolist() == [3, 5, 5, 7]


def test_join_with_a_hot_key(spark):
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 1000).alias("k"))
    left = left.unionByName(spark.sql("select 9999 as id, cast(null as bigint) as k"))
    right = spark.range(-1, 900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = {r.id: r.v for r in common.join_hot(left, right, "k").collect()}
    want = {i: -2 if i % 3 == 0 else i % 1000 * 2 if i % 1000 < 900 else None for i in range(6000)} | {9999: None}
    assert got == want
    assert common.join_hot(left.limit(0), right, "k").count() == 0


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2)], "_a int, _A_ int")
    assert common.unused(df, "_a", "b") == ["_a__", "b"]


def test_written_tables_keep_rows(spark):
    df = spark.range(10).select("id", F.lit(None).cast("string").alias("x"))
    assert sorted(map(tuple, common.written(df, "test").collect())) == [(n, None) for n in range(10)]


def test_order_of_a_hot_id(spark):
    rows = [(n if n % 3 else 7, f"text {n * 7919 % 3000:04d}") for n in range(3000)] + [(None, f"t{n}") for n in range(500)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        dealt = common.in_order(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
        got = [[tuple(r) for r in part] for part in dealt.rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [r for part in got for r in part] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert max(map(len, got)) < 2 * len(rows) / 8


def test_long_keys_are_not_kept():
    memo = common.Memo(len)
    assert memo["a" * 1_000_000] == 1_000_000 and memo["abc"] == 3 and list(memo) == ["abc"]
