import math

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from stocklens.functions import columns as C


def values(spark, texts, *rules):
    columns = [rule(F.col("x")).alias(f"v{i}") for i, rule in enumerate(rules)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").coalesce(1)
    return [tuple(row)[1:] for row in frame.select("i", *columns).orderBy("i").collect()]


TEXTS = st.lists(st.text(max_size=12), min_size=1, max_size=60)
RUNS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@RUNS
@given(TEXTS)
def test_strip_equals_python_strip(spark, texts):
    assert values(spark, texts, lambda x: C.strip(x)) == [(t.strip(),) for t in texts]


@RUNS
@given(TEXTS)
def test_normalizers_are_idempotent(spark, texts):
    once = [row[0] for row in values(spark, texts, lambda x: C.normalize_header(x))]
    assert [row[0] for row in values(spark, once, lambda x: C.normalize_header(x))] == once
    tokens = [row[0] for row in values(spark, texts, lambda x: C.normalize_token(x))]
    assert [row[0] for row in values(spark, tokens, lambda x: C.normalize_token(x))] == tokens


@RUNS
@given(st.lists(st.text(alphabet="0123456789._+-eE dfxinaNI ", max_size=8), min_size=1, max_size=80))
def test_numbers_follow_python(spark, texts):
    def as_float(text):
        try:
            number = float(text)
        except ValueError:
            return None
        return number if math.isfinite(number) and abs(number) < 1e9 else None

    def as_int(text):
        try:
            number = int(text)
        except ValueError:
            return None
        return number if 0 <= number < 2**31 else None

    got = values(spark, texts, lambda x: C.to_number(x), lambda x: C.to_count(x))
    for text, (number, count) in zip(texts, got):
        expected = as_float(text)
        if expected is not None:
            assert number == expected, text
        elif number is not None:
            assert abs(number) >= 1e9, text
        assert count == as_int(text), text


def test_category_rules(spark):
    texts = [None, "", " 　", "NaN", "none", "Null", "  Silk   Sarees\t Fine ", "Ünï  cat"]
    got = values(spark, texts, lambda x: C.clean_category(x), lambda x: C.clean_category(x, fallback=True))
    assert got[:6] == [(None, "Uncategorized")] * 6
    assert got[6:] == [("Silk Sarees Fine",) * 2, ("Ünï cat",) * 2]


def test_demo_names_are_substrings(spark):
    texts = ["Latest shirt", "DEMO", "Resampled", " ", None, "Silk saree", "QR Demo Product 1"]
    assert [r[0] for r in values(spark, texts, lambda x: C.is_real_name(x))] == [False, False, False, False, False, True, False]


def test_tokens_and_product_ids(spark):
    texts = [" https://x.example/catalog/abc/?a=1#z ", "abc#t", "///", "", None]
    assert [r[0] for r in values(spark, texts, lambda x: C.normalize_token(x))] == ["abc", "abc", None, None, None]
    texts = ["http://h/product/12?x", "34", '{"url": "/product/56"}', '{"name": "n"}', "x", "99999999999999999999"]
    assert [r[0] for r in values(spark, texts, lambda x: C.extract_product_id(x))] == [12, 34, 56, None, None, None]


def test_expiry_policies(spark):
    texts = [None, "", "2020-01-01", "2099-01-01T00:00:00Z", "soon", "2020"]
    as_of = C.timestamp("2024-01-01 00:00:00")
    got = values(spark, texts, lambda x: C.is_expired(x, as_of, True), lambda x: C.is_expired(x, as_of, False))
    assert got == [(False, False), (False, False), (True, True), (False, False), (True, False), (True, False)]


def test_form_problems(spark):
    got = values(spark, ["3", "3.5", "-1", "x", "1_000", None], lambda x: C.to_count(x), lambda x: C.count_problem(x))
    assert [g[0] for g in got] == [3, None, None, None, 1000, None]
    assert got[2][1] == "Quantity cannot be negative."
    assert got[1][1] == got[3][1] == got[5][1] == "Quantity must be a valid whole number."


def test_file_names_and_statuses(spark):
    texts = ["file:/a/b/Stock list.v2.xlsx", ".xlsx", "plain", "Catalog from  my file.xlsx "]
    got = values(spark, texts, lambda x: C.file_stem(x), lambda x: C.filename_from_title(x))
    assert got[:3] == [("Stock list.v2", None), (".xlsx", None), ("plain", None)]
    assert got[3][1] == "my file.xlsx"
    assert [r[0] for r in values(spark, [" pending", "LOST", None], lambda x: C.title_status(x))] == ["Pending", None, None]
