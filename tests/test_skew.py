"""One key holds a third of all rows, and no side is broadcast."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stocklens.functions import skew
from stocklens.operators import changes, joins, topk
from stocklens.plans import registry
from stocklens.session import WorkTables
from stocklens.sources.adapters import Tables

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}
ROWS = 60_000


@pytest.fixture
def strict(spark):
    old = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot(modulus):
    return F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % modulus)


def test_hot_product_in_carts(strict):
    cart = strict.range(0, ROWS, 1, 6).select(
        F.col("id").cast("string").alias("cart_item_id"), (F.col("id") % 500).alias("user_id"), F.lit("t").alias("share_token"),
        hot(900).alias("inventory_id"), F.lit("R1").alias("report_id"), F.lit(1).alias("quantity"),
    )
    stock = strict.range(0, 900).select("id", F.lit("R1").alias("report_id"), F.lit(5).alias("quantity"), F.lit(2).cast("decimal(12,2)").alias("price"))
    checked = joins.cart_line_checks(cart, stock)
    assert Counter(r.verdict for r in checked.select("verdict").collect()) == {"ok": ROWS}
    carts = joins.validate_cart(cart, stock)
    assert carts.agg(F.sum("line_count"), F.sum("total_amount")).collect()[0][:] == (ROWS, 2 * ROWS)
    joined = checked.select("cart_item_id", "verdict", "current_stock", "user_id", "share_token", "line_amount")
    assert joined.count() == ROWS and joined.collect()
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_hot_product_in_sales(strict):
    sales = strict.range(0, ROWS, 1, 6).select(
        F.concat(F.lit("p"), hot(900).cast("string")).alias("product_name"), F.lit(1).alias("quantity"),
        F.timestamp_seconds("id").alias("sale_date"), F.col("id").alias("line_id"),
    )
    stock = strict.range(0, ROWS, 1, 6).select(
        "id", F.concat(F.lit("p"), hot(600).cast("string")).alias("product_name"), F.lit("c").alias("category"),
        F.lit(1).cast("decimal(12,2)").alias("price"), F.lit(1).alias("quantity"), F.timestamp_seconds("id").alias("created_at"),
    )
    facts = topk.product_facts(stock, sales)
    want_sold = Counter("p7" if n % 3 == 0 else f"p{n % 900}" for n in range(ROWS))
    want_stock = Counter("p7" if n % 3 == 0 else f"p{n % 600}" for n in range(ROWS))
    rows = {r.product_name: r for r in facts.collect()}
    assert {name: row.sold for name, row in rows.items() if row.sold} == dict(want_sold)
    assert {name: row.stock for name, row in rows.items() if row.stock} == dict(want_stock)
    # Each task sends one row per product into the shuffle.
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum(") >= 2


def test_hot_user_in_views(strict):
    views = strict.range(0, ROWS, 1, 6).select(
        hot(50).alias("user_id"), (F.col("id") % 1000).cast("int").alias("item"), F.timestamp_seconds("id").alias("viewed_at")
    )
    got = {(r.user_id, r.position): r.item for r in topk.recently_viewed(views).collect()}
    seen = {}
    for n in reversed(range(ROWS)):
        items = seen.setdefault(7 if n % 3 == 0 else n % 50, [])
        if n % 1000 not in items and len(items) < 5:
            items.append(n % 1000)
    assert got == {(user, i + 1): item for user, items in seen.items() for i, item in enumerate(items)}


def test_hot_order_in_views(strict):
    items = strict.range(0, ROWS, 1, 6).select(
        F.col("id").alias("order_item_id"), hot(4000).alias("order_id"), F.col("id").alias("inventory_id"), F.lit("p").alias("product_name"),
        F.lit("c").alias("category"), F.lit(1).alias("unit_price"), F.lit(1).alias("quantity"), F.lit(1).alias("line_total"),
    )
    orders = strict.range(0, 4000).select(F.col("id").alias("order_id"), F.timestamp_seconds("id").alias("created_at"))
    views = joins.order_views(orders, items)
    rows = views.filter("order_id = 7").orderBy("position").collect()
    want = [n for n in range(ROWS) if n % 3 == 0 or n % 4000 == 7]
    assert [r["item"].order_item_id for r in rows] == want and [r.position for r in rows] == list(range(1, len(want) + 1))
    # No task meets the order as a whole.
    parts = skew.numbered(items, "order_id", "order_item_id").filter("order_id = 7").groupBy("chunk").count().collect()
    assert len(parts) > 200 and max(r["count"] for r in parts) < ROWS / 100
    assert views.select("order_id").distinct().count() == 4000


def test_half_of_the_pointers_are_null(strict):
    catalogs = strict.range(0, ROWS, 1, 6).select(
        F.col("id").alias("share_id"), F.lit("Stock").alias("title"), F.concat(F.lit("t"), "id").alias("token"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("R"), (F.col("id") % 1000).cast("string"))).alias("source_report_id"),
    )
    reports = strict.range(0, 1000).select(
        F.concat(F.lit("R"), "id").alias("report_id"), F.concat(F.lit("t"), "id").alias("token"), F.lit("f").alias("source_file_name"), F.timestamp_seconds("id").alias("created_at")
    )
    inventory = strict.range(0, 500).select(F.concat(F.lit("R"), "id").alias("report_id"))
    resolved = joins.resolve_catalog_report(catalogs, reports, inventory)
    counts = {r.resolved_by: r["count"] for r in resolved.groupBy("resolved_by").count().collect()}
    assert counts == {"source": ROWS // 4, "empty source": ROWS // 4, "token": 500, "none": ROWS // 2 - 500}
    # Rows without a key are dealt out by keys of their own.
    sizes = resolved.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == ROWS and max(sizes) < ROWS / 3


def test_hot_user_in_cart_additions(strict):
    stock = strict.range(0, 900).select(
        "id", F.lit("R1").alias("report_id"), F.concat(F.lit("p"), "id").alias("product_name"), F.lit("c").alias("category"),
        F.lit(1).cast("decimal(12,2)").alias("price"), F.lit(10**6).alias("quantity"),
    )
    cart = strict.createDataFrame(
        [], "cart_item_id long, user_id long, share_token string, inventory_id long, report_id string, product_name string, category string, unit_price decimal(12,2), quantity int, created_at timestamp"
    )
    adds = strict.range(0, ROWS // 3, 1, 6).select(
        F.col("id").cast("string").alias("request_id"), F.timestamp_seconds("id").alias("requested_at"), hot(500).alias("user_id"), F.lit("t").alias("share_token"),
        (F.col("id") % 900).alias("inventory_id"), F.lit(1).alias("quantity"),
    )
    catalogs = strict.createDataFrame([("t", "R1")], "share_token string, report_id string")
    lines, verdicts = changes.merge_cart(cart, adds, stock, catalogs)
    assert {r.verdict: r["count"] for r in verdicts.groupBy("verdict").count().collect()} == {"added": ROWS // 3}
    assert lines.agg(F.sum("quantity")).first()[0] == ROWS // 3


def test_every_row_of_an_ordering_has_its_position(strict):
    rows = strict.range(0, 5000, 1, 6).select("id", (F.col("id") * 7919 % 13).alias("price"))
    work = WorkTables(strict, "sorted")
    got = topk.positions({"price": rows.orderBy("price", F.desc("id")), "newest": rows.orderBy(F.desc("id")), "none": rows.limit(0)}, work).collect()
    want = {"price": sorted(range(5000), key=lambda i: (i * 7919 % 13, -i)), "newest": list(range(4999, -1, -1))}
    assert sorted((r.mode, r.position, r.id) for r in got) == sorted((mode, n, i) for mode, ids in want.items() for n, i in enumerate(ids, 1))


def test_sorted_catalogs_have_all_rows(spark, sf_dir):
    folder = f"{Path(sf_dir).parent}/sf0.01"
    total = Tables(spark, folder).inventory_data.count()
    got = registry.queries()["sort_catalog"](spark, folder).groupBy("mode").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("position").alias("places"), F.max("position").alias("last"))
    assert total > 200 and sorted(got.collect()) == [(mode, total, total, total, total) for mode in ("newest", "popularity", "price", "stock")]
