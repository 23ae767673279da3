from datetime import datetime


from stocklens.operators import joins, rollups, scope, topk
from stocklens.plans import analytics, insights

T0 = datetime(2024, 1, 1)
REPORT = "report_id string, title string, token string, source_file_name string, status string, created_at timestamp"
CATALOG = "share_id long, title string, token string, source_report_id string, qr_filename string, status string, expires_at string, created_at timestamp"
INVENTORY = "id long, report_id string, user_id long, product_name string, category string, price decimal(12,2), quantity int, reorder_level int, supplier_name string, branch_name string, image_url string, entry_date date, created_at timestamp"


def inventory(spark, rows):
    full = [(i, r, 1, n, c, None, q, 0, None, None, None, None, T0) for i, r, n, c, q in rows]
    return spark.createDataFrame(full, INVENTORY)


def test_each_step_of_the_report_cascade(spark):
    reports = spark.createDataFrame(
        [
            ("R1", "a", "tok1", "a.xlsx", "active", T0),
            ("R2", "b", "tok2", "b.xlsx", "active", T0),
            ("R3", "c", "tok3", "c.xlsx", "active", T0),
            ("R4", "d", "tok4", "C.xlsx", "active", datetime(2024, 2, 1)),
            ("R9", "e", "tok9", "e.xlsx", "active", datetime(2024, 3, 1)),
        ],
        REPORT,
    )
    rows = inventory(spark, [(1, "R1", "x", None, 1), (2, "bare", "x", None, 1), (3, "R9", "x", None, 1)])
    catalogs = spark.createDataFrame(
        [(n, title, token, source, None, "active", None, T0) for n, (title, token, source) in enumerate([
            ("t", "z", "R1"), ("t", "z", "bare"), ("t", "z", "R2"), ("t", "x/TOK3?a", "none"), ("Catalog from  c.XLSX", "z", None),
            ("t", "z", None),
        ])],
        CATALOG,
    )
    got = {r.share_id: (r.resolved_report_id, r.resolved_by, r.is_repaired) for r in joins.resolve_catalog_report(catalogs, reports, rows).collect()}
    assert got == {
        0: ("R1", "source", False), 1: ("bare", "source", False), 2: ("R2", "empty source", True), 3: ("R3", "token", True),
        4: ("R4", "file name", True), 5: ("R9", "latest", True),
    }
    empty = joins.resolve_catalog_report(catalogs, reports, rows.filter("report_id <> 'R9'")).filter("share_id = 5").collect()[0]
    assert (empty.resolved_report_id, empty.resolved_by, empty.is_repaired) == (None, "none", False)


def test_listing_multiplies_rows_of_shared_pictures(spark):
    reports = spark.createDataFrame([("R1", "a", "t", "a", "active", T0), ("R2", "b", "u", "b", "active", T0)], REPORT)
    catalogs = spark.createDataFrame([(n, "t", f"k{n}", "R1", q, "active", None, T0) for n, q in enumerate(["p", "p", "q", None])], CATALOG)
    rows = inventory(spark, [(n, "R1", "x", None, 1) for n in range(3)])

    def counts(**options):
        return {(r.report_id, r.qr_filename): r.row_count for r in joins.report_listing(reports, catalogs, rows, **options).collect()}

    assert counts() == {("R1", "p"): 6, ("R1", "q"): 3, ("R1", None): 3, ("R2", None): 0}
    assert counts(fanout_safe=True) == {("R1", "p"): 3, ("R1", "q"): 3, ("R1", None): 3, ("R2", None): 0}


def test_orders_of_any_size_have_one_shape(spark):
    orders = spark.createDataFrame([(1, T0), (2, T0), (3, T0)], "order_id long, created_at timestamp")
    items = spark.createDataFrame(
        [(n, 1 if n < 250 else 2, n, "p", "c", 1.0, 1, 1.0) for n in range(252)],
        "order_item_id long, order_id long, inventory_id long, product_name string, category string, unit_price double, quantity int, line_total double",
    )
    rows = joins.order_views(orders, items).collect()
    assert [(r.position, r["item"].order_item_id) for r in sorted(rows, key=lambda r: r.position or 0) if r.order_id == 1] == [(n + 1, n) for n in range(250)]
    assert [(r.position, r["item"].order_item_id) for r in rows if r.order_id == 2] == [(1, 250), (2, 251)] or len(rows) == 253
    assert [(r.position, r["item"]) for r in rows if r.order_id == 3] == [(None, None)]
    assert {r.order_id for r in joins.order_views(orders, items, limit=2).collect()} == {3, 2}


def test_small_inventories_get_a_hint_only(spark):
    rows = inventory(spark, [(1, "R1", "x", None, 1), (2, "R1", "y", None, 1)])
    messages = insights.inventory_insights(rows).collect()
    assert len(messages) == 1 and messages[0].message.startswith("Upload at least three")


def test_empty_report_has_fallback_texts(spark):
    rows = inventory(spark, [(1, "R1", "x", None, 1)]).filter("id < 0")
    sales = spark.createDataFrame([], "product_name string, category string, quantity int, sale_date timestamp, line_id long")
    page = analytics.business_analytics(rows, sales)
    assert [r.message for r in page["insights"].collect()] == ["Upload real inventory and order data to generate business recommendations."]
    summary = page["summary"].collect()[0]
    assert (summary.total_products, summary.low_stock_count, summary.top_selling_product) == (0, 0, "No orders yet")
    assert [r.message for r in insights.stock_insights(rows).collect()] == ["Upload inventory records to generate analytics."]
    page.release()


def test_ties_follow_first_seen_order(spark):
    rows = inventory(spark, [(1, "R1", "old", "a", 5), (2, "R1", "new", "b", 5), (3, "R1", "new", "c", 0)])
    sales = spark.createDataFrame(
        [("sold later", 5, T0, 2), ("sold first", 5, T0, 1), ("old", 5, T0, 3), ("new", 5, T0, 4)],
        "product_name string, quantity int, sale_date timestamp, line_id long",
    )
    facts = topk.product_facts(rows, sales)
    assert [r.product_name for r in topk.fast_movers(facts).orderBy("position").collect()] == ["new", "old", "sold first", "sold later"]
    assert {r.product_name: r.category for r in facts.collect()}["new"] == "c"
    leader = insights.leading_products(facts).collect()[0]
    assert leader.fast.product_name == "new" and leader.low.product_name == "sold first"


def test_zero_reorder_level_counts_as_ten(spark):
    rows = inventory(spark, [(1, "R1", "x", None, 10), (2, "R1", "y", None, 11), (3, "R1", "z", None, 0)])
    metrics = rollups.catalog_metrics(rows).collect()[0]
    assert (metrics.available_count, metrics.low_stock_count) == (2, 1)
    assert {r.id for r in scope.filter_catalog(scope.report_inventory(rows), stock_level="low").collect()} == {1, 3}


def test_nobody_else_sees_inventory(spark):
    rows = inventory(spark, [(1, "R1", "x", None, 10)])
    assert scope.scope_inventory(rows, "guest").count() == 0 and scope.scope_inventory(rows, "user").count() == 0
    assert scope.scope_inventory(rows, "manager").count() == 1


def test_sales_are_for_staff(spark, sf_dir):
    from stocklens.sources.adapters import Tables

    t = Tables(spark, sf_dir)
    assert joins.all_sales(t.sales, t.products, t.order_items, t.orders, role="user").count() == 0


def test_invalid_link_gives_an_empty_page(spark):
    reports = spark.createDataFrame([("R1", "a", "tok1", "a", "active", T0)], REPORT)
    catalogs = spark.createDataFrame([(1, "t", "tok1", "R1", None, "active", "2020-01-01", T0)], CATALOG)
    rows = inventory(spark, [(1, "R1", "x", None, 1)])
    page = analytics.catalog_page("tok1", "2024-01-01 00:00:00", catalogs, reports, rows, rows)
    assert page["products"].count() == 0 and page["metrics"].collect()[0].total_products == 0
    page = analytics.catalog_page("tok1", "2019-01-01 00:00:00", catalogs, reports, rows, rows)
    assert page["products"].count() == 1
