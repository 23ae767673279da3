"""Joins between the domain tables.

No join strategy is forced: Catalyst broadcasts a side only when its measured size is under the session threshold, and
AQE splits skewed partitions otherwise. Sides that can be reduced are aggregated to one row per key before the join.
"""

from pyspark.sql import Column, DataFrame, functions as F

from stocklens.functions import columns as C
from stocklens.functions.skew import numbered
from stocklens.operators.scope import filter_real_names
from stocklens.schemas import MONEY, UNCATEGORIZED
from stocklens.sources.tables import report_bucket


def inventory_with_owner(inventory: DataFrame, users: DataFrame) -> DataFrame:
    return inventory.join(users.select("user_id", "username"), "user_id", "left")


def sales_lines(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Recorded sales with product name and category."""
    named = products.select("product_id", F.col("name").alias("product_name"), "category")
    return sales.join(named, "product_id").select(
        "product_name", "category", "quantity", "sale_date", "total_amount", F.col("sale_id").alias("line_id")
    )


def order_lines(items: DataFrame, orders: DataFrame, report_id: str | None = None) -> DataFrame:
    """Order items as sales at the time of their order, real product names only."""
    if report_id is not None:
        orders = orders.filter(F.col("report_id") == report_id)
    times = orders.select("order_id", F.col("created_at").alias("sale_date"))
    return filter_real_names(items).join(times, "order_id").select(
        "product_name",
        "category",
        "quantity",
        "sale_date",
        F.col("line_total").alias("total_amount"),
        F.col("order_item_id").alias("line_id"),
    )


def all_sales(
    sales: DataFrame, products: DataFrame, items: DataFrame, orders: DataFrame, role: str = "admin"
) -> DataFrame:
    """Bag union of recorded sales and order lines; empty for anybody but staff. Recorded sales rank first."""
    parts = [filter_real_names(sales_lines(sales, products)), order_lines(items, orders)]
    recorded, ordered = (
        part.withColumns(
            {
                "sale_date": F.col("sale_date").cast("timestamp"),
                "source": F.lit(rank),
            }
        )
        for rank, part in enumerate(parts)
    )
    both = recorded.unionByName(ordered)
    return both if role in ("admin", "manager") else both.filter(F.lit(False))


def rows_per_report(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("report_id").agg(F.count("*").alias("row_count"))


def report_listing(
    reports: DataFrame, catalogs: DataFrame, inventory: DataFrame, limit: int | None = None, fanout_safe: bool = False
) -> DataFrame:
    """Reports with catalog picture and inventory row count, newest first.

    Joining catalogs and inventory row by row multiplies the count when several catalogs of one report share a picture.
    That count is the product of two per-report counts, so neither side is ever expanded; ``fanout_safe`` leaves the
    multiplication out.
    """
    rows = rows_per_report(inventory.filter(F.col("report_id").isNotNull()))
    shares = (
        catalogs.filter(F.col("source_report_id").isNotNull())
        .groupBy(F.col("source_report_id").alias("report_id"), "qr_filename")
        .agg(F.count("*").alias("shares"))
    )
    factor = F.lit(1) if fanout_safe else F.coalesce("shares", F.lit(1))
    listing = (
        reports.join(shares, "report_id", "left")
        .join(rows, "report_id", "left")
        .select(
            "report_id",
            "title",
            "source_file_name",
            "token",
            "created_at",
            "qr_filename",
            (F.coalesce("row_count", F.lit(0)) * factor).alias("row_count"),
        )
        .orderBy(F.desc("created_at"), F.desc("report_id"), "qr_filename")
    )
    return listing if limit is None else listing.limit(limit)


def cart_with_stock(cart: DataFrame, inventory: DataFrame) -> DataFrame:
    stock = inventory.select(
        F.col("id").alias("inventory_id"),
        "report_id",
        F.col("quantity").alias("current_stock"),
        "image_url",
        "branch_name",
        "supplier_name",
        "reorder_level",
    )
    return cart.join(stock, ["inventory_id", "report_id"], "left")


def latest_codes(codes: DataFrame, usable_only: bool = True) -> DataFrame:
    """Newest access code per request; by default among active unused codes.

    An aggregate, not a window: partial aggregation keeps one row per request and task before the shuffle.
    """
    if usable_only:
        codes = codes.filter((F.col("status") == "active") & F.col("used_at").isNull())
    newest = F.max_by(
        F.struct("code", "expires_at", "created_at", "status", "used_at"), F.struct("created_at", "id")
    )
    return codes.groupBy("request_id").agg(newest.alias("latest"))


def request_queue(requests: DataFrame, users: DataFrame, codes: DataFrame, status: str | None = None) -> DataFrame:
    """Review queue: request, reviewer name and newest usable code."""
    if status is not None:
        requests = requests.filter(F.col("status") == status)
    reviewers = users.select(F.col("user_id").alias("reviewed_by"), F.col("username").alias("reviewer_username"))
    latest = latest_codes(codes).select(
        F.col("request_id").alias("id"),
        F.col("latest.code").alias("latest_code"),
        F.col("latest.expires_at").alias("latest_code_expires_at"),
    )
    return requests.join(reviewers, "reviewed_by", "left").join(latest, "id", "left")


def merge_stock_and_sales(stock: DataFrame, sold: DataFrame) -> DataFrame:
    """One row per product with stock and units sold; products only ever sold have no stock, value or price.

    Both inputs are grouped by product name, so they are already partitioned alike and the join adds no shuffle.
    """
    zero = F.lit(0)
    stock = stock.withColumn("in_stock_list", F.lit(True))
    return stock.join(sold, "product_name", "full_outer").select(
        "product_name",
        F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category"),
        F.coalesce("stock", zero).cast("bigint").alias("stock"),
        F.coalesce("sold", zero).cast("bigint").alias("sold"),
        F.coalesce("value", zero.cast(MONEY)).alias("value"),
        F.coalesce("price", zero.cast(MONEY)).alias("price"),
        F.col("in_stock_list").isNull().alias("is_sales_only"),
        "newest_row",
        "first_sale",
    )


def order_views(orders: DataFrame, items: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest orders with their items: one row per item, by ``position`` (from 1, by item id) within the order.

    An order without items is one row without ``item``. One shape for orders of any size: no array grows with the data.
    An order that holds a large share of all items is spread over tasks, and the join with the orders meets its chunks,
    not all its rows at once.
    """
    if limit is not None:
        orders = orders.orderBy(F.desc("created_at"), F.desc("order_id")).limit(limit)
        items = items.join(orders.select("order_id"), "order_id", "left_semi")
    lines = numbered(items, "order_id", "order_item_id")
    line = F.struct("order_item_id", "inventory_id", "product_name", "category", "unit_price", "quantity", "line_total")
    lines = lines.select("order_id", "chunk", "position", line.alias("item"))
    heads = lines.select("order_id", "chunk").distinct().join(orders, "order_id", "right").withColumn("chunk", F.coalesce("chunk", F.lit(-1)))
    return heads.join(lines, ["order_id", "chunk"], "left").select(*orders.columns, "position", "item")


def known_categories(products: DataFrame) -> DataFrame:
    """Per lower-case product name, the category of the newest product that has one."""
    return (
        products.filter(F.lower("category") != UNCATEGORIZED.lower())
        .groupBy(F.lower("name").alias("name_key"))
        .agg(F.max_by("category", "product_id").alias("found"))
    )


def category_suggestions(inventory: DataFrame, products: DataFrame) -> DataFrame:
    """For uncategorized rows, the category of the newest product of the same name that has one."""
    return (
        inventory.filter(F.lower("category") == UNCATEGORIZED.lower())
        .withColumn("name_key", F.lower("product_name"))
        .join(known_categories(products), "name_key")
        .select("id", "product_name", "category", C.clean_category(F.col("found")).alias("new_category"))
    )


def resolve_catalog_report(
    catalogs: DataFrame, reports: DataFrame, inventory: DataFrame, row_counts: DataFrame | None = None, few: bool = False
) -> DataFrame:
    """The report behind each catalog, and the step that found it.

    Order: the source report when it has rows (even if its record is missing), the source report without rows, the
    token, the file name in the title, the latest report when it has rows. ``is_repaired`` marks pointers to rewrite.

    Whether reports have rows comes from ``row_counts``, a kept result of :func:`rows_per_report`, if given. For a
    ``few`` catalogs the inventory is asked for their reports only, which prunes its buckets; else each report is looked
    up in the distinct reports of the inventory.

    A catalog takes part in a step's join only with a key and while it is open. All others carry a key of their own that
    meets nothing, so neither nulls nor settled catalogs gather in one task.
    """
    newest = F.max_by("report_id", F.struct("created_at", "report_id"))
    last = reports.orderBy(F.desc("created_at"), F.desc("report_id")).limit(1).select("report_id")
    if row_counts is not None:
        filled = row_counts.filter(F.col("row_count") > 0).select("report_id")
    elif few:
        asked = catalogs.select(F.col("source_report_id").alias("report_id")).unionByName(last)
        by = ["report_id"]
        if "report_bucket" in inventory.columns:
            asked, by = asked.withColumn("report_bucket", report_bucket(F.col("report_id"))), ["report_id", "report_bucket"]
        filled = inventory.join(asked, by, "left_semi").select("report_id").distinct()
    else:
        filled = inventory.filter(F.col("report_id").isNotNull()).select("report_id").distinct()
    known = (
        reports.select("report_id", F.col("report_id").alias("id_report")).distinct()
        .join(filled.withColumn("has_rows", F.lit(True)), "report_id", "full_outer")
    )
    by_token = reports.groupBy(F.lower("token").alias("key")).agg(newest.alias("token_report"))
    by_file = reports.groupBy(F.lower("source_file_name").alias("key")).agg(newest.alias("file_report"))
    latest = last.join(filled, "report_id", "left_semi")

    alone = F.concat(F.lit("\0"), F.xxhash64(*catalogs.columns).cast("string"))

    def open_key(key: Column, is_open: Column) -> Column:
        return F.coalesce(F.when(is_open, key), alone)

    steps = (
        catalogs.withColumn("key", open_key(F.col("source_report_id"), F.lit(True)))
        .join(known.withColumnRenamed("report_id", "key"), "key", "left")
        .withColumn("is_open", F.col("has_rows").isNull() & F.col("id_report").isNull())
        .withColumn("key", open_key(F.lower(C.normalize_token(F.col("token"))), F.col("is_open")))
        .join(by_token, "key", "left")
        .withColumn("key", open_key(F.lower(C.filename_from_title(F.col("title"))), F.col("is_open") & F.col("token_report").isNull()))
        .join(by_file, "key", "left")
        .withColumn("latest_report", latest.scalar())
    )
    found = F.coalesce("id_report", "token_report", "file_report", "latest_report")
    step = (
        F.when(F.col("has_rows"), "source")
        .when(F.col("id_report").isNotNull(), "empty source")
        .when(F.col("token_report").isNotNull(), "token")
        .when(F.col("file_report").isNotNull(), "file name")
        .when(F.col("latest_report").isNotNull(), "latest")
        .otherwise("none")
    )
    resolved = F.when(F.col("has_rows"), F.col("source_report_id")).otherwise(
        F.coalesce(found, F.col("source_report_id"))
    )
    return steps.withColumn("resolved_report_id", resolved).withColumn("resolved_by", step).select(
        *catalogs.columns,
        "resolved_report_id",
        "resolved_by",
        (F.col("has_rows").isNull() & found.isNotNull()).alias("is_repaired"),
    )


def cart_line_checks(cart: DataFrame, inventory: DataFrame) -> DataFrame:
    """Cart lines with a verdict against current stock: ``ok``, ``missing`` or ``over stock``."""
    stock = inventory.select(
        F.col("id").alias("inventory_id"),
        "report_id",
        F.col("quantity").alias("current_stock"),
        F.col("price").alias("current_price"),
        F.lit(True).alias("found"),
    )
    wanted = F.coalesce("quantity", F.lit(0))
    verdict = (
        F.when(F.col("found").isNull(), "missing")
        .when(wanted > F.coalesce("current_stock", F.lit(0)), "over stock")
        .otherwise("ok")
    )
    return (
        cart.join(stock, ["inventory_id", "report_id"], "left")
        .withColumn("verdict", verdict)
        .withColumn("line_amount", C.line_total(F.col("current_price"), F.col("quantity")))
        .drop("found")
    )


def validate_cart(cart: DataFrame, inventory: DataFrame) -> DataFrame:
    """Verdict per cart; the total uses the inventory price."""
    bad = F.col("verdict")
    return (
        cart_line_checks(cart, inventory)
        .groupBy("user_id", "report_id")
        .agg(
            F.count("*").alias("line_count"),
            F.count_if(bad == "missing").alias("missing_lines"),
            F.count_if(bad == "over stock").alias("over_stock_lines"),
            F.bool_and(bad == "ok").alias("is_valid"),
            F.sum("line_amount").alias("total_amount"),
        )
    )


def popularity(items: DataFrame) -> DataFrame:
    """Units ordered per product name, over all reports."""
    return items.groupBy("product_name").agg(F.sum("quantity").alias("popularity"))


def catalog_by_popularity(rows: DataFrame, items: DataFrame, few: bool = False) -> DataFrame:
    """Rows with the units ordered of their product; for a ``few`` rows only items of their products are added up."""
    if few:
        items = items.join(rows.select("product_name").distinct(), "product_name", "left_semi")
    return rows.join(popularity(items), "product_name", "left").withColumn(
        "popularity", F.coalesce("popularity", F.lit(0))
    )
