"""Grouped and global aggregates.

All of them combine on the map side, so a hot product, category or report costs one row per task in the shuffle. Money
is summed as decimals: the result does not depend on the order in which partitions arrive.
"""

from pyspark.sql import Column, DataFrame, functions as F

from stocklens.functions import columns as C
from stocklens.functions.ranking import top_rows
from stocklens.schemas import COST_RATE, DASHBOARD_LOW_STOCK, DEFAULT_REORDER_LEVEL, MONEY, UNCATEGORIZED


def _units(quantity: Column) -> Column:
    return F.coalesce(F.sum(quantity), F.lit(0)).cast("bigint")


def _value() -> Column:
    return C.line_total(F.col("price"), F.col("quantity"))


def _or_zero(total: Column) -> Column:
    return F.coalesce(total, F.lit(0).cast(MONEY))


def dashboard_metrics(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count("*").alias("total_products"),
        _units(F.col("quantity")).alias("total_stock_units"),
        _or_zero(F.sum(_value())).alias("total_inventory_value"),
        F.count_if(F.coalesce("quantity", F.lit(0)) <= DASHBOARD_LOW_STOCK).alias("low_stock_items"),
    )


def newest_row_key() -> Column:
    """Sort key of the newest inventory row; the greatest key comes first in the newest-first row order."""
    return F.max(F.struct("created_at", "id"))


def category_units(inventory: DataFrame) -> DataFrame:
    """Units per stored category; a null category stays a group of its own."""
    return inventory.groupBy("category").agg(
        _units(F.col("quantity")).alias("units"), newest_row_key().alias("newest_row")
    )


def top_category_units(inventory: DataFrame, k: int = 5) -> DataFrame:
    return top_rows(category_units(inventory), k, F.desc("units"), F.desc("newest_row"))


def inventory_summary(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("category").agg(
        F.count("*").alias("total_products"),
        _units(F.col("quantity")).alias("total_units"),
        _or_zero(F.sum(_value())).alias("inventory_value"),
    )


def entry_day() -> Column:
    return C.day_key(F.coalesce(F.col("entry_date").cast("timestamp"), F.col("created_at")))


def entry_trend(inventory: DataFrame) -> DataFrame:
    """Units per entry day, else per day of creation."""
    return inventory.groupBy(entry_day().alias("day")).agg(_units(F.col("quantity")).alias("units"))


def product_rollup(inventory: DataFrame) -> DataFrame:
    """Stock, value and highest price per product; the category is that of its newest row, cleaned once per product."""
    name = C.strip(F.coalesce("product_name", F.lit("")))
    newest = F.max(F.struct("created_at", "id", "category"))
    return (
        inventory.groupBy(name.alias("product_name"))
        .agg(
            newest.alias("newest"),
            _units(F.col("quantity")).alias("stock"),
            _or_zero(F.sum(_value())).alias("value"),
            F.max(F.coalesce("price", F.lit(0).cast(MONEY))).alias("price"),
        )
        .select(
            "product_name",
            C.clean_category(F.col("newest.category"), fallback=True).alias("category"),
            "stock",
            "value",
            "price",
            F.struct("newest.created_at", "newest.id").alias("newest_row"),
        )
    )


def category_value(inventory: DataFrame) -> DataFrame:
    """Stock and value per clean category of each row."""
    return inventory.groupBy(C.clean_category(F.col("category"), fallback=True).alias("category")).agg(
        _units(F.col("quantity")).alias("stock"),
        _or_zero(F.sum(_value())).alias("value"),
        newest_row_key().alias("newest_row"),
    )


def _named_sales(sales: DataFrame) -> DataFrame:
    name = C.strip(F.coalesce("product_name", F.lit("")))
    return sales.withColumn("product_name", name).filter(F.col("product_name") != "")


def units_sold(sales: DataFrame) -> DataFrame:
    """Units per product; blank names are skipped."""
    return _named_sales(sales).groupBy("product_name").agg(_units(F.col("quantity")).alias("sold"))


def units_sold_in_order(sales: DataFrame) -> DataFrame:
    """:func:`units_sold` with the key of each product's first sale, which breaks ties between products."""
    key = [name for name in ("source", "sale_date", "line_id") if name in sales.columns]
    return (
        _named_sales(sales)
        .groupBy("product_name")
        .agg(_units(F.col("quantity")).alias("sold"), F.min(F.struct(*key)).alias("first_sale"))
    )


def total_units_sold(sales: DataFrame) -> DataFrame:
    """The figure shown as 'total orders': units, not orders."""
    return _named_sales(sales).agg(_units(F.col("quantity")).alias("total_orders"))


def sales_trend(sales: DataFrame) -> DataFrame:
    """Units sold per day; sales without a date under 'No date'."""
    return (
        _named_sales(sales)
        .groupBy(C.day_key(F.col("sale_date")).alias("day"))
        .agg(_units(F.col("quantity")).alias("units"))
    )


def product_quantity(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy(F.coalesce("product_name", F.lit("Unknown")).alias("product_name")).agg(
        _units(F.col("quantity")).alias("quantity")
    )


def monthly_quantity(inventory: DataFrame) -> DataFrame:
    month = C.month_key(F.coalesce(F.col("entry_date").cast("timestamp"), F.col("created_at")))
    return inventory.groupBy(month.alias("month")).agg(_units(F.col("quantity")).alias("quantity"))


def category_quantity(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy(F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category")).agg(
        _units(F.col("quantity")).alias("quantity")
    )


def estimated_profit(inventory: DataFrame) -> DataFrame:
    """Profit when cost is a fixed share of the price."""
    margin = F.lit(1).cast("decimal(2,1)") - F.lit(COST_RATE).cast("decimal(2,1)")
    return inventory.agg(_or_zero(F.sum(_value() * margin)).alias("estimated_profit"))


def catalog_metrics(rows: DataFrame) -> DataFrame:
    quantity = F.coalesce("quantity", F.lit(0))
    reorder = C.default_if_falsy(F.col("reorder_level"), DEFAULT_REORDER_LEVEL)
    return rows.agg(
        F.count("*").alias("total_products"),
        F.count_if(quantity > 0).alias("available_count"),
        F.count_if((quantity > 0) & (quantity <= reorder)).alias("low_stock_count"),
        _or_zero(F.sum(_value())).alias("inventory_value"),
    )


def cart_summary(cart: DataFrame) -> DataFrame:
    """Units, subtotal and number of catalogs per user.

    Spark expands a distinct count into two levels of aggregation, so no task holds a user's whole token list.
    """
    return cart.groupBy("user_id").agg(
        _units(F.col("quantity")).alias("item_count"),
        _or_zero(F.sum(C.line_total(F.col("unit_price"), F.col("quantity")))).alias("subtotal"),
        F.count_distinct(F.nullif(F.col("share_token"), F.lit(""))).alias("catalog_count"),
    )


def report_count(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count("*").alias("total_reports"))


def request_status_counts(requests: DataFrame) -> DataFrame:
    return requests.agg(
        F.count("*").alias("total_requests"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_requests") for s in ("pending", "approved", "rejected")],
    )


def category_share(inventory: DataFrame, k: int = 5) -> DataFrame:
    """Largest categories with their share of all units in percent."""
    units = category_quantity(inventory)
    total = units.agg(F.sum("quantity").alias("total")).scalar()
    share = F.col("quantity").cast("double") / F.when(total != 0, total).otherwise(F.lit(1)) * 100
    return top_rows(units, k, F.desc("quantity"), "category").withColumn("percent", F.round(share, 1))
