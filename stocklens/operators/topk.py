"""Top-k lists and orderings.

``orderBy(...).limit(k)`` runs as TakeOrderedAndProject: each task keeps k rows, and only those are merged. Every list
ends in keys that reproduce the first-seen order of the rows, so ties are settled the same way each time.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stocklens.functions import columns as C
from stocklens.functions.ranking import top_rows
from stocklens.operators import joins, rollups, scope
from stocklens.schemas import DASHBOARD_LOW_STOCK
from stocklens.session import WorkTables


def product_facts(inventory: DataFrame, sales: DataFrame) -> DataFrame:
    """Stock and sales per product: the table under the movers, summaries and insights."""
    return joins.merge_stock_and_sales(rollups.product_rollup(inventory), rollups.units_sold_in_order(sales))


def first_seen() -> list[Column]:
    """Order in which products are met: newest inventory first, then sold-only products by first sale."""
    return [F.asc("is_sales_only"), F.desc("newest_row"), F.asc("first_sale")]


def fast_movers(facts: DataFrame, k: int = 10) -> DataFrame:
    return top_rows(facts.filter(F.col("sold") > 0), k, F.desc("sold"), *first_seen())


def slow_movers(facts: DataFrame, k: int = 5) -> DataFrame:
    return top_rows(facts.filter(F.col("stock") > 0), k, "sold", F.desc("stock"), *first_seen())


def low_stock_products(facts: DataFrame, k: int = 8) -> DataFrame:
    return top_rows(facts.filter(F.col("stock").between(0, 9)), k, "stock", *first_seen())


def valuable_products(facts: DataFrame, k: int = 5) -> DataFrame:
    return top_rows(facts, k, F.desc("value"), *first_seen())


def quantity_leaders(inventory: DataFrame, k: int = 5) -> DataFrame:
    return top_rows(rollups.product_quantity(inventory), k, F.desc("quantity"), "product_name")


def quantity_laggards(inventory: DataFrame, k: int = 5) -> DataFrame:
    return top_rows(rollups.product_quantity(inventory), k, "quantity", "product_name")


def low_stock_rows(inventory: DataFrame, k: int | None = 10) -> DataFrame:
    """Rows with fewer than ten units, lowest first; all of them when no k is given."""
    rows = inventory.filter(F.coalesce("quantity", F.lit(0)) < 10)
    return rows if k is None else top_rows(rows, k, "quantity", "id")


def dashboard_low_stock(inventory: DataFrame, k: int = 5) -> DataFrame:
    rows = inventory.filter(F.coalesce("quantity", F.lit(0)) <= DASHBOARD_LOW_STOCK)
    return recent(rows, k)


def sort_catalog(rows: DataFrame, mode: str = "newest", items: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Catalog rows by price, stock or popularity; any other mode means newest first."""
    row_order = [F.desc("created_at"), F.desc("id")]
    if mode == "price":
        return rows.orderBy("price", *row_order)
    if mode == "stock":
        return rows.orderBy(F.desc("quantity"), *row_order)
    if mode == "popularity":
        return joins.catalog_by_popularity(rows, items, few).orderBy(F.desc("popularity"), *row_order)
    return rows.orderBy(F.desc("id"))


def positions(orderings: dict[str, DataFrame], work: WorkTables) -> DataFrame:
    """All rows of ordered tables, with the table's name as ``mode`` and their ``position`` (from 1) in it.

    Spark sorts by ranges, one to a task. The sorted rows are written once, numbered within their ranges, because ranges
    drawn anew could differ; the sizes of the ranges, one row for each task, give what comes before.
    """
    placed = [df.select(F.lit(mode).alias("mode"), F.monotonically_increasing_id().alias("_at"), "*") for mode, df in orderings.items()]
    # the upper bits number the task, the lower 33 its rows
    rows = work.keep(reduce(DataFrame.unionByName, placed), "rows").withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy("mode").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("mode", "_range").count().select("mode", "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(offsets), ["mode", "_range"]).withColumn("position", F.col("_before") + within).drop("_at", "_range", "_before")


def recent(df: DataFrame, n: int, time_col: str = "created_at", id_col: str = "id") -> DataFrame:
    return top_rows(df, n, F.desc(time_col), F.desc(id_col))


def latest_report(reports: DataFrame) -> DataFrame:
    return recent(reports, 1, id_col="report_id")


def latest_valid_catalog(catalogs: DataFrame, as_of: str) -> DataFrame:
    """Newest valid catalog, however many newer ones have expired."""
    return recent(scope.valid_catalogs(catalogs, as_of), 1, id_col="share_id")


def highest_value_row(inventory: DataFrame) -> DataFrame:
    value = C.line_total(F.col("price"), F.col("quantity"))
    return inventory.withColumn("value", value).orderBy(F.desc("value"), F.desc("created_at"), F.desc("id")).limit(1)


def recently_viewed(views: DataFrame, k: int = 5) -> DataFrame:
    """Per user the last k distinct items, most recent first.

    Views are first reduced to the last one per user and item. The rank filter is then applied before the shuffle too
    (WindowGroupLimit), so a very active user sends at most k rows per task.
    """
    last = views.groupBy("user_id", "item").agg(F.max("viewed_at").alias("viewed_at"))
    order = Window.partitionBy("user_id").orderBy(F.desc("viewed_at"), F.desc("item"))
    return last.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def preview(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    return recent(df, n, id_col=id_col)
