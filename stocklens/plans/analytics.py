"""Pages as bundles of DataFrames over one shared input."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from stocklens.operators import joins, rollups, scope, topk
from stocklens.plans import insights
from stocklens.schemas import NO_DATE
from stocklens.session import WorkTables
from stocklens.sources.tables import report_bucket


class Bundle(dict):
    """Named DataFrames of one page, and the intermediate tables they share."""

    def __init__(self, shared: list[DataFrame], parts: dict[str, DataFrame]):
        super().__init__(parts)
        self.shared = shared

    def release(self) -> None:
        for table in self.shared:
            table.unpersist()


def _shared(df: DataFrame) -> DataFrame:
    # Aggregated tables only; partitions that do not fit go to disk, and lost ones are computed again.
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def business_analytics(inventory: DataFrame, sales: DataFrame, share: bool | WorkTables = True) -> Bundle:
    """Movers, low stock, values, trend, summary, insights and chart series of one report (or of all data).

    The product facts feed six parts, the category rollup two and the day totals two. They are aggregates, far smaller
    than the rows below them, and are kept while the bundle is in use: cached, or as tables of a run if ``share`` names
    one. Each is computed once, so the rows below are read three times, whatever the number of parts.
    """
    facts = topk.product_facts(inventory, sales)
    categories = rollups.category_value(inventory)
    trend = rollups.sales_trend(sales)
    shared = []
    if isinstance(share, WorkTables):
        facts, categories, trend = (share.keep(table, name) for name, table in (("facts", facts), ("categories", categories), ("trend", trend)))
    elif share:
        shared = [_shared(table) for table in (facts, categories, trend)]
    return Bundle(
        shared,
        {
            "summary": insights.business_summary(facts),
            "fast_items": topk.fast_movers(facts),
            "slow_items": topk.slow_movers(facts),
            "low_stock": topk.low_stock_products(facts),
            "valuable_products": topk.valuable_products(facts),
            "category_value_rows": categories.orderBy(F.desc("value"), F.desc("newest_row")),
            "sales_trend": trend.orderBy("day"),
            "insights": insights.business_insights(facts, categories),
            "charts": insights.chart_series(facts, categories, trend),
        },
    )


def report_analytics(
    inventory: DataFrame, items: DataFrame, orders: DataFrame, report_id: str | None = None, share: bool | WorkTables = True
) -> Bundle:
    """:func:`business_analytics` over the real-name rows and the order lines of one report."""
    return business_analytics(
        scope.report_rows(inventory, report_id, exclude_demo=True),
        joins.order_lines(items, orders, report_id),
        share,
    )


def decision_analytics(inventory: DataFrame) -> Bundle:
    """Leaders, laggards, low stock, months, profit, insights and chart data of an upload."""
    rows = inventory  # not kept: each part reads two or three columns, which costs less than storing all rows
    return Bundle(
        [],
        {
            "fast_items": topk.quantity_leaders(rows),
            "slow_items": topk.quantity_laggards(rows),
            "low_stock": topk.low_stock_rows(rows),
            "monthly_sales": rollups.monthly_quantity(rows).orderBy("month"),
            "profit_total": rollups.estimated_profit(rows),
            "insights": insights.stock_insights(rows),
            "charts": insights.upload_charts(rows),
        },
    )


def dashboard(inventory: DataFrame) -> Bundle:
    """Figures of a dashboard over the rows its reader may see."""
    return Bundle(
        [],
        {
            "metrics": rollups.dashboard_metrics(inventory),
            "category_totals": rollups.category_units(inventory),
            "top_categories": rollups.top_category_units(inventory),
            "trend_points": rollups.entry_trend(inventory),
            "low_stock": topk.dashboard_low_stock(inventory),
            "insights": insights.inventory_insights(inventory),
            "recent_rows": topk.preview(inventory, 8),
        },
    )


def admin_dashboard(tables: dict[str, DataFrame], as_of: str) -> Bundle:
    """Dashboard of an administrator over the stored tables, by table name."""
    t = tables
    parts = dict(dashboard(t["inventory_data"]))
    parts |= {f"decision_{name}": part for name, part in decision_analytics(t["inventory_data"]).items()}
    parts |= {
        "users": topk.recent(t["app_users"], 6, id_col="user_id"),
        "reports": joins.report_listing(t["uploaded_reports"], t["shared_catalogs"], t["inventory_data"], limit=6),
        "total_reports": rollups.report_count(t["uploaded_reports"]),
        "latest_report": topk.latest_report(t["uploaded_reports"]),
        "latest_share": topk.latest_valid_catalog(t["shared_catalogs"], as_of),
        "shared_catalogs": topk.recent(t["shared_catalogs"], 5, id_col="share_id"),
        "orders": joins.order_views(t["orders"], t["order_items"], limit=8),
        "recent_activity": topk.recent(t["activity_logs"], 8, id_col="activity_id"),
    }
    return Bundle([], parts)


def manager_dashboard(tables: dict[str, DataFrame], share: bool | WorkTables = True) -> Bundle:
    """Dashboard of a manager: here sales are recorded sales and order lines of all reports together."""
    t = tables
    sales = joins.all_sales(t["sales"], t["products"], t["order_items"], t["orders"], role="manager")
    business = business_analytics(scope.filter_real_names(t["inventory_data"]), sales, share)
    parts = dict(dashboard(t["inventory_data"]))
    parts |= {f"business_{name}": part for name, part in business.items()}
    parts |= {
        "orders": joins.order_views(t["orders"], t["order_items"], limit=10),
        "shared_catalogs": topk.recent(t["shared_catalogs"], 5, id_col="share_id"),
        "recent_activity": topk.recent(t["activity_logs"], 8, id_col="activity_id"),
        "latest_report": topk.latest_report(t["uploaded_reports"]),
    }
    return Bundle(business.shared, parts)


def user_dashboard(tables: dict[str, DataFrame], user_id: int, username: str, as_of: str) -> Bundle:
    """Dashboard of a shopper: newest shared catalog with its first rows, own orders and cart."""
    t = tables
    latest = topk.latest_valid_catalog(t["shared_catalogs"], as_of)
    inventory = t["inventory_data"]
    resolved = joins.resolve_catalog_report(latest, t["uploaded_reports"], inventory, few=True)
    found = resolved.select("resolved_report_id").first()
    rows = scope.typed_inventory(_rows_of(inventory, found and found[0]))
    own = scope.visible_orders(t["orders"], "user", user_id, username)
    cart = t["cart_items"].filter(F.col("user_id") == user_id)
    return Bundle(
        [],
        {
            "latest_share": resolved,
            "products": topk.preview(rows, 8),
            "orders": joins.order_views(own, t["order_items"], limit=8),
            "cart": joins.cart_with_stock(cart, t["inventory_data"]),
            "cart_summary": rollups.cart_summary(cart),
        },
    )


def report_view(report_id: str, reports: DataFrame, catalogs: DataFrame, inventory: DataFrame) -> Bundle:
    """Page of one report: its listing row, first rows, and chart series of all its rows."""
    mine = inventory.filter(F.col("report_id") == report_id)
    listed = reports.filter(F.col("report_id") == report_id)
    shares = catalogs.filter(F.col("source_report_id") == report_id)
    rows = scope.typed_inventory(mine)
    charts = insights.entry_chart_series(rows.withColumn("created_at", F.lit(None).cast("timestamp")))
    undated = (F.col("chart") == "trend") & (F.col("label") == NO_DATE)
    return Bundle(
        [],
        {
            "report": joins.report_listing(listed, shares, mine),
            "preview_rows": topk.preview(rows, 8),
            "charts": charts.withColumn("label", F.when(undated, "-").otherwise(F.col("label"))),
        },
    )


def _rows_of(inventory: DataFrame, report_id: str | None) -> DataFrame:
    """Inventory rows of a report; none without one."""
    report = F.lit(report_id)
    rows = inventory.filter(F.lit(False) if report_id is None else F.col("report_id") == report)
    return rows.filter(F.col("report_bucket") == report_bucket(report)) if "report_bucket" in inventory.columns and report_id is not None else rows


def catalog_page(
    token: str,
    as_of: str,
    catalogs: DataFrame,
    reports: DataFrame,
    inventory: DataFrame,
    items: DataFrame,
    search: str = "",
    category: str = "",
    stock_level: str = "",
    branch: str = "",
    sort: str = "newest",
    row_counts: DataFrame | None = None,
) -> Bundle:
    """Rows, metrics and facets of the catalog a link names; all empty when the link is not valid.

    The report of the one catalog is resolved first and is a literal in the page's plan, so its filter prunes the folders
    of other buckets and the row groups of other reports when the plan is made, and no join is left of the resolving. Only
    items of the page's products are added up for popularity.
    """
    catalog = scope.catalog_by_token(catalogs, token, as_of)
    found = joins.resolve_catalog_report(catalog, reports, inventory, row_counts, few=True).select("resolved_report_id").first()
    rows = scope.typed_inventory(_rows_of(inventory, found and found[0]))
    matching = scope.filter_catalog(rows, search, category, stock_level, branch)
    return Bundle(
        [],
        {
            "products": topk.sort_catalog(matching, sort, items, few=True),
            "metrics": rollups.catalog_metrics(rows),
            "facets": scope.catalog_facets(rows),
        },
    )
