"""Registered queries: every operator over whole tables, with the parameters fixed."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stocklens.functions import columns as C
from stocklens.operators import changes, ingest, joins, rollups, scope, topk
from stocklens.plans import analytics, derived, insights
from stocklens.schemas import COLUMN_DEFAULTS, TABLES
from stocklens.session import WorkTables
from stocklens.sources.adapters import Tables
from stocklens.sources.tables import append_inventory as append_stored, conform_schema, load_tables as load_stored, read_inventory
from stocklens.sources.workbooks import is_workbook, read_workbooks as read_stored
from stocklens.streaming import jobs

AS_OF = "2024-06-01 00:00:00"
TODAY = "2024-06-01"
REPORT = "R3"
TOKEN = "https://shop.example.com/catalog/TOK8/?utm=1#top"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def as_result(df: DataFrame) -> DataFrame:
    """Output form: money as double, positions as bigint, internal sort keys left out."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.StructType):
            continue
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif field.name == "position":
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.TimestampNTZType):
            column = column.cast("timestamp")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return as_result(function(Tables(spark, folder)))

    _QUERIES[function.__name__] = run
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- shared inputs -----------------------------------------------------------


def _inventory(t: Tables) -> DataFrame:
    """Real-name rows of all reports."""
    return scope.report_rows(t.inventory_data, exclude_demo=True)


def _sales(t: Tables) -> DataFrame:
    return joins.order_lines(t.order_items, t.orders)


def _facts(t: Tables) -> DataFrame:
    return topk.product_facts(_inventory(t), _sales(t))


def _cells(t: Tables) -> DataFrame:
    return t.sql(derived.SPARK_CELLS)


class _Upload:
    """Ingestion steps over the derived workbooks; the few rows known of each file are kept, as in ingestion."""

    def __init__(self, t: Tables):
        work = WorkTables(t.spark, "upload")
        self.cells = _cells(t)
        self.header_rows = work.keep(ingest.detect_header_row(self.cells), "headers")
        self.named = work.keep(ingest.headers(self.cells, self.header_rows), "named")
        self.mapping = ingest.auto_map_columns(ingest.header_context(self.named))
        self.status = ingest.mapping_status(self.header_rows, self.mapping)
        self.records = ingest.cells_to_records(self.cells, self.header_rows, self.mapping, self.named)
        self.typed = ingest.type_rows(self.records, TODAY)


# --- sources and ingestion ---------------------------------------------------


def _workbook_folder(t: Tables, cells: str) -> tuple[str, WorkTables]:
    """A folder of workbook files that hold the cells, and one file of another kind."""
    work = WorkTables(t.spark, "workbooks")
    files = derived.pack_workbooks(t.sql(cells))
    other = files.limit(1).withColumn("path", F.lit("upload/notes.txt"))
    derived.save_workbooks(files.unionByName(other), f"{work.root}/files")
    return f"{work.root}/files", work


@query
def read_workbooks(t):
    folder, _ = _workbook_folder(t, derived.FILE_CELLS)
    return read_stored(t.spark, folder).withColumn("path", F.regexp_extract("path", "upload/[^/]+$", 0))


@query
def stream_ingest(t):
    """Workbooks read as a stream into the sink: what its inventory then holds."""
    folder, work = _workbook_folder(t, derived.UPLOAD_CELLS)
    sink = f"{work.root}/sink"
    jobs.stream_ingest(t.spark, folder, sink, f"{work.root}/checkpoint", TODAY, user_id=1, availableNow=True).awaitTermination()
    reports = t.spark.read.parquet(f"{sink}/uploaded_reports").select("report_id", "source_file_name")
    rows = t.spark.read.schema(TABLES["inventory_data"]).parquet(f"{sink}/inventory")
    return rows.join(reports, "report_id").select("source_file_name", "product_name", "category", "price", "quantity", "user_id", "entry_date")


@query
def stream_sales_trend(t):
    work = WorkTables(t.spark, "trend")
    sales = work.keep(_sales(t), "sales")
    stream = t.spark.readStream.schema(sales.schema).option("maxFilesPerTrigger", 4).parquet(f"{work.root}/sales")
    jobs.stream_sales_trend(stream, f"{work.root}/sink", f"{work.root}/checkpoint", availableNow=True).awaitTermination()
    return jobs.sales_trend_of(t.spark, f"{work.root}/sink")


@query
def stream_checkout(t):
    """Cart lines over several micro-batches, then the closing of every cart."""
    work = WorkTables(t.spark, "carts")
    lines = t.cart_items.withColumn("closes", F.lit(False))
    parts = max(4, t.spark.sparkContext.defaultParallelism)
    kept = work.keep(lines.repartition(parts, "cart_item_id"), "lines").drop("closes")

    def run(**options):
        stream = t.spark.readStream.schema(lines.schema).options(**options).parquet(f"{work.root}/lines")
        jobs.stream_checkout(stream, t.inventory_data, f"{work.root}/sink", f"{work.root}/checkpoint", availableNow=True).awaitTermination()

    run(maxFilesPerTrigger=-(-parts // 2))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema if f.name not in ("report_id", "user_id", "share_token", "created_at", "closes")]
    closings = kept.groupBy("report_id", "user_id", "share_token").agg(F.max("created_at").alias("created_at")).withColumn("closes", F.lit(True))
    closings = work.keep(closings.select("*", *nothing).select(*lines.columns), "closings")
    closings.write.mode("append").parquet(f"{work.root}/lines")
    run()  # all closings are one micro-batch
    return jobs.committed(t.spark, f"{work.root}/sink", "verdicts").drop("order_ref", "batch_id")


@query
def detect_header_row(t):
    return ingest.detect_header_row(_cells(t))


@query
def normalize_header(t):
    return _cells(t).select("path", "row_idx", "col_idx", C.normalize_header(F.col("value")).alias("normalized"))


@query
def header_context(t):
    return ingest.header_context(_Upload(t).named)


@query
def auto_map_columns(t):
    return _Upload(t).mapping


@query
def mapping_status(t):
    return _Upload(t).status.withColumn("missing_fields", F.array_join("missing_fields", ","))


@query
def apply_manual_mapping(t):
    upload = _Upload(t)
    overrides = upload.named.filter(F.col("header") == "Remark").select(
        "path", F.explode(F.array(F.lit("price"), F.lit("notes"))).alias("field"), "header"
    )
    return ingest.apply_manual_mapping(upload.mapping, upload.named, overrides)


@query
def cells_to_records(t):
    return _Upload(t).records


@query
def type_rows(t):
    return _Upload(t).typed.drop("raw_price", "raw_quantity")


@query
def normalize_rows(t):
    return ingest.normalize_rows(t.inventory_data, TODAY)


@query
def ingest_report(t):
    upload = _Upload(t)
    report = ingest.ingest_report(upload.header_rows, upload.named, upload.mapping, upload.typed, upload.status)
    return report.select(
        "path", "status", "detected_header_row", "rows_processed", "valid_rows", "failed_rows",
        F.array_join("raw_headers", "|").alias("raw_headers"),
        F.array_join("normalized_headers", "|").alias("normalized_headers"),
        F.array_join(F.map_keys("mapped_columns"), "|").alias("mapped_fields"),
    )


@query
def preview_rows(t):
    return ingest.preview_rows(_Upload(t).typed).select("path", "position", "row_idx", "product_name", "price", "quantity")


@query
def register_reports(t):
    files = _cells(t).select("path").distinct().withColumn("modificationTime", C.timestamp(AS_OF))
    return ingest.register_reports(files, user_id=1)


@query
def merge_product_master(t):
    rows = t.inventory_data.select(
        F.col("product_name").alias("name"), "category", "price", "quantity", F.col("id").alias("loaded_at")
    )
    return ingest.merge_product_master(t.products, rows)


@query
def import_products_strict(t):
    rows = t.sql(derived.TEMPLATE_ROWS).toDF(" Name ", "CATEGORY", "price", "Quantity")
    return ingest.import_products_strict(rows)


@query
def import_counts(t):
    return ingest.import_counts(ingest.import_products_strict(t.sql(derived.TEMPLATE_ROWS)))


@query
def load_tables(t):
    """Tables written as they are, with columns missing, and read with their declared types."""
    names = ["inventory_data", "products", "orders", "uploaded_reports", "app_users", "admin_requests"]
    work = WorkTables(t.spark, "tables")
    for name in names:
        work.keep(getattr(t, name).drop("status", "reorder_level"), name)
    loaded = load_stored(t.spark, work.root, names)
    counts = [
        table.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("row_count"),
            F.count_if(F.col("status") == COLUMN_DEFAULTS[name]["status"]).alias("defaults") if "status" in COLUMN_DEFAULTS.get(name, {})
            else F.count_if(F.col("reorder_level") == 10).alias("defaults") if "reorder_level" in table.columns
            else F.lit(0).cast("bigint").alias("defaults"),
        )
        for name, table in loaded.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def append_inventory(t):
    """The inventory written in two uploads into the bucketed sink, and one report of it read back."""
    path = f"{WorkTables(t.spark, 'inventory').root}/inventory"
    for part in (0, 1):
        append_stored(t.inventory_data.filter(F.col("id") % 2 == part), path, user_id=5)
    return read_inventory(t.spark, path, REPORT)


@query
def only_xlsx(t):
    """Which stored names the workbook reader would open."""
    paths = t.source("pages").select("page_id", F.concat(C.normalize_token(F.col("url")), F.element_at(
        F.array(*map(F.lit, [".xlsx", ".XLSX", ".xls", ".csv", ""])), (F.col("page_id") % 5 + 1).cast("int"))).alias("path"))
    return paths.withColumn("is_workbook", is_workbook(F.col("path"))).select("page_id", "is_workbook")


@query
def conform_products(t):
    return conform_schema(t.products, TABLES["products"], COLUMN_DEFAULTS["products"])


# --- filters and lookups -----------------------------------------------------


@query
def scope_inventory(t):
    return scope.scope_inventory(t.inventory_data, "user", 3)


@query
def filter_real_names(t):
    return scope.filter_real_names(t.inventory_data)


@query
def clean_category(t):
    return t.inventory_data.select(
        "id",
        C.clean_category(F.col("category")).alias("category"),
        C.clean_category(F.col("category"), fallback=True).alias("stored_category"),
    )


@query
def search_products(t):
    return scope.search_products(t.products, search="RING", category="PROMO").orderBy(F.desc("product_id"))


@query
def filter_catalog(t):
    return scope.filter_catalog(
        scope.report_inventory(t.inventory_data), search="r", category="PROMO", stock_level="low", branch="NATION_2"
    )


@query
def filter_catalog_out_of_stock(t):
    return scope.filter_catalog(scope.report_inventory(t.inventory_data), category="ECONOMY", stock_level="out")


@query
def report_inventory(t):
    return scope.newest_first(scope.report_inventory(t.inventory_data, REPORT, exclude_demo=True))


@query
def lookup_ci(t):
    keys = t.orders.select(F.upper("username").alias("key")).unionByName(
        t.admin_access_codes.select(F.upper("email").alias("key"))
    )
    return scope.lookup_many_ci(t.app_users, ["username", "email"], keys, "key")


@query
def lookup_ci_one(t):
    return scope.lookup_ci(t.app_users, ["username", "email"], "CUSTOMER#000000042")


@query
def visible_orders(t):
    return scope.visible_orders(t.orders, "user", 7, "Customer#000000011")


@query
def valid_catalogs(t):
    return scope.valid_catalogs(t.shared_catalogs, AS_OF)


@query
def code_validity(t):
    known = t.admin_requests.select(F.col("id").alias("request_id"), F.col("email").alias("request_email"))
    codes = t.admin_access_codes.join(known, "request_id")
    return scope.code_validity(codes, AS_OF, F.col("request_email")).select("id", "request_id", "is_valid")


@query
def reset_token_validity(t):
    return scope.reset_token_validity(t.admin_access_codes, AS_OF).select("id", "is_valid")


@query
def stock_status(t):
    return t.inventory_data.select(
        "id",
        C.stock_status(F.col("quantity"), F.col("reorder_level")).alias("stock_status"),
        C.product_stock_label(F.col("quantity")).alias("product_label"),
    )


@query
def catalog_facets(t):
    return scope.catalog_facets(scope.report_inventory(t.inventory_data))


@query
def request_notifications(t):
    return scope.request_notifications(
        t.admin_request_notifications, email="CUSTOMER7@example.com", username="customer#000000011"
    )


@query
def product_by_id(t):
    return scope.product_by_id(t.inventory_data, 59, role="user", user_id=3)


@query
def list_sales(t):
    return scope.list_sales(t.sales, t.products, date_from="1998-01-01", date_to="1999-06-30")


@query
def requests_by_status(t):
    return scope.requests_by_status(t.admin_requests, " Pending")


# --- joins -------------------------------------------------------------------


@query
def inventory_with_owner(t):
    return joins.inventory_with_owner(t.inventory_data, t.app_users)


@query
def sales_lines(t):
    return joins.sales_lines(t.sales, t.products)


@query
def order_lines(t):
    return _sales(t)


@query
def order_lines_of_report(t):
    return joins.order_lines(t.order_items, t.orders, REPORT)


@query
def report_listing(t):
    return joins.report_listing(t.uploaded_reports, t.shared_catalogs, t.inventory_data)


@query
def report_listing_fanout_safe(t):
    return joins.report_listing(t.uploaded_reports, t.shared_catalogs, t.inventory_data, limit=10, fanout_safe=True)


@query
def cart_with_stock(t):
    return joins.cart_with_stock(t.cart_items, t.inventory_data)


@query
def request_queue(t):
    return joins.request_queue(t.admin_requests, t.app_users, t.admin_access_codes)


@query
def latest_codes(t):
    return joins.latest_codes(t.admin_access_codes, usable_only=False).select("request_id", "latest.*")


@query
def merge_stock_and_sales(t):
    return _facts(t)


@query
def order_views(t):
    views = joins.order_views(t.orders, t.order_items)
    return views.select("order_id", "status", "total_amount", "created_at", "position", "item.*")


@query
def resolve_catalog_report(t):
    return joins.resolve_catalog_report(t.shared_catalogs, t.uploaded_reports, t.inventory_data)


@query
def repair_categories(t):
    return joins.category_suggestions(t.inventory_data, t.products)


@query
def cart_line_checks(t):
    return joins.cart_line_checks(t.cart_items, t.inventory_data)


@query
def validate_cart(t):
    return joins.validate_cart(t.cart_items, t.inventory_data)


@query
def catalog_by_popularity(t):
    return joins.catalog_by_popularity(scope.report_inventory(t.inventory_data), t.order_items)


def _page(t, **options):
    return analytics.catalog_page(
        TOKEN, AS_OF, t.shared_catalogs, t.uploaded_reports, t.inventory_data, t.order_items, **options
    )


@query
def catalog_page(t):
    return _page(t, search="r", sort="popularity")["products"]


@query
def catalog_page_metrics(t):
    return _page(t)["metrics"]


@query
def catalog_page_facets(t):
    return _page(t)["facets"]


# --- aggregates --------------------------------------------------------------


@query
def dashboard_metrics(t):
    return rollups.dashboard_metrics(t.inventory_data)


@query
def category_units(t):
    return rollups.category_units(t.inventory_data)


@query
def top_category_units(t):
    return rollups.top_category_units(t.inventory_data)


@query
def inventory_summary(t):
    return rollups.inventory_summary(t.inventory_data).orderBy(F.desc("inventory_value"))


@query
def entry_trend(t):
    return rollups.entry_trend(t.inventory_data)


@query
def product_rollup(t):
    return rollups.product_rollup(_inventory(t))


@query
def category_value(t):
    return rollups.category_value(_inventory(t)).orderBy(F.desc("value"))


@query
def units_sold(t):
    return rollups.units_sold(_sales(t))


@query
def total_units_sold(t):
    return rollups.total_units_sold(_sales(t))


@query
def sales_trend(t):
    return rollups.sales_trend(_sales(t)).orderBy("day")


@query
def business_summary(t):
    return insights.business_summary(_facts(t))


@query
def product_quantity(t):
    return rollups.product_quantity(t.inventory_data)


@query
def monthly_quantity(t):
    return rollups.monthly_quantity(t.inventory_data).orderBy("month")


@query
def category_quantity(t):
    return rollups.category_quantity(t.inventory_data).orderBy(F.desc("quantity"))


@query
def estimated_profit(t):
    return rollups.estimated_profit(t.inventory_data)


@query
def catalog_metrics(t):
    return rollups.catalog_metrics(t.inventory_data)


@query
def cart_summary(t):
    return rollups.cart_summary(t.cart_items)


@query
def rows_per_report(t):
    return joins.rows_per_report(t.inventory_data)


@query
def report_count(t):
    return rollups.report_count(t.uploaded_reports)


@query
def request_status_counts(t):
    return rollups.request_status_counts(t.admin_requests)


@query
def popularity(t):
    return joins.popularity(t.order_items)


@query
def category_share(t):
    return rollups.category_share(t.inventory_data)


# --- top-k and orderings -----------------------------------------------------


@query
def fast_movers(t):
    return topk.fast_movers(_facts(t))


@query
def slow_movers(t):
    return topk.slow_movers(_facts(t))


@query
def low_stock_products(t):
    return topk.low_stock_products(_facts(t))


@query
def valuable_products(t):
    return topk.valuable_products(_facts(t))


@query
def quantity_leaders(t):
    return topk.quantity_leaders(t.inventory_data)


@query
def quantity_laggards(t):
    return topk.quantity_laggards(t.inventory_data)


@query
def low_stock_rows(t):
    return topk.low_stock_rows(t.inventory_data)


@query
def dashboard_low_stock(t):
    return topk.dashboard_low_stock(t.inventory_data)


@query
def sort_catalog(t):
    """Every ordering of all rows, with their positions."""
    rows = scope.report_inventory(t.inventory_data)
    modes = ("newest", "price", "stock", "popularity")
    return topk.positions({mode: topk.sort_catalog(rows, mode, t.order_items).select("id") for mode in modes}, WorkTables(t.spark, "sorted"))


@query
def recent_activity(t):
    return topk.recent(t.activity_logs, 12, id_col="activity_id")


@query
def recent_orders(t):
    return topk.recent(t.orders, 12, id_col="order_id")


@query
def latest_report(t):
    return topk.latest_report(t.uploaded_reports)


@query
def latest_valid_catalog(t):
    return topk.latest_valid_catalog(t.shared_catalogs, AS_OF)


@query
def highest_value_row(t):
    return topk.highest_value_row(t.inventory_data)


def _item_views(t):
    return t.activity_logs.filter(F.col("action") == "view").select(
        F.col("actor_id").alias("user_id"),
        F.get_json_object("detail", "$.k").try_cast("int").alias("item"),
        F.col("created_at").alias("viewed_at"),
    )


@query
def recently_viewed(t):
    return topk.recently_viewed(_item_views(t))


@query
def stream_recently_viewed(t):
    work = WorkTables(t.spark, "views")
    views = work.keep(_item_views(t).repartition(4, "viewed_at"), "views")
    stream = t.spark.readStream.schema(views.schema).option("maxFilesPerTrigger", 2).parquet(f"{work.root}/views")
    jobs.stream_recently_viewed(stream, f"{work.root}/sink", f"{work.root}/checkpoint", availableNow=True).awaitTermination()
    return jobs.recently_viewed_of(t.spark, f"{work.root}/sink")


@query
def preview(t):
    return topk.preview(t.inventory_data, 100)


@query
def all_sales(t):
    return joins.all_sales(t.sales, t.products, t.order_items, t.orders)


# --- scalar functions --------------------------------------------------------


@query
def normalize_token(t):
    return t.source("pages").select("page_id", C.normalize_token(F.col("url")).alias("token"))


@query
def extract_product_id(t):
    return t.sql(derived.SCANNED).select("scan_id", C.extract_product_id(F.col("scanned")).alias("product_id"))


@query
def parse_payload(t):
    parsed = C.parse_payload(F.col("props"), "k int, name string")
    return t.source("events").select("event_id", parsed["k"].alias("k"), C.payload_label(F.col("props"))["name"].alias("name"))


@query
def to_price_and_count(t):
    entered = F.col("entered")
    return t.sql(derived.FORM_VALUES).select(
        "form_id",
        C.to_price(entered).alias("price"),
        C.price_problem(entered).alias("price_problem"),
        C.to_count(entered).alias("count"),
        C.count_problem(entered).alias("count_problem"),
    )


@query
def day_and_month_key(t):
    return t.inventory_data.select(
        "id", C.day_key(F.col("entry_date")).alias("day"), C.month_key(F.col("entry_date")).alias("month")
    )


@query
def normalize_email(t):
    return t.admin_access_codes.select("id", C.normalize_email(F.concat(F.lit(" "), F.upper("email"))).alias("email"))


@query
def title_status(t):
    return t.sql(derived.STATUS_CHANGES).select("change_id", C.title_status(F.col("status")).alias("status"))


@query
def file_stem(t):
    return t.source("pages").select("page_id", C.file_stem(C.normalize_token(F.col("url"))).alias("stem"))


@query
def filename_from_title(t):
    return t.shared_catalogs.select("share_id", C.filename_from_title(F.col("title")).alias("file_name"))


@query
def line_total(t):
    return t.inventory_data.select("id", C.line_total(F.col("price"), F.col("quantity")).alias("inventory_value"))


@query
def parse_expiry(t):
    return t.admin_access_codes.select("id", C.parse_expiry(F.col("expires_at")).alias("expires"))


@query
def default_if_falsy(t):
    return t.inventory_data.select("id", C.default_if_falsy(F.col("quantity"), 10).alias("quantity"))


# --- insights and charts -----------------------------------------------------


@query
def inventory_insights(t):
    return insights.inventory_insights(t.inventory_data)


@query
def business_insights(t):
    return insights.business_insights(_facts(t), rollups.category_value(_inventory(t)))


@query
def stock_insights(t):
    return insights.stock_insights(t.inventory_data)


@query
def stock_insights_short(t):
    return insights.stock_insights(t.inventory_data, short=True)


@query
def chart_series(t):
    return insights.chart_series(_facts(t), rollups.category_value(_inventory(t)), rollups.sales_trend(_sales(t)))


@query
def entry_chart_series(t):
    return insights.entry_chart_series(t.inventory_data)


@query
def upload_charts(t):
    return insights.upload_charts(t.inventory_data)


def _flat(part: str, df: DataFrame, label: str, value: str) -> DataFrame:
    return df.select(
        F.lit(part).alias("part"), F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value")
    )


@query
def decision_analytics(t):
    page = analytics.decision_analytics(t.inventory_data)
    parts = [
        _flat("fast_items", page["fast_items"], "product_name", "quantity"),
        _flat("slow_items", page["slow_items"], "product_name", "quantity"),
        _flat("low_stock", page["low_stock"], "product_name", "quantity"),
        _flat("monthly_sales", page["monthly_sales"], "month", "quantity"),
        _flat("profit_total", page["profit_total"].withColumn("label", F.lit("profit")), "label", "estimated_profit"),
        _flat("insights", page["insights"], "message", "position"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def business_analytics(t):
    page = analytics.report_analytics(t.inventory_data, t.order_items, t.orders, share=WorkTables(t.spark, "page"))
    parts = [
        _flat("fast_items", page["fast_items"], "product_name", "sold"),
        _flat("slow_items", page["slow_items"], "product_name", "stock"),
        _flat("low_stock", page["low_stock"], "product_name", "stock"),
        _flat("valuable_products", page["valuable_products"], "product_name", "value"),
        _flat("category_value", page["category_value_rows"], "category", "value"),
        _flat("sales_trend", page["sales_trend"], "day", "units"),
        _flat("insights", page["insights"], "message", "position"),
        _flat("summary", page["summary"], "top_selling_product", "total_inventory_value"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def dashboard(t):
    page = analytics.dashboard(t.inventory_data)
    metrics = page["metrics"].withColumn("label", F.lit("value"))
    parts = [
        _flat("metrics", metrics, "label", "total_inventory_value"),
        _flat("category_totals", page["category_totals"], "category", "units"),
        _flat("top_categories", page["top_categories"], "category", "position"),
        _flat("trend_points", page["trend_points"], "day", "units"),
        _flat("low_stock", page["low_stock"], "id", "position"),
        _flat("insights", page["insights"], "message", "position"),
        _flat("recent_rows", page["recent_rows"], "id", "position"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _all(t):
    names = ("inventory_data", "orders", "order_items", "shared_catalogs", "activity_logs", "uploaded_reports", "app_users", "cart_items")
    return {name: getattr(t, name) for name in names}


@query
def admin_dashboard(t):
    page = analytics.admin_dashboard(_all(t), AS_OF)
    listed = page["reports"].select("report_id", "row_count")
    parts = [
        _flat("users", page["users"], "user_id", "position"),
        _flat("reports", listed, "report_id", "row_count"),
        _flat("total_reports", page["total_reports"].withColumn("label", F.lit("reports")), "label", "total_reports"),
        _flat("latest_report", page["latest_report"], "report_id", "position"),
        _flat("latest_share", page["latest_share"], "share_id", "position"),
        _flat("shared_catalogs", page["shared_catalogs"], "share_id", "position"),
        _flat("orders", page["orders"].select("order_id", F.coalesce("position", F.lit(0)).alias("n")), "order_id", "n"),
        _flat("recent_activity", page["recent_activity"], "activity_id", "position"),
        _flat("fast_items", page["decision_fast_items"], "product_name", "quantity"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def user_dashboard(t):
    page = analytics.user_dashboard(_all(t), 7, "Customer#000000007", AS_OF)
    parts = [
        _flat("latest_share", page["latest_share"], "resolved_report_id", "share_id"),
        _flat("products", page["products"], "id", "position"),
        _flat("orders", page["orders"].select("order_id", F.coalesce("position", F.lit(0)).alias("n")), "order_id", "n"),
        _flat("cart", page["cart"], "cart_item_id", "current_stock"),
        _flat("cart_summary", page["cart_summary"], "user_id", "subtotal"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _manager(t):
    names = ("inventory_data", "products", "sales", "orders", "order_items", "shared_catalogs", "activity_logs", "uploaded_reports")
    return analytics.manager_dashboard({name: getattr(t, name) for name in names}, share=False)


@query
def manager_summary(t):
    return _manager(t)["business_summary"]


@query
def manager_fast_movers(t):
    return _manager(t)["business_fast_items"]


@query
def manager_insights(t):
    return _manager(t)["business_insights"]


@query
def report_view_charts(t):
    return analytics.report_view(REPORT, t.uploaded_reports, t.shared_catalogs, t.inventory_data)["charts"]


# --- table updates -----------------------------------------------------------


@query
def apply_inventory_edits(t):
    return changes.apply_inventory_edits(t.inventory_data, t.sql(derived.INVENTORY_EDITS), TODAY)


@query
def check_inventory_edits(t):
    return changes.check_inventory_edits(t.sql(derived.INVENTORY_EDITS), TODAY).select("edit_id", "problem")


@query
def apply_deletes(t):
    pending = t.orders.filter(F.col("status") == "Pending")
    return changes.apply_deletes(t.order_items, pending, "order_id")


def _merged(t):
    adds = t.sql(derived.CART_ADDS)
    sources = changes.cart_sources(t.shared_catalogs, adds, t.uploaded_reports, t.inventory_data, AS_OF)
    return changes.merge_cart(t.sql(derived.OPEN_CARTS), adds, t.inventory_data, sources)


@query
def merge_cart(t):
    return _merged(t)[1]


@query
def merge_cart_lines(t):
    return _merged(t)[0]


@query
def update_cart_quantity(t):
    return changes.update_cart_quantity(t.cart_items, t.sql(derived.SPARK_CART_CHANGES), t.inventory_data)


@query
def checkout(t):
    return changes.checkout(t.cart_items, t.inventory_data)["verdicts"].drop("order_ref")


@query
def checkout_inventory(t):
    return changes.checkout(t.cart_items, t.inventory_data)["inventory"].select("id", "report_id", "quantity")


def _checkout(t):
    return changes.checkout(t.cart_items, t.inventory_data, t.app_users)


@query
def checkout_orders(t):
    return _checkout(t)["orders"]


@query
def checkout_order_items(t):
    return _checkout(t)["order_items"]


@query
def checkout_cart(t):
    return _checkout(t)["cart"]


@query
def apply_repaired_pointers(t):
    resolved = joins.resolve_catalog_report(t.shared_catalogs, t.uploaded_reports, t.inventory_data)
    return changes.apply_repaired_pointers(t.shared_catalogs, resolved)


@query
def apply_order_status(t):
    return changes.apply_order_status(t.orders, t.sql(derived.STATUS_CHANGES))


@query
def clean_invalid_categories(t):
    return changes.clean_invalid_categories(t.inventory_data)


@query
def apply_category_repairs(t):
    return changes.apply_category_repairs(t.inventory_data, t.products)


@query
def normalize_stored_tokens(t):
    return changes.normalize_stored_tokens(t.source("pages").select("page_id", F.col("url").alias("token")))


@query
def upsert_shared_catalogs(t):
    return changes.upsert_shared_catalogs(t.shared_catalogs, t.uploaded_reports)


def _review(t):
    return changes.apply_review_decisions(t.admin_requests, t.admin_access_codes, t.sql(derived.REVIEW_DECISIONS))


@query
def review_requests(t):
    return _review(t)["requests"]


@query
def review_codes(t):
    return _review(t)["codes"]


@query
def review_notifications(t):
    return _review(t)["notifications"]


@query
def mark_codes_used(t):
    uses = t.orders.filter(F.col("status") == "Delivered").select(F.col("order_id").alias("id"), F.col("created_at").alias("used_at"))
    return changes.mark_codes_used(t.admin_access_codes, uses)


@query
def attach_pictures(t):
    pictures = t.uploaded_reports.select("token", F.concat("token", F.lit(".png")).alias("qr_filename"))
    return changes.attach_pictures(t.shared_catalogs, pictures)


@query
def append_activity(t):
    rows = t.orders.select(
        F.col("user_id").alias("actor_id"), F.lit("Checkout completed").alias("action"), F.col("created_at")
    )
    return changes.append_activity(t.activity_logs, rows)


@query
def reset_tables(t):
    emptied, removed = changes.reset_tables({name: getattr(t, name) for name in ("inventory_data", "orders", "app_users")})
    counts = [
        table.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count")) for name, table in emptied.items()
    ]
    return reduce(DataFrame.unionByName, counts).join(removed, "table_name", "left")
