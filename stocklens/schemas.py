"""Fixed values and table schemas shared by every module."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# They decide results, so they are spelled out as they are.
# ---------------------------------------------------------------------------

REQUIRED_FIELDS = ["product_name", "price", "quantity"]
MAPPING_FIELDS = ["product_name", "category", "price", "quantity", "date"]

# Header aliases per field, in order of preference.
HEADER_ALIASES = {
    "product_name": [
        "product_name",
        "product name",
        "product",
        "item_name",
        "item name",
        "item",
        "material_name",
    ],
    "category": [
        "category",
        "product_category",
        "product category",
        "category_name",
        "category name",
        "department",
        "dept",
        "type",
        "item_type",
        "item type",
        "product_type",
        "product type",
    ],
    "price": [
        "price",
        "cost_price_per_unit_usd",
        "cost price per unit usd",
        "cost_price_per_unit",
        "cost price per unit",
        "unit_price",
        "unit price",
        "product_price",
        "product price",
        "cost",
        "selling_price",
        "selling price",
        "rate",
        "amount",
    ],
    "quantity": [
        "hand_in_stock",
        "hand in stock",
        "hand-in-stock",
        "opening_stock",
        "opening stock",
        "quantity",
        "stock",
        "stock_quantity",
        "stock quantity",
        "qty",
        "available_qty",
        "available qty",
        "units",
        "available_units",
        "available units",
    ],
    "date": [
        "date",
        "transaction_date",
        "transaction date",
        "created_at",
        "created at",
        "order_date",
        "order date",
    ],
}
HEADER_KEYWORDS = ["product", "product name", "stock", "quantity", "price", "date"]
HEADER_SEARCH_ROWS = 15

DEMO_NAME_MARKERS = ["demo", "sample", "test", "stable user item", "qr demo product"]
EMPTY_CATEGORY_WORDS = ["nan", "none", "null"]
UNCATEGORIZED = "Uncategorized"
NO_DATE = "No date"

ORDER_STATUSES = ["Pending", "Confirmed", "Packed", "Shipped", "Delivered", "Cancelled"]
REQUEST_STATUSES = ["pending", "approved", "rejected"]

DEFAULT_REORDER_LEVEL = 10
DASHBOARD_LOW_STOCK = 10
MIN_ROWS_FOR_INSIGHTS = 3
COST_RATE = "0.7"

# Sentences and labels.
TEXTS = {
    "business_fast": "%s is the fastest-moving item with %d units sold.",
    "business_slow": "%s is slow-moving with %d sold and %d still in stock.",
    "business_low": "%s needs restocking soon. Only %d units remain.",
    "business_category": "%s has the highest stock concentration with %d units.",
    "business_value": "%s carries the highest inventory value at Rs. %s.",
    "business_empty": "Upload real inventory and order data to generate business recommendations.",
    "dashboard_few": "Upload at least three inventory rows to activate recommendation-style business insights.",
    "dashboard_category": "%s is your strongest category right now with %d units in stock.",
    "dashboard_low": "Low stock alert: %s has only %d units left.",
    "dashboard_value": "%s carries one of the highest inventory values and should stay visible in promotions.",
    "stock_fast": "%s is a fast-moving item based on highest sales quantity.",
    "stock_slow": "%s is slow-moving and may need promotion or bundling.",
    "stock_category": "%s has the highest sales volume.",
    "stock_low": "%s has low stock and needs restocking.",
    "stock_fast_short": "%s is a fast-moving item based on highest quantity.",
    "stock_slow_short": "%s is slow-moving and may need promotion.",
    "stock_category_short": "%s has the highest stock/sales volume.",
    "stock_empty": "Upload inventory records to generate analytics.",
    "no_orders": "No orders yet",
    "no_category": "Category column not found. Some items were grouped as Uncategorized.",
    "file_too_large": "The file is above the size limit.",
    "template_columns": "The file must include name, category, price, and quantity.",
    "upload_log": "Inventory uploaded",
    "checkout_log": "Checkout completed",
    "review_log": "Admin request %s",
    "not_a_number": "%s must be a valid number.",
    "not_whole": "%s must be a valid whole number.",
    "negative": "%s cannot be negative.",
    "request_approved": "Your admin request has been approved. You may continue. Admin access code: ",
    "request_rejected": "Your admin request was not approved.",
    "out_of_stock": "Out of stock",
    "low_stock": "Low stock",
    "ready": "Ready",
    "product_low": "Low Stock",
    "product_available": "Available",
}

# Cell texts the spreadsheet reader treats as empty.
EMPTY_CELL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------

MONEY = T.DecimalType(12, 2)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_TEXT, _LONG, _INT, _TIME, _DATE = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType(), T.DateType()

TABLES = {
    "inventory_data": _table(
        id=_LONG, report_id=_TEXT, user_id=_LONG, product_name=_TEXT, category=_TEXT, price=MONEY, quantity=_INT,
        reorder_level=_INT, supplier_name=_TEXT, branch_name=_TEXT, image_url=_TEXT, entry_date=_DATE, created_at=_TIME,
    ),
    "products": _table(
        product_id=_LONG, name=_TEXT, category=_TEXT, price=MONEY, quantity=_INT, reorder_level=_INT,
        supplier_name=_TEXT, branch_name=_TEXT, image_url=_TEXT, created_at=_TIME,
    ),
    "sales": _table(sale_id=_LONG, product_id=_LONG, quantity=_INT, sale_date=_DATE, total_amount=MONEY),
    "uploaded_reports": _table(
        report_id=_TEXT, title=_TEXT, created_by_admin=_LONG, token=_TEXT, source_file_name=_TEXT, status=_TEXT,
        created_at=_TIME,
    ),
    "shared_catalogs": _table(
        share_id=_LONG, admin_user_id=_LONG, title=_TEXT, token=_TEXT, source_report_id=_TEXT, qr_filename=_TEXT,
        status=_TEXT, expires_at=_TEXT, created_at=_TIME,
    ),
    "cart_items": _table(
        cart_item_id=_LONG, user_id=_LONG, share_token=_TEXT, inventory_id=_LONG, report_id=_TEXT, product_name=_TEXT,
        category=_TEXT, unit_price=MONEY, quantity=_INT, created_at=_TIME,
    ),
    "orders": _table(
        order_id=_LONG, user_id=_LONG, username=_TEXT, status=_TEXT, share_token=_TEXT, report_id=_TEXT,
        total_amount=MONEY, created_at=_TIME,
    ),
    "order_items": _table(
        order_item_id=_LONG, order_id=_LONG, inventory_id=_LONG, product_name=_TEXT, category=_TEXT, unit_price=MONEY,
        quantity=_INT, line_total=MONEY,
    ),
    "activity_logs": _table(
        activity_id=_LONG, actor_username=_TEXT, actor_role=_TEXT, action=_TEXT, detail=_TEXT, created_at=_TIME,
    ),
    "app_users": _table(user_id=_LONG, username=_TEXT, email=_TEXT, role=_TEXT, created_at=_TIME),
    "admin_requests": _table(
        id=_LONG, name=_TEXT, email=_TEXT, username=_TEXT, reason=_TEXT, business_name=_TEXT, proof=_TEXT,
        proof_file_path=_TEXT, status=_TEXT, reviewed_by=_LONG, reviewed_at=_TIME, created_at=_TIME,
    ),
    "admin_access_codes": _table(
        id=_LONG, request_id=_LONG, email=_TEXT, code=_TEXT, status=_TEXT, expires_at=_TEXT, used_at=_TIME,
        generated_by=_LONG, created_at=_TIME,
    ),
    "admin_request_notifications": _table(
        id=_LONG, request_id=_LONG, email=_TEXT, username=_TEXT, message=_TEXT, created_at=_TIME,
    ),
    "password_reset_tokens": _table(
        id=_LONG, user_id=_LONG, email=_TEXT, reset_token=_TEXT, expires_at=_TEXT, used_at=_TIME, created_at=_TIME,
    ),
}

# Defaults a column takes when an older table lacks it or holds null.
COLUMN_DEFAULTS = {
    "inventory_data": {"reorder_level": DEFAULT_REORDER_LEVEL},
    "products": {"reorder_level": DEFAULT_REORDER_LEVEL},
    "uploaded_reports": {"status": "active"},
    "shared_catalogs": {"status": "active"},
    "orders": {"status": "Pending"},
    "admin_requests": {"status": "pending"},
    "admin_access_codes": {"status": "active"},
}

# Tables emptied by a data reset.
RESETTABLE_TABLES = [
    "order_items", "orders", "cart_items", "shared_catalogs", "uploaded_reports", "sales", "products", "inventory_data",
]
