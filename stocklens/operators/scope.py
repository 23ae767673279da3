"""Row filters and lookups. Every filter stays a plain predicate, so it reaches the Parquet scan."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from stocklens.functions import columns as C
from stocklens.schemas import DEFAULT_REORDER_LEVEL, MONEY, REQUEST_STATUSES

STAFF_ROLES = ("admin", "manager")


def newest_first(df: DataFrame, time_col: str = "created_at", id_col: str = "id") -> DataFrame:
    """Full ordering for presentation: a range-partitioned sort."""
    return df.orderBy(F.desc(time_col), F.desc(id_col))


def scope_inventory(inventory: DataFrame, role: str, user_id: int | None = None) -> DataFrame:
    """All rows for staff, own rows for a user, none for anybody else."""
    if role in STAFF_ROLES:
        return inventory
    if role == "user" and user_id:
        return inventory.filter(F.col("user_id") == user_id)
    return inventory.filter(F.lit(False))


def filter_real_names(df: DataFrame, name_col: str = "product_name") -> DataFrame:
    return df.filter(C.is_real_name(F.col(name_col)))


def search_products(products: DataFrame, search: str = "", category: str = "") -> DataFrame:
    """Products whose name or category contains the text, within an exact category."""
    if search:
        needle = search.lower()
        products = products.filter(
            F.lower("name").contains(needle) | F.lower("category").contains(needle)
        )
    if category:
        products = products.filter(F.col("category") == category)
    return products


def filter_catalog(
    rows: DataFrame, search: str = "", category: str = "", stock_level: str = "", branch: str = ""
) -> DataFrame:
    if search:
        rows = rows.filter(F.lower("product_name").contains(search.lower()))
    if category:
        rows = rows.filter(F.col("category") == category)
    if branch:
        rows = rows.filter(F.col("branch_name") == branch)
    if stock_level == "low":
        rows = rows.filter(F.col("quantity") <= F.col("reorder_level"))
    elif stock_level == "out":
        rows = rows.filter(F.col("quantity") <= 0)
    return rows


def typed_inventory(inventory: DataFrame) -> DataFrame:
    """Clean category and the defaults every report view applies."""
    return inventory.select(
        "id",
        "report_id",
        "product_name",
        C.clean_category(F.col("category"), fallback=True).alias("category"),
        F.coalesce(F.col("price"), F.lit(0).cast(MONEY)).alias("price"),
        F.coalesce(F.col("quantity"), F.lit(0)).alias("quantity"),
        C.default_if_falsy(F.col("reorder_level"), DEFAULT_REORDER_LEVEL).alias("reorder_level"),
        "supplier_name",
        "branch_name",
        "image_url",
        "entry_date",
        "created_at",
    )


def report_rows(inventory: DataFrame, report_id: str | None = None, exclude_demo: bool = False) -> DataFrame:
    """Stored rows of one report, or of all reports when none is named."""
    if report_id is not None:
        inventory = inventory.filter(F.col("report_id") == report_id)
    return filter_real_names(inventory) if exclude_demo else inventory


def report_inventory(inventory: DataFrame, report_id: str | None = None, exclude_demo: bool = False) -> DataFrame:
    """:func:`report_rows` cleaned for display."""
    return typed_inventory(report_rows(inventory, report_id, exclude_demo))


def lookup_ci(df: DataFrame, key_cols: list[str], value: str) -> DataFrame:
    """Rows where any key equals the value, ignoring case."""
    return df.filter(reduce(or_, [F.lower(key) == value.lower() for key in key_cols]))


def lookup_many_ci(df: DataFrame, key_cols: list[str], keys: DataFrame, key: str) -> DataFrame:
    """Join form of :func:`lookup_ci` for many keys: rows with any key among ``keys``.

    One equi-join per key column; an OR in the join condition would force a nested-loop join.
    """
    wanted = keys.select(F.lower(key).alias("_wanted")).distinct()
    hits = []
    for position, column in enumerate(key_cols):
        fresh = df
        for earlier in key_cols[:position]:
            seen = wanted.withColumnRenamed("_wanted", "_seen")
            fresh = fresh.join(seen, F.lower(earlier) == F.col("_seen"), "left_anti")
        hits.append(fresh.join(wanted, F.lower(column) == F.col("_wanted"), "left_semi"))
    return reduce(DataFrame.unionByName, hits)


def visible_orders(
    orders: DataFrame, role: str, user_id: int | None = None, username: str | None = None
) -> DataFrame:
    if role in STAFF_ROLES:
        return orders
    return orders.filter((F.col("user_id") == user_id) | (F.col("username") == username))


def valid_catalogs(catalogs: DataFrame, as_of: str) -> DataFrame:
    """Active catalogs that have not expired at ``as_of``; an unreadable expiry counts as expired."""
    return catalogs.filter(
        (F.col("status") == "active")
        & ~C.is_expired(F.col("expires_at"), C.timestamp(as_of), unparseable_expires=True)
    )


def catalog_by_token(catalogs: DataFrame, token: str, as_of: str) -> DataFrame:
    """The valid catalog a pasted link or token names."""
    wanted = F.lower(C.normalize_token(F.lit(token)))
    return valid_catalogs(catalogs, as_of).filter(F.lower("token") == wanted)


def code_validity(codes: DataFrame, as_of: str, provided_email: Column | None = None) -> DataFrame:
    """Access codes with ``is_valid``: active, unused, unexpired, and the e-mail agrees where both are known."""
    expired = C.is_expired(F.col("expires_at"), C.timestamp(as_of), unparseable_expires=False)
    valid = (
        (F.lower(F.coalesce("status", F.lit(""))) == "active") & F.col("used_at").isNull() & ~expired
    )
    if provided_email is not None:
        own, given = C.normalize_email(F.col("email")), C.normalize_email(provided_email)
        valid = valid & ((own == "") | (given == "") | (own == given))
    return codes.withColumn("is_valid", valid)


def reset_token_validity(tokens: DataFrame, as_of: str) -> DataFrame:
    """Reset tokens with ``is_valid``; here an unreadable expiry makes the token invalid."""
    expired = C.is_expired(F.col("expires_at"), C.timestamp(as_of), unparseable_expires=True)
    return tokens.withColumn("is_valid", F.col("used_at").isNull() & ~expired)


def catalog_facets(rows: DataFrame) -> DataFrame:
    """Distinct non-empty categories and branches as (facet, value), from one scan and one shuffle."""
    pairs = F.array(
        F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")),
        F.struct(F.lit("branch").alias("facet"), F.col("branch_name").alias("value")),
    )
    return rows.select(F.inline(pairs)).filter(F.col("value") != "").distinct()


def request_notifications(
    notifications: DataFrame, email: str = "", username: str = "", request_id: int | None = None
) -> DataFrame:
    """Notifications of one request, or those matching the e-mail or the user name."""
    if request_id is not None:
        return notifications.filter(F.col("request_id") == request_id)
    matches = [
        F.lower(column) == value.lower() for column, value in (("email", email), ("username", username)) if value
    ]
    return notifications.filter(reduce(or_, matches)) if matches else notifications


def product_by_id(
    inventory: DataFrame, product_id: int, role: str = "admin", user_id: int | None = None, report_id: str | None = None
) -> DataFrame:
    rows = scope_inventory(inventory, role, user_id).filter(F.col("id") == product_id)
    return rows if report_id is None else rows.filter(F.col("report_id") == report_id)


def list_sales(
    sales: DataFrame,
    products: DataFrame,
    product_id: int | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Sale rows with their product, within a product and a date range."""
    if product_id is not None:
        sales = sales.filter(F.col("product_id") == product_id)
    if date_from:
        sales = sales.filter(F.col("sale_date") >= F.lit(date_from).cast("date"))
    if date_to:
        sales = sales.filter(F.col("sale_date") <= F.lit(date_to).cast("date"))
    named = products.select("product_id", F.col("name").alias("product_name"), "category")
    return sales.join(named, "product_id").select(
        "sale_id", "product_id", "product_name", "category", "quantity", "total_amount", "sale_date"
    )


def requests_by_status(requests: DataFrame, status: str) -> DataFrame:
    """Requests of one status; any other word means all of them."""
    status = status.strip().lower()
    return requests.filter(F.col("status") == status) if status in REQUEST_STATUSES else requests
