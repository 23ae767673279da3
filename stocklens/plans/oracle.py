"""The registered queries in plain SQL, to check the Spark results against.

The texts share only the adapters and derived inputs with the Spark side; rules are written out again in SQL.
"""

from stocklens.plans import derived
from stocklens.plans.registry import AS_OF, REPORT, TODAY
from stocklens.schemas import HEADER_ALIASES
from stocklens.sources.adapters import with_adapters

_SQL: dict[str, str] = {}

INV, PRO, ORD, ITEMS, SALES = "inventory_data", "products", "orders", "order_items", "sales"
REP, CAT, USERS, REQ, CODES = "uploaded_reports", "shared_catalogs", "app_users", "admin_requests", "admin_access_codes"
NOTES, CART, LOG = "admin_request_notifications", "cart_items", "activity_logs"


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _add(name: str, tables: list[str], sql: str) -> None:
    _SQL[name] = with_adapters(tables, sql) if tables else sql


# --- rules written in SQL ----------------------------------------------------


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def real(x: str) -> str:
    return f"({strip(x)} <> '' AND NOT regexp_matches(lower({x}), 'demo|sample|test|stable user item|qr demo product'))"


def cat(x: str, fallback: str = "'Uncategorized'") -> str:
    return (
        f"CASE WHEN {x} IS NULL OR {strip(x)} = '' OR lower({strip(x)}) IN ('nan', 'none', 'null') THEN {fallback}"
        f" ELSE regexp_replace({strip(x)}, '\\s+', ' ', 'g') END"
    )


def header(x: str) -> str:
    return f"trim(regexp_replace(lower({strip(x)}), '[^a-z0-9]+', '_', 'g'), '_')"


def number(x: str) -> str:
    return f"CASE WHEN regexp_matches({strip(x)}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN CAST({strip(x)} AS DECIMAL(18,4)) END"


def whole(x: str) -> str:
    return f"CASE WHEN regexp_matches({strip(x)}, '^[+-]?[0-9]+$') THEN CAST({strip(x)} AS INT) END"


def money(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def expiry(x: str) -> str:
    return f"TRY_CAST(replace(replace({x}, 'T', ' '), 'Z', '') AS TIMESTAMP)"


def key_id(*xs: str) -> str:
    text = " || '|' || ".join(f"coalesce(CAST({x} AS STRING), '')" for x in xs)
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def token(x: str) -> str:
    bare = f"split_part(split_part({strip(x)}, '?', 1), '#', 1)"
    return f"nullif({strip(f'''split_part(rtrim({bare}, '/'), '/', -1)''')}, '')"


def price_problem(x: str) -> str:
    return f"CASE WHEN ({number(x)}) IS NULL THEN 'Price must be a valid number.' END"


def count_problem(x: str, label: str = "Quantity") -> str:
    return (
        f"CASE WHEN ({whole(x)}) < 0 THEN '{label} cannot be negative.'"
        f" WHEN ({whole(x)}) IS NULL THEN '{label} must be a valid whole number.' END"
    )


ROWS = f"""inv AS (
    SELECT id, report_id, product_name, {cat('category')} AS category, price, quantity,
           CASE WHEN reorder_level IS NULL OR reorder_level = 0 THEN 10 ELSE reorder_level END AS reorder_level,
           supplier_name, branch_name, image_url, entry_date, created_at,
           row_number() OVER (ORDER BY created_at DESC, id DESC) AS seen
    FROM t_inventory_data)"""
REAL_ROWS = f"{ROWS}, rinv AS (SELECT * FROM inv WHERE {real('product_name')})"
LINES = f"""lines AS (
    SELECT i.product_name, i.category, i.quantity, o.created_at AS sale_date, i.line_total AS total_amount,
           i.order_item_id AS line_id, o.report_id
    FROM t_order_items i JOIN t_orders o ON o.order_id = i.order_id WHERE {real('i.product_name')})"""
FACTS = f"""{REAL_ROWS}, {LINES},
stock AS (SELECT {strip('product_name')} AS product_name, arg_min(category, seen) AS category,
                 CAST(sum(quantity) AS BIGINT) AS stock, sum(price * quantity) AS value, max(price) AS price, min(seen) AS seen
          FROM rinv GROUP BY 1),
sold AS (SELECT product_name, CAST(sum(quantity) AS BIGINT) AS sold, min(nth) AS nth
         FROM (SELECT *, row_number() OVER (ORDER BY sale_date, line_id) AS nth FROM lines) n GROUP BY 1),
facts AS (SELECT coalesce(a.product_name, b.product_name) AS product_name, coalesce(a.category, 'Uncategorized') AS category,
                 coalesce(a.stock, 0) AS stock, coalesce(b.sold, 0) AS sold, {money('coalesce(a.value, 0)')} AS value,
                 coalesce(a.value, 0) AS exact_value, {money('coalesce(a.price, 0)')} AS price,
                 a.product_name IS NULL AS is_sales_only,
                 row_number() OVER (ORDER BY a.product_name IS NULL, a.seen, b.nth) AS first_seen
          FROM stock a FULL JOIN sold b ON a.product_name = b.product_name)"""
FACT_TABLES = [INV, ITEMS, ORD]
FACT_COLS = "product_name, category, stock, sold, value, price, is_sales_only"
CATV = """catv AS (SELECT category, CAST(sum(quantity) AS BIGINT) AS stock, sum(price * quantity) AS value, min(seen) AS seen
         FROM rinv GROUP BY 1)"""


def _top(name: str, tables: list[str], ctes: str, columns: str, source: str, order: str, k: int) -> None:
    ctes = f", {ctes}" if ctes else ""
    _add(
        name,
        tables,
        f"{ctes} SELECT {columns}, row_number() OVER (ORDER BY {order}) AS position FROM {source} ORDER BY {order} LIMIT {k}",
    )


# --- sources and ingestion ---------------------------------------------------

_add("read_workbooks", [], f"SELECT path, row_idx, col_idx, value, CAST(NULL AS STRING) AS error FROM ({derived.FILE_CELLS}) c")

_add(
    "stream_ingest", [],
    f"""WITH raw AS ({derived.UPLOAD_ROWS}), typed AS (SELECT split_part(path, '/', 2) AS source_file_name, {strip('product_name')} AS product_name,
      {cat('category')} AS category, CAST({number('price')} AS DECIMAL(12,2)) AS price, CAST(trunc({number('quantity')}) AS INT) AS quantity FROM raw)
    SELECT source_file_name, product_name, category, {money('price')} AS price, quantity, CAST(1 AS BIGINT) AS user_id, DATE '{TODAY}' AS entry_date
    FROM typed WHERE price IS NOT NULL AND quantity IS NOT NULL AND product_name <> ''""",
)

_aliases = []
for _field, _names in HEADER_ALIASES.items():
    for _rank, _name in enumerate(_names):
        _aliases.append(f"({_rank}, '{_field}', '{_name.replace(' ', '_').replace('-', '_')}')")
_UP = f"""WITH cells AS ({derived.CELLS}),
alias AS (SELECT field, alias, min(priority) AS priority FROM (VALUES {', '.join(_aliases)}) v(priority, field, alias) GROUP BY 1, 2),
scored AS (
    SELECT path, row_idx, count(*) AS filled,
           sum(CASE WHEN {header('value')} IN (SELECT alias FROM alias) THEN 3 ELSE 0 END
               + (SELECT count(*) FROM (VALUES ('product'), ('product name'), ('stock'), ('quantity'), ('price'), ('date')) k(w)
                  WHERE contains(lower({strip('value')}), w))) AS score
    FROM cells WHERE {strip('value')} <> '' AND lower(value) <> 'nan' GROUP BY 1, 2),
hrow AS (
    SELECT f.path, CAST(coalesce(b.row_idx, 0) AS INT) AS header_row, b.row_idx IS NOT NULL AS header_found
    FROM (SELECT DISTINCT path FROM cells) f
    LEFT JOIN (SELECT path, row_idx, row_number() OVER (PARTITION BY path ORDER BY row_idx >= 15, score DESC, row_idx) AS nth
               FROM scored WHERE filled >= 2 AND score > 0) b ON b.path = f.path AND b.nth = 1),
body AS (SELECT c.* FROM cells c JOIN hrow h ON h.path = c.path AND c.row_idx > h.header_row WHERE {strip('c.value')} <> ''),
named AS (
    SELECT c.path, c.col_idx, {strip('c.value')} AS header, {header('c.value')} AS normalized
    FROM cells c JOIN hrow h ON h.path = c.path AND c.row_idx = h.header_row
    WHERE {strip('c.value')} <> '' AND NOT starts_with(lower({strip('c.value')}), 'unnamed')
      AND EXISTS (SELECT 1 FROM body b WHERE b.path = c.path AND b.col_idx = c.col_idx)),
context AS (
    SELECT path, normalized, col_idx, header
    FROM (SELECT *, row_number() OVER (PARTITION BY path, normalized ORDER BY col_idx) AS nth FROM named WHERE normalized <> '') n
    WHERE nth = 1),
mapping AS (
    SELECT path, field, col_idx, header
    FROM (SELECT c.path, a.field, c.col_idx, c.header,
                 row_number() OVER (PARTITION BY c.path, a.field ORDER BY a.priority) AS nth
          FROM context c JOIN alias a ON a.alias = c.normalized) n WHERE nth = 1),
status AS (
    SELECT h.path,
           concat_ws(',', CASE WHEN NOT bool_or(coalesce(m.field = 'product_name', false)) THEN 'product_name' END,
                     CASE WHEN NOT bool_or(coalesce(m.field = 'price', false)) THEN 'price' END,
                     CASE WHEN NOT bool_or(coalesce(m.field = 'quantity', false)) THEN 'quantity' END) AS missing_fields,
           CASE WHEN NOT bool_or(coalesce(m.field = 'category', false))
                THEN 'Category column not found. Some items were grouped as Uncategorized.' END AS warning
    FROM hrow h LEFT JOIN mapping m ON m.path = h.path GROUP BY h.path),
records AS (
    SELECT b.path, b.row_idx,
           {', '.join(f"max(CASE WHEN m.field = '{f}' THEN b.value END) AS {f}" for f in HEADER_ALIASES)}
    FROM body b JOIN named n ON n.path = b.path AND n.col_idx = b.col_idx
    LEFT JOIN mapping m ON m.path = b.path AND m.col_idx = b.col_idx GROUP BY 1, 2),
typed0 AS (
    SELECT path, row_idx, coalesce({strip('product_name')}, '') AS product_name, {cat('category', 'NULL')} AS category,
           CAST({number('price')} AS DECIMAL(12,2)) AS price, CAST(trunc({number('quantity')}) AS INT) AS quantity,
           10 AS reorder_level, coalesce(nullif({strip('substring(date, 1, 10)')}, ''), '{TODAY}') AS raw_date
    FROM records),
typed AS (
    SELECT *, TRY_CAST(raw_date AS DATE) AS entry_date,
           CASE WHEN price IS NULL THEN 'price is not a number' WHEN quantity IS NULL THEN 'quantity is not a number'
                WHEN product_name = '' THEN 'product name is blank' END AS reason
    FROM typed0)
"""
_add("detect_header_row", [], _UP + "SELECT path, header_row, header_found FROM hrow")
_add("normalize_header", [], _UP + f"SELECT path, row_idx, col_idx, {header('value')} AS normalized FROM cells")
_add("header_context", [], _UP + "SELECT path, normalized, col_idx, header FROM context")
_add("auto_map_columns", [], _UP + "SELECT path, field, col_idx, header FROM mapping")
_add(
    "mapping_status", [],
    _UP + "SELECT path, CASE WHEN missing_fields = '' THEN 'success' ELSE 'mapping_required' END AS status, missing_fields, warning FROM status",
)
_add(
    "apply_manual_mapping", [],
    _UP + """SELECT * FROM mapping WHERE path NOT IN (SELECT path FROM named WHERE header = 'Remark')
    UNION ALL SELECT path, 'price', col_idx, header FROM named WHERE header = 'Remark'""",
)
_add("cells_to_records", [], _UP + "SELECT * FROM records")
_add(
    "type_rows", [],
    _UP + f"""SELECT path, row_idx, product_name, category, {money('price')} AS price, quantity, reorder_level, raw_date,
    entry_date, reason, reason IS NULL AS is_valid FROM typed""",
)
_add(
    "ingest_report", [],
    _UP + """SELECT h.path, CASE WHEN s.missing_fields = '' THEN 'success' ELSE 'mapping_required' END AS status,
           h.header_row + 1 AS detected_header_row, t.rows_processed, t.valid_rows,
           t.rows_processed - t.valid_rows AS failed_rows, n.raw_headers, n.normalized_headers, m.mapped_fields
    FROM hrow h JOIN status s ON s.path = h.path
    JOIN (SELECT path, count(*) AS rows_processed, count(*) FILTER (WHERE reason IS NULL) AS valid_rows FROM typed GROUP BY 1) t ON t.path = h.path
    JOIN (SELECT path, string_agg(header, '|' ORDER BY col_idx) AS raw_headers,
                 string_agg(normalized, '|' ORDER BY col_idx) AS normalized_headers FROM named GROUP BY 1) n ON n.path = h.path
    JOIN (SELECT path, string_agg(field, '|' ORDER BY field) AS mapped_fields FROM mapping GROUP BY 1) m ON m.path = h.path""",
)
_add(
    "preview_rows", [],
    _UP + f"""SELECT path, position, row_idx, product_name, {money('price')} AS price, quantity FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY row_idx) AS position FROM typed WHERE reason IS NULL) n WHERE position <= 8""",
)
_add(
    "register_reports", [],
    _UP + f"""SELECT path, replace(split_part(path, '/', 2), '.xlsx', '') || ' catalog' AS title, CAST(1 AS BIGINT) AS created_by_admin,
    split_part(path, '/', 2) AS source_file_name, 'active' AS status, TIMESTAMP '{AS_OF}' AS created_at,
    md5(path || '|{AS_OF}') AS report_id, substr(sha256(path || '|{AS_OF}'), 1, 16) AS token FROM (SELECT DISTINCT path FROM cells) f""",
)
_add(
    "normalize_rows", [INV],
    f"""SELECT id, report_id, user_id, {strip('product_name')} AS product_name, {cat('category')} AS category, {money('price')} AS price,
    quantity, reorder_level, supplier_name, branch_name, image_url, coalesce(entry_date, DATE '{TODAY}') AS entry_date, created_at
    FROM t_inventory_data WHERE {strip('product_name')} <> ''""",
)
_add(
    "merge_product_master", [PRO, INV],
    f""", both_rows AS (
      SELECT name, category, price, quantity, product_id, -1 AS loaded_at FROM t_products
      UNION ALL SELECT product_name, {cat('category')}, price, quantity, NULL, id FROM t_inventory_data)
    SELECT coalesce(max(product_id) OVER (PARTITION BY name, category), {key_id('name', 'category')}) AS product_id, name, category, {money('price')} AS price, quantity FROM both_rows
    QUALIFY row_number() OVER (PARTITION BY name, category ORDER BY loaded_at DESC, product_id DESC) = 1""",
)
_TEMPLATE = f"""WITH raw AS ({derived.TEMPLATE_ROWS}),
imported AS (SELECT {strip('name')} AS name, {strip('category')} AS category, CAST({number('price')} AS DECIMAL(12,2)) AS price,
                    CAST(trunc({number('quantity')}) AS INT) AS quantity FROM raw),
marked AS (SELECT *, coalesce(name <> '' AND category <> '' AND price >= 0 AND quantity >= 0, false) AS is_inserted FROM imported)
"""
_add("import_products_strict", [], _TEMPLATE + f"SELECT name, category, {money('price')} AS price, quantity, is_inserted FROM marked")
_add(
    "import_counts", [],
    _TEMPLATE + "SELECT count(*) FILTER (WHERE is_inserted) AS inserted, count(*) FILTER (WHERE NOT is_inserted) AS skipped FROM marked",
)
_add(
    "load_tables", [INV, PRO, ORD, REP, USERS, REQ],
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count, CAST({'0' if n == USERS else 'count(*)'} AS BIGINT) AS defaults FROM t_{n}"
        for n in [INV, PRO, ORD, REP, USERS, REQ]
    ),
)
_add(
    "append_inventory", [INV],
    f"""SELECT id, report_id, CAST(5 AS BIGINT) AS user_id, product_name, category, {money('price')} AS price, quantity, reorder_level, supplier_name,
    branch_name, image_url, entry_date, created_at FROM t_inventory_data WHERE report_id = '{REPORT}'""",
)
_add("only_xlsx", [], f"SELECT page_id, CASE WHEN {token('url')} IS NOT NULL THEN page_id % 5 IN (0, 1) END AS is_workbook FROM pages")
_add(
    "conform_products", [PRO],
    f"""SELECT product_id, name, category, {money('price')} AS price, quantity, 10 AS reorder_level, CAST(NULL AS STRING) AS supplier_name,
    CAST(NULL AS STRING) AS branch_name, CAST(NULL AS STRING) AS image_url, CAST(NULL AS TIMESTAMP) AS created_at FROM t_products""",
)

# --- filters and lookups -----------------------------------------------------

_INV_COLS = f"""id, report_id, user_id, product_name, category, {money('price')} AS price, quantity, reorder_level, supplier_name,
    branch_name, image_url, entry_date, created_at"""
_ROW_COLS = f"""id, report_id, product_name, category, {money('price')} AS price, quantity, reorder_level, supplier_name, branch_name,
    image_url, entry_date, created_at"""
_ORDER_COLS = f"order_id, user_id, username, status, share_token, report_id, {money('total_amount')} AS total_amount, created_at"

_add("scope_inventory", [INV], f"SELECT {_INV_COLS} FROM t_inventory_data WHERE user_id = 3")
_add("filter_real_names", [INV], f"SELECT {_INV_COLS} FROM t_inventory_data WHERE {real('product_name')}")
_add("clean_category", [INV], f"SELECT id, {cat('category', 'NULL')} AS category, {cat('category')} AS stored_category FROM t_inventory_data")
_add(
    "search_products", [PRO],
    f"""SELECT product_id, name, category, {money('price')} AS price, quantity FROM t_products
    WHERE (lower(name) LIKE '%ring%' OR lower(category) LIKE '%ring%') AND category = 'PROMO'""",
)
_add(
    "filter_catalog", [INV],
    f""", {ROWS} SELECT {_ROW_COLS} FROM inv WHERE lower(product_name) LIKE '%r%' AND category = 'PROMO'
    AND branch_name = 'NATION_2' AND quantity <= reorder_level""",
)
_add("filter_catalog_out_of_stock", [INV], f", {ROWS} SELECT {_ROW_COLS} FROM inv WHERE category = 'ECONOMY' AND quantity <= 0")
_add("report_inventory", [INV], f", {REAL_ROWS} SELECT {_ROW_COLS} FROM rinv WHERE report_id = '{REPORT}'")
_add(
    "lookup_ci", [USERS, ORD, CODES],
    """SELECT user_id, username, email, role, created_at FROM t_app_users WHERE lower(username) IN (SELECT lower(username) FROM t_orders)
    OR lower(email) IN (SELECT lower(email) FROM t_admin_access_codes)""",
)
_add("lookup_ci_one", [USERS], "SELECT user_id, username, email, role, created_at FROM t_app_users WHERE lower(username) = 'customer#000000042'")
_add("visible_orders", [ORD], f"SELECT {_ORDER_COLS} FROM t_orders WHERE user_id = 7 OR username = 'Customer#000000011'")
_VALID = f"status = 'active' AND (expires_at IS NULL OR coalesce({expiry('expires_at')} >= TIMESTAMP '{AS_OF}', false))"
_CAT_COLS = "share_id, title, token, source_report_id, qr_filename, status, expires_at, created_at"
_add("valid_catalogs", [CAT], f"SELECT {_CAT_COLS} FROM t_shared_catalogs WHERE {_VALID}")
_add(
    "code_validity", [CODES, REQ],
    f"""SELECT c.id, c.request_id, lower(c.status) = 'active' AND c.used_at IS NULL
      AND NOT coalesce({expiry('c.expires_at')} < TIMESTAMP '{AS_OF}', false) AND lower(c.email) = lower(r.email) AS is_valid
    FROM t_admin_access_codes c JOIN t_admin_requests r ON r.id = c.request_id""",
)
_add(
    "reset_token_validity", [CODES],
    f"""SELECT id, used_at IS NULL AND (expires_at IS NULL OR coalesce({expiry('expires_at')} >= TIMESTAMP '{AS_OF}', false)) AS is_valid
    FROM t_admin_access_codes""",
)
_add(
    "stock_status", [INV],
    """SELECT id, CASE WHEN quantity <= 0 THEN 'Out of stock' WHEN quantity <= reorder_level THEN 'Low stock' ELSE 'Ready' END AS stock_status,
    CASE WHEN quantity < 10 THEN 'Low Stock' ELSE 'Available' END AS product_label FROM t_inventory_data""",
)
_FACETS = """SELECT DISTINCT 'category' AS facet, category AS value FROM {0} WHERE category <> ''
    UNION ALL SELECT DISTINCT 'branch', branch_name FROM {0} WHERE branch_name <> ''"""
_add("catalog_facets", [INV], f", {ROWS} {_FACETS.format('inv')}")
_add(
    "request_notifications", [NOTES],
    """SELECT id, request_id, email, username, message, created_at FROM t_admin_request_notifications
    WHERE lower(email) = 'customer7@example.com' OR lower(username) = 'customer#000000011'""",
)
_add("product_by_id", [INV], f"SELECT {_INV_COLS} FROM t_inventory_data WHERE id = 59 AND user_id = 3")
_add(
    "list_sales", [SALES, PRO],
    f"""SELECT s.sale_id, s.product_id, p.name AS product_name, p.category, s.quantity, {money('s.total_amount')} AS total_amount, s.sale_date
    FROM t_sales s JOIN t_products p ON p.product_id = s.product_id WHERE s.sale_date BETWEEN DATE '1998-01-01' AND DATE '1999-06-30'""",
)
_REQ_COLS = "id, email, username, status, reviewed_by, reviewed_at, created_at"
_add("requests_by_status", [REQ], f"SELECT {_REQ_COLS} FROM t_admin_requests WHERE status = 'pending'")

# --- joins -------------------------------------------------------------------

_add(
    "inventory_with_owner", [INV, USERS],
    f"""SELECT d.id, d.report_id, d.user_id, d.product_name, d.category, {money('d.price')} AS price, d.quantity, d.reorder_level,
    d.supplier_name, d.branch_name, d.image_url, d.entry_date, d.created_at, u.username
    FROM t_inventory_data d LEFT JOIN t_app_users u ON u.user_id = d.user_id""",
)
_add(
    "sales_lines", [SALES, PRO],
    f"""SELECT p.name AS product_name, p.category, s.quantity, s.sale_date, {money('s.total_amount')} AS total_amount, s.sale_id AS line_id
    FROM t_sales s JOIN t_products p ON p.product_id = s.product_id""",
)
_LINE_COLS = f"product_name, category, quantity, sale_date, {money('total_amount')} AS total_amount, line_id"
_add("order_lines", [ITEMS, ORD], f", {LINES} SELECT {_LINE_COLS} FROM lines")
_add("order_lines_of_report", [ITEMS, ORD], f", {LINES} SELECT {_LINE_COLS} FROM lines WHERE report_id = '{REPORT}'")
_add(
    "all_sales", [SALES, PRO, ITEMS, ORD],
    f""", {LINES} SELECT {_LINE_COLS}, 1 AS source FROM lines UNION ALL
    SELECT p.name, p.category, s.quantity, CAST(s.sale_date AS TIMESTAMP), {money('s.total_amount')}, s.sale_id, 0
    FROM t_sales s JOIN t_products p ON p.product_id = s.product_id WHERE {real('p.name')}""",
)
_add(
    "report_listing", [REP, CAT, INV],
    """SELECT r.report_id, r.title, r.source_file_name, r.token, r.created_at, s.qr_filename, count(d.id) AS row_count
    FROM t_uploaded_reports r LEFT JOIN t_shared_catalogs s ON s.source_report_id = r.report_id
    LEFT JOIN t_inventory_data d ON d.report_id = r.report_id GROUP BY ALL""",
)
_add(
    "report_listing_fanout_safe", [REP, CAT, INV],
    """SELECT r.report_id, r.title, r.source_file_name, r.token, r.created_at, s.qr_filename, coalesce(d.n, 0) AS row_count
    FROM t_uploaded_reports r LEFT JOIN (SELECT DISTINCT source_report_id, qr_filename FROM t_shared_catalogs) s ON s.source_report_id = r.report_id
    LEFT JOIN (SELECT report_id, count(*) AS n FROM t_inventory_data GROUP BY 1) d ON d.report_id = r.report_id
    ORDER BY r.created_at DESC, r.report_id DESC, s.qr_filename NULLS FIRST LIMIT 10""",
)
_CART_COLS = f"""c.cart_item_id, c.user_id, c.share_token, c.inventory_id, c.report_id, c.product_name, c.category,
    {money('c.unit_price')} AS unit_price, c.quantity, c.created_at"""
_STOCK_JOIN = "t_cart_items c LEFT JOIN t_inventory_data i ON i.id = c.inventory_id AND i.report_id = c.report_id"
_add(
    "cart_with_stock", [CART, INV],
    f"SELECT {_CART_COLS}, i.quantity AS current_stock, i.image_url, i.branch_name, i.supplier_name, i.reorder_level FROM {_STOCK_JOIN}",
)
_add(
    "request_queue", [REQ, USERS, CODES],
    """SELECT r.id, r.email, r.username, r.status, r.reviewed_by, r.reviewed_at, r.created_at, u.username AS reviewer_username,
      c.code AS latest_code, c.expires_at AS latest_code_expires_at
    FROM t_admin_requests r LEFT JOIN t_app_users u ON u.user_id = r.reviewed_by
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, id DESC) AS nth FROM t_admin_access_codes
               WHERE status = 'active' AND used_at IS NULL) c ON c.request_id = r.id AND c.nth = 1""",
)
_add(
    "latest_codes", [CODES],
    """SELECT request_id, code, expires_at, created_at, status, used_at FROM t_admin_access_codes
    QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, id DESC) = 1""",
)
_add("merge_stock_and_sales", FACT_TABLES, f", {FACTS} SELECT {FACT_COLS} FROM facts")
_add(
    "order_views", [ORD, ITEMS],
    f"""SELECT o.order_id, o.status, {money('o.total_amount')} AS total_amount, o.created_at, i.order_item_id, i.inventory_id, i.product_name,
      i.category, i.unit_price, i.quantity, i.line_total, i.position
    FROM t_orders o LEFT JOIN (SELECT order_item_id, order_id, inventory_id, product_name, category, {money('unit_price')} AS unit_price, quantity,
                                      {money('line_total')} AS line_total,
                                      row_number() OVER (PARTITION BY order_id ORDER BY order_item_id) AS position FROM t_order_items) i ON i.order_id = o.order_id""",
)
_RESOLVED = f"""filled AS (SELECT DISTINCT report_id FROM t_inventory_data),
latest AS (SELECT report_id FROM t_uploaded_reports ORDER BY created_at DESC, report_id DESC LIMIT 1),
steps AS (
    SELECT s.*, s.source_report_id IN (SELECT report_id FROM filled) AS has_rows,
      (SELECT max(r.report_id) FROM t_uploaded_reports r WHERE r.report_id = s.source_report_id) AS by_id,
      (SELECT arg_max(r.report_id, strftime(r.created_at, '%Y%m%d') || r.report_id) FROM t_uploaded_reports r WHERE lower(r.token) = lower({token('s.token')})) AS by_token,
      (SELECT arg_max(r.report_id, strftime(r.created_at, '%Y%m%d') || r.report_id) FROM t_uploaded_reports r
        WHERE lower(r.source_file_name) = lower(nullif({strip("regexp_extract(s.title, '(?i)catalog from\\s+(.+)$', 1)")}, ''))) AS by_file,
      (SELECT report_id FROM latest WHERE report_id IN (SELECT report_id FROM filled)) AS by_latest
    FROM t_shared_catalogs s),
resolved AS (
    SELECT *, CASE WHEN has_rows THEN source_report_id ELSE coalesce(by_id, by_token, by_file, by_latest, source_report_id) END AS resolved_report_id,
      CASE WHEN has_rows THEN 'source' WHEN by_id IS NOT NULL THEN 'empty source' WHEN by_token IS NOT NULL THEN 'token'
           WHEN by_file IS NOT NULL THEN 'file name' WHEN by_latest IS NOT NULL THEN 'latest' ELSE 'none' END AS resolved_by,
      NOT coalesce(has_rows, false) AND coalesce(by_id, by_token, by_file, by_latest) IS NOT NULL AS is_repaired FROM steps)"""
_add("resolve_catalog_report", [CAT, REP, INV], f", {_RESOLVED} SELECT {_CAT_COLS}, resolved_report_id, resolved_by, is_repaired FROM resolved")
_REPAIRS = f"""found AS (SELECT lower(name) AS name_key, arg_max(category, product_id) AS found FROM t_products
    WHERE lower(category) <> 'uncategorized' GROUP BY 1),
repairs AS (SELECT i.id, i.product_name, i.category, {cat('f.found', 'NULL')} AS new_category FROM t_inventory_data i
    JOIN found f ON f.name_key = lower(i.product_name) WHERE lower(i.category) = 'uncategorized')"""
_add("repair_categories", [INV, PRO], f", {_REPAIRS} SELECT * FROM repairs")
_CHECKS = f"""checks AS (SELECT {_CART_COLS}, i.quantity AS current_stock, {money('i.price')} AS current_price,
    CASE WHEN i.id IS NULL THEN 'missing' WHEN c.quantity > i.quantity THEN 'over stock' ELSE 'ok' END AS verdict,
    coalesce(i.price, 0) * c.quantity AS exact_amount FROM {_STOCK_JOIN})"""
_add(
    "cart_line_checks", [CART, INV],
    f", {_CHECKS} SELECT * EXCLUDE (exact_amount), {money('exact_amount')} AS line_amount FROM checks",
)
_add(
    "validate_cart", [CART, INV],
    f""", {_CHECKS} SELECT user_id, report_id, count(*) AS line_count, count(*) FILTER (WHERE verdict = 'missing') AS missing_lines,
    count(*) FILTER (WHERE verdict = 'over stock') AS over_stock_lines, bool_and(verdict = 'ok') AS is_valid,
    {money('sum(exact_amount)')} AS total_amount FROM checks GROUP BY 1, 2""",
)
_POP = "pop AS (SELECT product_name, CAST(sum(quantity) AS BIGINT) AS popularity FROM t_order_items GROUP BY 1)"
_add("popularity", [ITEMS], f", {_POP} SELECT * FROM pop")
_add(
    "catalog_by_popularity", [INV, ITEMS],
    f", {ROWS}, {_POP} SELECT {_ROW_COLS}, coalesce(popularity, 0) AS popularity FROM inv LEFT JOIN pop USING (product_name)",
)
_PAGE = f"""{_RESOLVED}, {ROWS}, page AS (SELECT * FROM inv WHERE report_id IN (
    SELECT resolved_report_id FROM resolved WHERE lower(token) = 'tok8' AND {_VALID}))"""
_add(
    "catalog_page", [CAT, REP, INV, ITEMS],
    f""", {_PAGE}, {_POP} SELECT {_ROW_COLS}, coalesce(popularity, 0) AS popularity FROM page LEFT JOIN pop USING (product_name)
    WHERE lower(product_name) LIKE '%r%'""",
)
_METRICS = f"""SELECT count(*) AS total_products, count(*) FILTER (WHERE quantity > 0) AS available_count,
    count(*) FILTER (WHERE quantity > 0 AND quantity <= reorder_level) AS low_stock_count,
    {money('coalesce(sum(price * quantity), 0)')} AS inventory_value FROM """
_add("catalog_page_metrics", [CAT, REP, INV], f", {_PAGE} {_METRICS} page")
_add("catalog_page_facets", [CAT, REP, INV], f", {_PAGE} {_FACETS.format('page')}")

# --- aggregates --------------------------------------------------------------

_add(
    "dashboard_metrics", [INV],
    f"""SELECT count(*) AS total_products, CAST(sum(quantity) AS BIGINT) AS total_stock_units,
    {money('sum(price * quantity)')} AS total_inventory_value, count(*) FILTER (WHERE quantity <= 10) AS low_stock_items FROM t_inventory_data""",
)
_RAW_UNITS = """units AS (SELECT category, CAST(sum(quantity) AS BIGINT) AS units, min(seen) AS seen
    FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS seen FROM t_inventory_data) n GROUP BY 1)"""
_add("category_units", [INV], f", {_RAW_UNITS} SELECT category, units FROM units")
_top("top_category_units", [INV], _RAW_UNITS, "category, units", "units", "units DESC, seen", 5)
_add(
    "inventory_summary", [INV],
    f"""SELECT category, count(*) AS total_products, CAST(sum(quantity) AS BIGINT) AS total_units, {money('sum(price * quantity)')} AS inventory_value
    FROM t_inventory_data GROUP BY 1""",
)
_DAY = "strftime(coalesce(CAST(entry_date AS TIMESTAMP), created_at), '%Y-%m-%d')"
_MONTH = "strftime(coalesce(CAST(entry_date AS TIMESTAMP), created_at), '%Y-%m')"
_add("entry_trend", [INV], f"SELECT {_DAY} AS day, CAST(sum(quantity) AS BIGINT) AS units FROM t_inventory_data GROUP BY 1")
_add(
    "product_rollup", FACT_TABLES,
    f", {FACTS} SELECT product_name, category, stock, {money('value')} AS value, {money('price')} AS price FROM stock",
)
_add("category_value", [INV], f", {REAL_ROWS}, {CATV} SELECT category, stock, {money('value')} AS value FROM catv")
_add("units_sold", [ITEMS, ORD], f", {LINES} SELECT product_name, CAST(sum(quantity) AS BIGINT) AS sold FROM lines GROUP BY 1")
_add("total_units_sold", [ITEMS, ORD], f", {LINES} SELECT CAST(sum(quantity) AS BIGINT) AS total_orders FROM lines")
_TREND = "SELECT strftime(sale_date, '%Y-%m-%d') AS day, CAST(sum(quantity) AS BIGINT) AS units FROM lines GROUP BY 1"
_add("sales_trend", [ITEMS, ORD], f", {LINES} {_TREND}")
_add("stream_sales_trend", [ITEMS, ORD], f", {LINES} {_TREND}")
_SUMMARY = f"""SELECT count(*) AS total_products, {money('sum(exact_value)')} AS total_inventory_value,
    count(*) FILTER (WHERE stock BETWEEN 0 AND 9) AS low_stock_count,
    coalesce((SELECT product_name FROM facts WHERE sold > 0 ORDER BY sold DESC, first_seen LIMIT 1), 'No orders yet') AS top_selling_product,
    CAST(sum(sold) AS BIGINT) AS total_orders FROM facts"""
_add("business_summary", FACT_TABLES, f", {FACTS} {_SUMMARY}")
_PQ = "pq AS (SELECT product_name, CAST(sum(quantity) AS BIGINT) AS quantity FROM t_inventory_data GROUP BY 1)"
_MQ = f"mq AS (SELECT {_MONTH} AS month, CAST(sum(quantity) AS BIGINT) AS quantity FROM t_inventory_data GROUP BY 1)"
_CQ = "cq AS (SELECT coalesce(category, 'Uncategorized') AS category, CAST(sum(quantity) AS BIGINT) AS quantity FROM t_inventory_data GROUP BY 1)"
_add("product_quantity", [INV], f", {_PQ} SELECT * FROM pq")
_add("monthly_quantity", [INV], f", {_MQ} SELECT * FROM mq")
_add("category_quantity", [INV], f", {_CQ} SELECT * FROM cq")
_PROFIT = f"SELECT {money('sum(price * quantity * CAST(0.3 AS DECIMAL(2,1)))')} AS estimated_profit FROM t_inventory_data"
_add("estimated_profit", [INV], _PROFIT)
_add("catalog_metrics", [INV], _METRICS + "t_inventory_data")
_add(
    "cart_summary", [CART],
    f"""SELECT user_id, CAST(sum(quantity) AS BIGINT) AS item_count, {money('sum(unit_price * quantity)')} AS subtotal,
    count(DISTINCT share_token) AS catalog_count FROM t_cart_items GROUP BY 1""",
)
_add("rows_per_report", [INV], "SELECT report_id, count(*) AS row_count FROM t_inventory_data GROUP BY 1")
_add("report_count", [REP], "SELECT count(*) AS total_reports FROM t_uploaded_reports")
_add(
    "request_status_counts", [REQ],
    "SELECT count(*) AS total_requests, "
    + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}_requests" for s in ("pending", "approved", "rejected"))
    + " FROM t_admin_requests",
)
_SHARE = "round(CAST(quantity AS DOUBLE) / (SELECT sum(quantity) FROM cq) * 100, 1)"
_top("category_share", [INV], _CQ, f"category, quantity, {_SHARE} AS percent", "cq", "quantity DESC, category", 5)

# --- top-k and orderings -----------------------------------------------------

_top("fast_movers", FACT_TABLES, FACTS, FACT_COLS, "facts WHERE sold > 0", "sold DESC, first_seen", 10)
_top("slow_movers", FACT_TABLES, FACTS, FACT_COLS, "facts WHERE stock > 0", "sold, stock DESC, first_seen", 5)
_top("low_stock_products", FACT_TABLES, FACTS, FACT_COLS, "facts WHERE stock BETWEEN 0 AND 9", "stock, first_seen", 8)
_top("valuable_products", FACT_TABLES, FACTS, FACT_COLS, "facts", "exact_value DESC, first_seen", 5)
_top("quantity_leaders", [INV], _PQ, "product_name, quantity", "pq", "quantity DESC, product_name", 5)
_top("quantity_laggards", [INV], _PQ, "product_name, quantity", "pq", "quantity, product_name", 5)
_top("low_stock_rows", [INV], "", _INV_COLS, "t_inventory_data WHERE quantity < 10", "quantity, id", 10)
_top("dashboard_low_stock", [INV], "", _INV_COLS, "t_inventory_data WHERE quantity <= 10", "created_at DESC, id DESC", 5)
_SORTS = {"newest": "id DESC", "price": "price, created_at DESC, id DESC", "stock": "quantity DESC, created_at DESC, id DESC",
          "popularity": "coalesce(popularity, 0) DESC, created_at DESC, id DESC"}
_add(
    "sort_catalog", [INV, ITEMS],
    f", {ROWS}, {_POP} "
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{mode}' AS mode, id, row_number() OVER (ORDER BY {order}) AS position FROM inv LEFT JOIN pop USING (product_name)"
        ") s" for mode, order in _SORTS.items()
    ),
)
_top("recent_activity", [LOG], "", "*", "t_activity_logs", "created_at DESC, activity_id DESC", 12)
_top("recent_orders", [ORD], "", _ORDER_COLS, "t_orders", "created_at DESC, order_id DESC", 12)
_top(
    "latest_report", [REP], "", "report_id, title, token, source_file_name, status, created_at", "t_uploaded_reports",
    "created_at DESC, report_id DESC", 1,
)
_top(
    "latest_valid_catalog", [CAT], "", _CAT_COLS,
    f"t_shared_catalogs c WHERE {_VALID}",
    "created_at DESC, share_id DESC", 1,
)
_add(
    "highest_value_row", [INV],
    f"SELECT {_INV_COLS}, {money('i.price * quantity')} AS value FROM t_inventory_data i ORDER BY i.price * quantity DESC, created_at DESC, id DESC LIMIT 1",
)
_add(
    "recently_viewed", [LOG],
    """SELECT * FROM (SELECT user_id, item, viewed_at, row_number() OVER (PARTITION BY user_id ORDER BY viewed_at DESC, item DESC) AS position
    FROM (SELECT actor_id AS user_id, CAST(json_extract_string(detail, '$.k') AS INT) AS item, max(created_at) AS viewed_at
          FROM t_activity_logs WHERE action = 'view' GROUP BY 1, 2) v) n WHERE position <= 5""",
)
_SQL["stream_recently_viewed"] = _SQL["recently_viewed"]
_top("preview", [INV], "", _INV_COLS, "t_inventory_data", "created_at DESC, id DESC", 100)

# --- scalar functions --------------------------------------------------------

_add("normalize_token", [], f"SELECT page_id, {token('url')} AS token FROM pages")
_add(
    "extract_product_id", [],
    f"""SELECT scan_id, TRY_CAST(coalesce(nullif(regexp_extract(scanned, '/product/([0-9]+)', 1), ''),
      CASE WHEN regexp_matches({strip('scanned')}, '^[0-9]+$') THEN {strip('scanned')} END) AS BIGINT) AS product_id FROM ({derived.SCANNED}) s""",
)
_add(
    "parse_payload", [],
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    coalesce(json_extract_string(props, '$.name'), 'product') AS name FROM events""",
)
_add(
    "to_price_and_count", [],
    f"""SELECT form_id, CAST({number('entered')} AS DOUBLE) AS price, {price_problem('entered')} AS price_problem,
      CASE WHEN ({whole('entered')}) >= 0 THEN ({whole('entered')}) END AS count, {count_problem('entered')} AS count_problem
    FROM ({derived.FORM_VALUES}) f""",
)
_add(
    "day_and_month_key", [INV],
    """SELECT id, coalesce(strftime(entry_date, '%Y-%m-%d'), 'No date') AS day, coalesce(strftime(entry_date, '%Y-%m'), 'No date') AS month
    FROM t_inventory_data""",
)
_add("normalize_email", [CODES], "SELECT id, lower(email) AS email FROM t_admin_access_codes")
_add(
    "title_status", [],
    f"""SELECT change_id, CASE lower(trim(status)) WHEN 'shipped' THEN 'Shipped' WHEN 'delivered' THEN 'Delivered' WHEN 'packed' THEN 'Packed' END AS status
    FROM ({derived.STATUS_CHANGES}) s""",
)
_add("file_stem", [], f"SELECT page_id, regexp_replace({token('url')}, '^(.+)\\.[^.]+$', '\\1') AS stem FROM pages")
_add(
    "filename_from_title", [CAT],
    "SELECT share_id, nullif(trim(regexp_extract(title, '(?i)catalog from\\s+(.+)$', 1)), '') AS file_name FROM t_shared_catalogs",
)
_add("line_total", [INV], f"SELECT id, {money('price * quantity')} AS inventory_value FROM t_inventory_data")
_add("parse_expiry", [CODES], f"SELECT id, {expiry('expires_at')} AS expires FROM t_admin_access_codes")
_add("default_if_falsy", [INV], "SELECT id, CASE WHEN quantity IS NULL OR quantity = 0 THEN 10 ELSE quantity END AS quantity FROM t_inventory_data")

# --- insights and charts -----------------------------------------------------


def _say(*parts: str) -> str:
    """Union of (position, message) rows."""
    return " UNION ALL ".join(parts)


_INVENTORY_INSIGHTS = """SELECT CAST(1 AS BIGINT) AS position, (SELECT coalesce(category, 'None') || ' is your strongest category right now with ' || units || ' units in stock.'
        FROM units ORDER BY units DESC, seen LIMIT 1) AS message
    UNION ALL SELECT 2, (SELECT 'Low stock alert: ' || product_name || ' has only ' || quantity || ' units left.' FROM t_inventory_data
        WHERE quantity <= 10 ORDER BY created_at DESC, id DESC LIMIT 1)
    UNION ALL SELECT 3, (SELECT product_name || ' carries one of the highest inventory values and should stay visible in promotions.'
        FROM t_inventory_data ORDER BY price * quantity DESC, created_at DESC, id DESC LIMIT 1)"""
_add("inventory_insights", [INV], f", {_RAW_UNITS} {_INVENTORY_INSIGHTS}")
_BUSINESS = _say(
    "SELECT CAST(1 AS BIGINT) AS position, (SELECT product_name || ' is the fastest-moving item with ' || sold || ' units sold.' FROM facts WHERE sold > 0 ORDER BY sold DESC, first_seen LIMIT 1) AS message",
    "SELECT 2, (SELECT product_name || ' is slow-moving with ' || sold || ' sold and ' || stock || ' still in stock.' FROM facts WHERE stock > 0 ORDER BY sold, stock DESC, first_seen LIMIT 1)",
    "SELECT 3, (SELECT product_name || ' needs restocking soon. Only ' || stock || ' units remain.' FROM facts WHERE stock BETWEEN 0 AND 9 ORDER BY stock, first_seen LIMIT 1)",
    "SELECT 4, (SELECT category || ' has the highest stock concentration with ' || stock || ' units.' FROM catv ORDER BY stock DESC, seen LIMIT 1)",
    "SELECT 5, (SELECT product_name || ' carries the highest inventory value at Rs. ' || CAST(CAST(exact_value AS DECIMAL(38,2)) AS STRING) || '.' FROM facts ORDER BY exact_value DESC, first_seen LIMIT 1)",
)
_NUMBERED = "SELECT row_number() OVER (ORDER BY position) AS position, message FROM ({0}) m WHERE message IS NOT NULL"
_add("business_insights", FACT_TABLES, f", {FACTS}, {CATV} {_NUMBERED.format(_BUSINESS)}")


def _stock_sentences(fast: str, slow: str, top: str, low_order: str) -> str:
    return _say(
        f"SELECT CAST(1 AS BIGINT) AS position, (SELECT product_name || '{fast}' FROM pq ORDER BY quantity DESC, product_name LIMIT 1) AS message",
        f"SELECT 2, (SELECT product_name || '{slow}' FROM pq ORDER BY quantity, product_name LIMIT 1)",
        f"SELECT 3, (SELECT category || '{top}' FROM cq ORDER BY quantity DESC, category LIMIT 1)",
        f"SELECT 4, (SELECT product_name || ' has low stock and needs restocking.' FROM t_inventory_data WHERE quantity < 10 ORDER BY {low_order} LIMIT 1)",
    )


_STOCK = _stock_sentences(
    " is a fast-moving item based on highest sales quantity.", " is slow-moving and may need promotion or bundling.",
    " has the highest sales volume.", "quantity, id",
)
_STOCK_SHORT = _stock_sentences(
    " is a fast-moving item based on highest quantity.", " is slow-moving and may need promotion.",
    " has the highest stock/sales volume.", "created_at DESC, id DESC",
)
_add("stock_insights", [INV], f", {_PQ}, {_CQ} {_STOCK}")
_add("stock_insights_short", [INV], f", {_PQ}, {_CQ} {_STOCK_SHORT}")


def _series(chart: str, label: str, value: str, source: str, order: str = "", k: int = 0) -> str:
    position = f"row_number() OVER (ORDER BY {order})" if k else "CAST(NULL AS BIGINT)"
    tail = f" ORDER BY {order} LIMIT {k}" if k else ""
    return f"SELECT * FROM (SELECT '{chart}' AS chart, {position} AS position, {label} AS label, CAST({value} AS DOUBLE) AS value FROM {source}{tail}) s"


_add(
    "chart_series", FACT_TABLES,
    f", {FACTS}, {CATV}, trend AS ({_TREND}) "
    + " UNION ALL ".join(
        [
            _series("fast", "product_name", "sold", "facts WHERE sold > 0", "sold DESC, first_seen", 10),
            _series("slow", "product_name", "sold", "facts WHERE stock > 0", "sold, stock DESC, first_seen", 5),
            _series("value", "product_name", "exact_value", "facts", "exact_value DESC, first_seen", 5),
            _series("category", "category", "stock", "catv"),
            _series("trend", "day", "units", "trend"),
        ]
    ),
)
_add(
    "entry_chart_series", [INV],
    f", {_RAW_UNITS}, trend AS (SELECT {_DAY} AS day, sum(quantity) AS units FROM t_inventory_data GROUP BY 1) "
    + _series("category", "category", "units", "units") + " UNION ALL " + _series("trend", "day", "units", "trend"),
)
_add(
    "upload_charts", [INV],
    f", {_PQ}, {_MQ}, {_CQ} "
    + " UNION ALL ".join(
        [
            _series("top_products", "product_name", "quantity", "pq", "quantity DESC, product_name", 5),
            _series("monthly_sales", "month", "quantity", "mq"),
            _series("low_stock", "product_name", "quantity", "t_inventory_data WHERE quantity < 10", "quantity, id", 5),
            _series("category_distribution", "category", _SHARE, "cq", "quantity DESC, category", 5),
        ]
    ),
)


def _flat(part: str, label: str, value: str, source: str, order: str = "", k: int = 0) -> str:
    tail = f" ORDER BY {order} LIMIT {k}" if k else ""
    return f"SELECT * FROM (SELECT '{part}' AS part, {label} AS label, CAST({value} AS DOUBLE) AS value FROM {source}{tail}) p"


_add(
    "decision_analytics", [INV],
    f", {_PQ}, {_MQ}, {_CQ} "
    + " UNION ALL ".join(
        [
            _flat("fast_items", "product_name", "quantity", "pq", "quantity DESC, product_name", 5),
            _flat("slow_items", "product_name", "quantity", "pq", "quantity, product_name", 5),
            _flat("low_stock", "product_name", "quantity", "t_inventory_data WHERE quantity < 10", "quantity, id", 10),
            _flat("monthly_sales", "month", "quantity", "mq"),
            _flat("profit_total", "'profit'", "estimated_profit", f"({_PROFIT}) x"),
            _flat("insights", "message", "position", f"({_STOCK}) x"),
        ]
    ),
)
_add(
    "business_analytics", FACT_TABLES,
    f", {FACTS}, {CATV}, trend AS ({_TREND}) "
    + " UNION ALL ".join(
        [
            _flat("fast_items", "product_name", "sold", "facts WHERE sold > 0", "sold DESC, first_seen", 10),
            _flat("slow_items", "product_name", "stock", "facts WHERE stock > 0", "sold, stock DESC, first_seen", 5),
            _flat("low_stock", "product_name", "stock", "facts WHERE stock BETWEEN 0 AND 9", "stock, first_seen", 8),
            _flat("valuable_products", "product_name", "exact_value", "facts", "exact_value DESC, first_seen", 5),
            _flat("category_value", "category", "value", "catv"),
            _flat("sales_trend", "day", "units", "trend"),
            _flat("insights", "message", "position", f"({_NUMBERED.format(_BUSINESS)}) x"),
            _flat("summary", "top_selling_product", "total_inventory_value", f"({_SUMMARY}) x"),
        ]
    ),
)

_add(
    "dashboard", [INV],
    f", {_RAW_UNITS} "
    + " UNION ALL ".join(
        [
            f"SELECT 'metrics' AS part, 'value' AS label, {money('sum(price * quantity)')} AS value FROM t_inventory_data",
            _flat("category_totals", "category", "units", "units"),
            "SELECT * FROM (SELECT 'top_categories', category, CAST(row_number() OVER (ORDER BY units DESC, seen) AS DOUBLE) AS n FROM units QUALIFY n <= 5) x",
            _flat("trend_points", _DAY, "sum(quantity)", f"t_inventory_data GROUP BY {_DAY}"),
            "SELECT * FROM (SELECT 'low_stock', CAST(id AS STRING), CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS DOUBLE) AS n FROM t_inventory_data WHERE quantity <= 10 QUALIFY n <= 5) x",
            f"SELECT 'insights', message, CAST(position AS DOUBLE) FROM ({_INVENTORY_INSIGHTS}) x",
            "SELECT * FROM (SELECT 'recent_rows', CAST(id AS STRING), CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS DOUBLE) AS n FROM t_inventory_data QUALIFY n <= 8) x",
        ]
    ),
)


def _newest(part: str, key: str, table: str, k: int, condition: str = "true") -> str:
    return (
        f"SELECT * FROM (SELECT '{part}' AS part, CAST({key} AS STRING) AS label, CAST(row_number() OVER (ORDER BY created_at DESC, {key} DESC) AS DOUBLE) AS value"
        f" FROM {table} WHERE {condition} QUALIFY value <= {k}) x"
    )


def _views(k: int, condition: str = "true") -> str:
    return (
        f"SELECT 'orders', CAST(o.order_id AS STRING), coalesce(CAST(row_number() OVER (PARTITION BY o.order_id ORDER BY i.order_item_id) AS DOUBLE)"
        " * CASE WHEN i.order_id IS NULL THEN 0 ELSE 1 END, 0)"
        f" FROM (SELECT * FROM t_orders WHERE {condition} ORDER BY created_at DESC, order_id DESC LIMIT {k}) o LEFT JOIN t_order_items i ON i.order_id = o.order_id"
    )


_add(
    "admin_dashboard", [INV, ORD, ITEMS, CAT, LOG, REP, USERS],
    f", {_PQ}, listed AS ("
    + """SELECT r.report_id, count(d.id) AS row_count FROM t_uploaded_reports r LEFT JOIN t_shared_catalogs s ON s.source_report_id = r.report_id
    LEFT JOIN t_inventory_data d ON d.report_id = r.report_id GROUP BY r.report_id, r.created_at, s.qr_filename
    ORDER BY r.created_at DESC, r.report_id DESC, s.qr_filename NULLS FIRST LIMIT 6) """
    + " UNION ALL ".join(
        [
            _newest("users", "user_id", "t_app_users", 6),
            "SELECT 'reports', report_id, CAST(row_count AS DOUBLE) FROM listed",
            "SELECT 'total_reports', 'reports', CAST(count(*) AS DOUBLE) FROM t_uploaded_reports",
            _newest("latest_report", "report_id", "t_uploaded_reports", 1),
            _newest("latest_share", "share_id", "t_shared_catalogs", 1, _VALID),
            _newest("shared_catalogs", "share_id", "t_shared_catalogs", 5),
            _views(8),
            _newest("recent_activity", "activity_id", "t_activity_logs", 8),
            _flat("fast_items", "product_name", "quantity", "pq", "quantity DESC, product_name", 5),
        ]
    ),
)
_add(
    "user_dashboard", [INV, ORD, ITEMS, CAT, REP, CART],
    f""", {_RESOLVED}, shared AS (SELECT * FROM resolved WHERE {_VALID} ORDER BY created_at DESC, share_id DESC LIMIT 1) """
    + " UNION ALL ".join(
        [
            "SELECT 'latest_share' AS part, resolved_report_id AS label, CAST(share_id AS DOUBLE) AS value FROM shared",
            _newest("products", "id", "t_inventory_data", 8, "report_id IN (SELECT resolved_report_id FROM shared)"),
            _views(8, "user_id = 7 OR username = 'Customer#000000007'"),
            f"SELECT 'cart', CAST(c.cart_item_id AS STRING), CAST(i.quantity AS DOUBLE) FROM {_STOCK_JOIN} WHERE c.user_id = 7",
            f"SELECT 'cart_summary', CAST(user_id AS STRING), {money('sum(unit_price * quantity)')} FROM t_cart_items WHERE user_id = 7 GROUP BY user_id",
        ]
    ),
)

ALL_LINES = f"""lines AS (
    SELECT i.product_name, i.quantity, o.created_at AS sale_date, i.order_item_id AS line_id, 1 AS source
    FROM t_order_items i JOIN t_orders o ON o.order_id = i.order_id WHERE {real('i.product_name')}
    UNION ALL SELECT p.name, s.quantity, CAST(s.sale_date AS TIMESTAMP), s.sale_id, 0
    FROM t_sales s JOIN t_products p ON p.product_id = s.product_id WHERE {real('p.name')})"""
ALL_FACTS = FACTS.replace(LINES, ALL_LINES).replace("ORDER BY sale_date, line_id", "ORDER BY source, sale_date, line_id")
_MANAGER = [INV, ITEMS, ORD, SALES, PRO]
_add("manager_summary", _MANAGER, f", {ALL_FACTS} {_SUMMARY}")
_top("manager_fast_movers", _MANAGER, ALL_FACTS, FACT_COLS, "facts WHERE sold > 0", "sold DESC, first_seen", 10)
_add("manager_insights", _MANAGER, f", {ALL_FACTS}, {CATV} {_NUMBERED.format(_BUSINESS)}")
_add(
    "report_view_charts", [INV],
    f""", {ROWS}, shown AS (SELECT * FROM inv WHERE report_id = '{REPORT}'),
    units AS (SELECT category, sum(quantity) AS units FROM shown GROUP BY 1),
    trend AS (SELECT coalesce(strftime(entry_date, '%Y-%m-%d'), '-') AS day, sum(quantity) AS units FROM shown GROUP BY 1) """
    + _series("category", "category", "units", "units") + " UNION ALL " + _series("trend", "day", "units", "trend"),
)

# --- table updates -----------------------------------------------------------

_EDITS = f"""edits AS (
    SELECT id, edit_id, edited_at, {strip('product_name')} AS product_name, {cat('category')} AS category,
      CAST({number('price')} AS DECIMAL(12,2)) AS price, {whole('quantity')} AS quantity,
      {whole("coalesce(nullif(reorder_level, ''), '10')")} AS reorder_level, nullif(trim(supplier_name), '') AS supplier_name,
      nullif(trim(branch_name), '') AS branch_name, nullif(trim(image_url), '') AS image_url,
      CAST(coalesce(nullif(trim(entry_date), ''), '{TODAY}') AS DATE) AS entry_date,
      coalesce({price_problem('price')}, {count_problem('quantity')}) AS problem
    FROM ({derived.INVENTORY_EDITS}) e)"""
_add("check_inventory_edits", [], f"WITH {_EDITS} SELECT edit_id, problem FROM edits")
_EDITED = ["product_name", "category", "price", "quantity", "reorder_level", "supplier_name", "branch_name", "image_url", "entry_date"]
_add(
    "apply_inventory_edits", [INV],
    f""", {_EDITS}, last AS (SELECT * FROM edits WHERE problem IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY edited_at DESC, edit_id DESC) = 1)
    SELECT i.id, i.report_id, i.user_id, i.created_at, """
    + ", ".join(
        money(f"CASE WHEN e.id IS NULL THEN i.{c} ELSE e.{c} END") + f" AS {c}" if c == "price"
        else f"CASE WHEN e.id IS NULL THEN i.{c} ELSE e.{c} END AS {c}" for c in _EDITED
    )
    + " FROM t_inventory_data i LEFT JOIN last e ON e.id = i.id",
)
_add(
    "apply_deletes", [ITEMS, ORD],
    f"""SELECT order_item_id, order_id, inventory_id, product_name, category, {money('unit_price')} AS unit_price, quantity,
    {money('line_total')} AS line_total FROM t_order_items WHERE order_id NOT IN (SELECT order_id FROM t_orders WHERE status = 'Pending')""",
)
_MERGE = f"""carts AS ({derived.OPEN_CARTS}), adds AS ({derived.CART_ADDS}),
checked AS (
    SELECT a.*, r.report_id, i.product_name, {cat('i.category')} AS category, i.price AS unit_price, i.quantity AS available,
      CASE WHEN r.report_id IS NULL THEN 'invalid catalog' WHEN a.quantity <= 0 THEN 'quantity too small' WHEN i.id IS NULL THEN 'not in catalog'
           WHEN NOT {real('i.product_name')} THEN 'not available' WHEN a.quantity > i.quantity THEN 'over stock' END AS own_problem
    FROM adds a LEFT JOIN (SELECT DISTINCT token, resolved_report_id AS report_id FROM resolved WHERE {_VALID}) r ON r.token = a.share_token
    LEFT JOIN t_inventory_data i ON i.id = a.inventory_id AND i.report_id = r.report_id),
firsts AS (SELECT user_id, share_token FROM checked WHERE own_problem IS NULL
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY requested_at, request_id) = 1),
judged AS (
    SELECT c.*, coalesce(c.own_problem, CASE WHEN c.share_token <> coalesce(h.share_token, f.share_token) THEN 'other catalog' END) AS problem,
      c.available - coalesce(h.quantity * CAST(h.inventory_id = c.inventory_id AS INT), 0) AS room
    FROM checked c LEFT JOIN carts h ON h.user_id = c.user_id LEFT JOIN firsts f ON f.user_id = c.user_id),
queue AS (SELECT *, row_number() OVER (PARTITION BY user_id, inventory_id ORDER BY requested_at, request_id) AS nth FROM judged WHERE problem IS NULL),
served AS (
    SELECT request_id, user_id, inventory_id, nth, quantity <= room AS added, room - CASE WHEN quantity <= room THEN quantity ELSE 0 END AS room
    FROM queue WHERE nth = 1
    UNION ALL
    SELECT q.request_id, q.user_id, q.inventory_id, q.nth, q.quantity <= s.room, s.room - CASE WHEN q.quantity <= s.room THEN q.quantity ELSE 0 END
    FROM served s JOIN queue q ON q.user_id = s.user_id AND q.inventory_id = s.inventory_id AND q.nth = s.nth + 1),
verdicts AS (
    SELECT j.*, coalesce(j.problem, CASE WHEN s.added THEN 'added' ELSE 'over stock' END) AS verdict
    FROM judged j LEFT JOIN served s ON s.request_id = j.request_id)"""


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE" + sql[len("WITH"):]


_add("merge_cart", [INV, REP, CAT], f", {_RESOLVED}, {_MERGE} SELECT request_id, user_id, inventory_id, quantity, verdict FROM verdicts")
_SQL["merge_cart"] = _recursive(_SQL["merge_cart"])
_add(
    "merge_cart_lines", [INV, REP, CAT],
    f""", {_RESOLVED}, {_MERGE}, added AS (SELECT user_id, inventory_id, share_token, report_id, product_name, category, unit_price, CAST(sum(quantity) AS INT) AS n,
         min(requested_at) AS added_at FROM verdicts WHERE verdict = 'added' GROUP BY ALL)
    SELECT c.user_id, c.share_token, c.inventory_id, c.report_id, c.product_name, c.category, {money('c.unit_price')} AS unit_price,
      CAST(c.quantity + coalesce(a.n, 0) AS INT) AS quantity, c.cart_item_id, c.created_at
    FROM carts c LEFT JOIN added a ON a.user_id = c.user_id AND a.inventory_id = c.inventory_id AND a.share_token = c.share_token
    UNION ALL
    SELECT a.user_id, a.share_token, a.inventory_id, a.report_id, a.product_name, a.category, {money('a.unit_price')}, a.n,
      {key_id('a.user_id', 'a.inventory_id', 'a.share_token', 'a.added_at')}, a.added_at FROM added a
    WHERE NOT EXISTS (SELECT 1 FROM carts c WHERE c.user_id = a.user_id AND c.inventory_id = a.inventory_id AND c.share_token = a.share_token)""",
)
_SQL["merge_cart_lines"] = _recursive(_SQL["merge_cart_lines"])
_add(
    "update_cart_quantity", [CART, INV],
    f""", wanted AS (SELECT ch.*, CASE WHEN ({whole('ch.quantity')}) >= 0 THEN ({whole('ch.quantity')}) END AS n, i.quantity AS stock
      FROM ({derived.CART_CHANGES}) ch JOIN t_cart_items c ON c.cart_item_id = ch.cart_item_id AND c.user_id = ch.user_id
      LEFT JOIN t_inventory_data i ON i.id = c.inventory_id AND i.report_id = c.report_id),
    outcome AS (SELECT cart_item_id, bool_or(coalesce(n = 0, false)) AS removed,
      last(n ORDER BY changed_at, change_id) FILTER (WHERE n <= coalesce(stock, 0)) AS n FROM wanted GROUP BY 1)
    SELECT c.cart_item_id, c.user_id, c.share_token, c.inventory_id, c.report_id, c.product_name, c.category, {money('c.unit_price')} AS unit_price,
      coalesce(o.n, c.quantity) AS quantity, c.created_at
    FROM t_cart_items c LEFT JOIN outcome o ON o.cart_item_id = c.cart_item_id WHERE NOT coalesce(o.removed, false)""",
)
# Carts are served one by one within their report: the state of the recursion is the list of stock left, by place.
_CHECKOUT = f"""places AS (SELECT id, report_id, quantity, price, row_number() OVER (PARTITION BY report_id ORDER BY id) AS place FROM t_inventory_data),
shelves AS (SELECT report_id, list(CAST(quantity AS BIGINT) ORDER BY place) AS stock FROM places GROUP BY 1),
asked AS (SELECT c.report_id, c.user_id, c.share_token, p.place, sum(c.quantity) AS units, max(c.created_at) AS ordered_at, sum(p.price * c.quantity) AS amount
    FROM t_cart_items c LEFT JOIN places p ON p.id = c.inventory_id AND p.report_id = c.report_id GROUP BY 1, 2, 3, 4),
carts AS (SELECT report_id, user_id, share_token, max(ordered_at) AS created_at, sum(amount) AS total_amount, bool_or(place IS NULL) AS has_missing,
    list(struct_pack(place := place, units := units)) AS lines FROM asked GROUP BY 1, 2, 3),
queue AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY created_at,
    md5('{{"report_id":"' || report_id || '","user_id":' || user_id || ',"share_token":"' || share_token || '"}}')) AS nth FROM carts),
served AS (
    SELECT report_id, CAST(0 AS BIGINT) AS nth, false AS accepted, stock FROM shelves
    UNION ALL
    SELECT report_id, nth, accepted, CASE WHEN accepted THEN list_transform(stock, lambda s, i:
        s - coalesce(list_sum(list_transform(list_filter(lines, lambda l: l.place = i), lambda l: l.units)), 0)) ELSE stock END
    FROM (SELECT q.report_id, q.nth, q.lines, s.stock, NOT q.has_missing
            AND len(list_filter(q.lines, lambda l: l.units > s.stock[l.place])) = 0 AS accepted
          FROM served s JOIN queue q ON q.report_id = s.report_id AND q.nth = s.nth + 1) step)"""
_add(
    "checkout", [CART, INV],
    f""", {_CHECKOUT} SELECT q.report_id, q.user_id, q.share_token, q.created_at, {money('q.total_amount')} AS total_amount,
      CASE WHEN s.accepted THEN 'confirmed' WHEN q.has_missing THEN 'missing' ELSE 'over stock' END AS verdict
    FROM queue q JOIN served s ON s.report_id = q.report_id AND s.nth = q.nth""",
)
_SQL["checkout"] = _SQL["stream_checkout"] = _recursive(_SQL["checkout"])
_REF = """md5('{"report_id":"' || q.report_id || '","user_id":' || q.user_id || ',"share_token":"' || q.share_token || '"}')"""
_TAKEN = f"""taken AS (SELECT q.report_id, q.user_id, q.share_token, q.created_at, q.total_amount, {key_id(_REF, 'q.created_at')} AS order_id
    FROM queue q JOIN served s ON s.report_id = q.report_id AND s.nth = q.nth WHERE s.accepted)"""
_OF_CART = "k.report_id = c.report_id AND k.user_id = c.user_id AND k.share_token = c.share_token"
_add(
    "checkout_orders", [CART, INV, USERS],
    f""", {_CHECKOUT}, {_TAKEN} SELECT k.order_id, k.user_id, u.username, 'Confirmed' AS status, k.share_token, k.report_id,
      {money('k.total_amount')} AS total_amount, k.created_at FROM taken k LEFT JOIN t_app_users u ON u.user_id = k.user_id""",
)
_add(
    "checkout_order_items", [CART, INV],
    f""", {_CHECKOUT}, {_TAKEN} SELECT {key_id('k.order_id', 'c.cart_item_id')} AS order_item_id, k.order_id, c.inventory_id, c.product_name, c.category,
      {money('c.unit_price')} AS unit_price, c.quantity, {money('c.unit_price * c.quantity')} AS line_total FROM t_cart_items c JOIN taken k ON {_OF_CART}""",
)
_add(
    "checkout_cart", [CART, INV],
    f", {_CHECKOUT}, {_TAKEN} SELECT {_CART_COLS} FROM t_cart_items c WHERE NOT EXISTS (SELECT 1 FROM taken k WHERE {_OF_CART})",
)
for _name in ("checkout_orders", "checkout_order_items", "checkout_cart"):
    _SQL[_name] = _recursive(_SQL[_name])
_add(
    "apply_repaired_pointers", [CAT, REP, INV],
    f""", {_RESOLVED} SELECT share_id, title, token, CASE WHEN is_repaired THEN resolved_report_id ELSE source_report_id END AS source_report_id,
    qr_filename, status, expires_at, created_at FROM resolved""",
)
_add(
    "checkout_inventory", [CART, INV],
    f""", {_CHECKOUT}, ends AS (SELECT report_id, count(*) AS nth FROM carts GROUP BY 1),
    left_over AS (SELECT s.report_id, s.stock FROM served s LEFT JOIN ends e ON e.report_id = s.report_id WHERE s.nth = coalesce(e.nth, 0))
    SELECT p.id, p.report_id, CAST(l.stock[p.place] AS INT) AS quantity FROM places p JOIN left_over l ON l.report_id = p.report_id""",
)
_SQL["checkout_inventory"] = _recursive(_SQL["checkout_inventory"])
_add(
    "apply_order_status", [ORD],
    f""", last AS (SELECT order_id, arg_max(CASE lower(trim(status)) WHEN 'shipped' THEN 'Shipped' WHEN 'delivered' THEN 'Delivered' ELSE 'Packed' END,
        strftime(changed_at, '%Y%m%d%H%M%S') || change_id) AS status
      FROM ({derived.STATUS_CHANGES}) c WHERE lower(trim(status)) <> 'lost' GROUP BY 1)
    SELECT o.order_id, o.user_id, o.username, coalesce(l.status, o.status) AS status, o.share_token, o.report_id,
      {money('o.total_amount')} AS total_amount, o.created_at FROM t_orders o LEFT JOIN last l ON l.order_id = o.order_id""",
)
_add(
    "clean_invalid_categories", [INV],
    f"""SELECT {_INV_COLS} FROM t_inventory_data WHERE NOT ((category IS NULL OR trim(category) = '' OR lower(trim(category)) = 'uncategorized')
    AND NOT {real('product_name')})""",
)
_add(
    "apply_category_repairs", [INV, PRO],
    f""", {_REPAIRS} SELECT i.id, i.report_id, i.user_id, i.product_name, CASE WHEN r.id IS NULL THEN i.category ELSE r.new_category END AS category,
      {money('i.price')} AS price, i.quantity, i.reorder_level, i.supplier_name, i.branch_name, i.image_url, i.entry_date, i.created_at,
      r.id IS NOT NULL AS is_repaired FROM t_inventory_data i LEFT JOIN repairs r ON r.id = i.id""",
)
_add("normalize_stored_tokens", [], f"SELECT page_id, coalesce({token('url')}, url) AS token FROM pages")
_add(
    "upsert_shared_catalogs", [CAT, REP],
    f"""SELECT coalesce(c.share_id, {key_id('r.token')}) AS share_id, coalesce(r.title, c.title) AS title, coalesce(r.token, c.token) AS token, coalesce(r.report_id, c.source_report_id) AS source_report_id,
      c.qr_filename, CASE WHEN r.token IS NULL THEN c.status ELSE 'active' END AS status,
      CASE WHEN r.token IS NULL THEN c.expires_at END AS expires_at, coalesce(c.created_at, r.created_at) AS created_at
    FROM t_shared_catalogs c FULL JOIN t_uploaded_reports r ON r.token = c.token""",
)
_DECIDED = f"""decisions AS ({derived.REVIEW_DECISIONS}),
facing AS (SELECT d.*, r.email, r.username, r.status AS old_status,
    min(CASE WHEN d.decision = 'reject' THEN strftime(d.decided_at, '%Y%m%d') || lpad(CAST(d.decision_id AS STRING), 15, '0') END)
      OVER (PARTITION BY d.request_id) AS first_reject,
    strftime(d.decided_at, '%Y%m%d') || lpad(CAST(d.decision_id AS STRING), 15, '0') AS k
  FROM decisions d JOIN t_admin_requests r ON r.id = d.request_id),
counted AS (SELECT * FROM facing WHERE decision = 'reject' OR (old_status <> 'rejected' AND (first_reject IS NULL OR k < first_reject))),
final AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY k DESC) = 1)"""
_add(
    "review_requests", [REQ],
    f""", {_DECIDED} SELECT r.id, r.email, r.username, CASE f.decision WHEN 'reject' THEN 'rejected' WHEN 'approve' THEN 'approved' ELSE r.status END AS status,
      coalesce(f.reviewer_id, r.reviewed_by) AS reviewed_by, coalesce(f.decided_at, r.reviewed_at) AS reviewed_at, r.created_at
    FROM t_admin_requests r LEFT JOIN final f ON f.request_id = r.id""",
)
_add(
    "review_codes", [REQ, CODES],
    f""", {_DECIDED} SELECT c.id, c.request_id, c.code, c.email, c.expires_at,
      CASE WHEN c.status = 'active' AND c.used_at IS NULL AND f.request_id IS NOT NULL THEN 'inactive' ELSE c.status END AS status, c.used_at, c.created_at
    FROM t_admin_access_codes c LEFT JOIN final f ON f.request_id = c.request_id
    UNION ALL
    SELECT {key_id('d.decision_id', 'd.request_id')}, d.request_id, d.code, d.email, d.code_expires_at, CASE WHEN f.decision_id = d.decision_id THEN 'active' ELSE 'inactive' END, NULL, d.decided_at
    FROM counted d JOIN final f ON f.request_id = d.request_id WHERE d.decision = 'approve'""",
)
_add(
    "review_notifications", [REQ],
    f""", {_DECIDED} SELECT {key_id('decision_id', 'request_id')} AS id, request_id, email, username, CASE decision WHEN 'reject' THEN 'Your admin request was not approved.'
      ELSE 'Your admin request has been approved. You may continue. Admin access code: ' || code END AS message, decided_at AS created_at FROM counted""",
)
_add(
    "mark_codes_used", [CODES, ORD],
    """SELECT c.id, c.request_id, c.code, c.email, c.expires_at, CASE WHEN o.order_id IS NOT NULL THEN 'used' ELSE c.status END AS status,
      coalesce(c.used_at, o.created_at) AS used_at, c.created_at
    FROM t_admin_access_codes c LEFT JOIN t_orders o ON o.order_id = c.id AND o.status = 'Delivered'""",
)
_add(
    "attach_pictures", [CAT, REP],
    """SELECT c.share_id, c.title, c.token, c.source_report_id, coalesce(r.token || '.png', c.qr_filename) AS qr_filename, c.status, c.expires_at,
      c.created_at FROM t_shared_catalogs c LEFT JOIN t_uploaded_reports r ON r.token = c.token""",
)
_add(
    "append_activity", [LOG, ORD],
    """SELECT * FROM t_activity_logs UNION ALL SELECT NULL, user_id, 'Checkout completed', NULL, created_at FROM t_orders""",
)
_add(
    "reset_tables", [USERS, INV, ORD],
    """SELECT 'inventory_data' AS table_name, CAST(0 AS BIGINT) AS row_count, (SELECT count(*) FROM t_inventory_data) AS removed_rows
    UNION ALL SELECT 'orders', 0, (SELECT count(*) FROM t_orders) UNION ALL SELECT 'app_users', count(*), NULL FROM t_app_users""",
)
