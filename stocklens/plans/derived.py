"""Inputs of the registered queries that the test tables do not hold: derived from them by SQL both engines read.

They cover the whole source tables, so the work of a query grows with the data.
"""

import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from stocklens.sources.adapters import LINE_ID

LINE_KEY = (
    "lpad(CAST(l_orderkey AS STRING), 15, '0') || CAST(l_linenumber AS STRING)"
    " || lpad(CAST(l_partkey AS STRING), 12, '0') || lpad(CAST(l_suppkey AS STRING), 12, '0')"
)

_FILE = "'upload/R' || CAST(p_partkey % 25 AS STRING) || '.xlsx'"
_TITLES = "CAST((p_partkey % 25) % 4 AS INT)"
_BODY_ROW = f"{_TITLES} + 1 + CAST(floor(p_partkey / 25.0) AS INT)"

_PRICE = "CASE WHEN p_partkey % 31 = 0 THEN 'on request' ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) END"
_COUNT = (
    "CASE p_partkey % 7 WHEN 0 THEN CAST(p_size AS STRING) || '.5' WHEN 1 THEN '-' || CAST(p_size AS STRING)"
    " WHEN 2 THEN ' ' || CAST(p_size AS STRING) || ' ' WHEN 3 THEN 'many' ELSE CAST(p_size AS STRING) END"
)


def _header(canonical: str, alias: str, other: str) -> str:
    return f"CASE (p_partkey % 25) % 3 WHEN 0 THEN {canonical} WHEN 1 THEN {alias} ELSE {other} END"


_HEADERS = [
    (0, _header("'product_name'", "' Item Name '", "'Product'")),
    (1, _header("'Category'", "'Dept'", "'unnamed: 1'")),
    (2, "CASE WHEN (p_partkey % 25) % 5 = 4 THEN 'Remark' ELSE " + _header("'price'", "'Rate'", "'Unit--Price'") + " END"),
    (3, _header("'quantity'", "'QTY'", "'Hand-in-Stock'")),
    (5, _header("'date'", "'Order Date'", "'stock'")),
    (6, "'Empty column'"),
]
_BODY = [
    (0, "CASE WHEN p_partkey % 37 = 0 THEN '  ' ELSE ' ' || p_name || ' ' || p_brand END"),
    (1, "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type || '  x' END"),
    (2, _PRICE),
    (3, _COUNT),
    (5, "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '2024-02-30' ELSE '2024-03-05 00:00:00' END"),
]

_TITLE_CELLS = [(0, 0, 0, "'Stock list'"), (1, 1, 0, "'Printed'"), (1, 1, 4, "'by date'")]

# Cells of one workbook per report: title rows, a header row under one of three wordings, and one row per part.
CELLS = " UNION ALL ".join(
    [f"SELECT {_FILE} AS path, {_BODY_ROW} AS row_idx, {col} AS col_idx, {value} AS value FROM part" for col, value in _BODY]
    + [f"SELECT DISTINCT {_FILE}, {_TITLES}, {col}, {value} FROM part" for col, value in _HEADERS]
    + [f"SELECT DISTINCT {_FILE}, {row}, {col}, {value} FROM part WHERE (p_partkey % 25) % 4 > {least}"
       for least, row, col, value in _TITLE_CELLS]
)
CELLS = f"SELECT path, row_idx, col_idx, value FROM ({CELLS}) c WHERE value IS NOT NULL"


def _inline(cells: list[tuple[str, int, str]]) -> str:
    structs = [f"struct({row} AS row_idx, {col} AS col_idx, {value} AS value)" for row, col, value in cells]
    return f"inline(array({', '.join(structs)}))"


# The same cells from two scans, for Spark.
SPARK_CELLS = f"""
    SELECT path, row_idx, col_idx, value FROM (
        SELECT {_FILE} AS path, {_inline([(_BODY_ROW, col, value) for col, value in _BODY])} FROM part
        UNION ALL
        SELECT {_FILE} AS path, {_inline(
            [(_TITLES, col, value) for col, value in _HEADERS]
            + [(str(row), col, f"CASE WHEN (p_partkey % 25) % 4 > {least} THEN {value} END")
               for least, row, col, value in _TITLE_CELLS]
        )} FROM (SELECT DISTINCT p_partkey % 25 AS p_partkey FROM part) files) c
    WHERE value IS NOT NULL"""

# Cells of many small workbooks, a thousand parts each, to be packed into files.
FILE_CELLS = " UNION ALL ".join(
    f"SELECT 'upload/F' || CAST(CAST(floor(p_partkey / 1000.0) AS BIGINT) AS STRING) || '.xlsx' AS path,"
    f" CAST(p_partkey % 1000 AS INT) AS row_idx, {col} AS col_idx, {value} AS value FROM part"
    for col, value in ((0, "p_name || ' & ' || p_brand"), (2, "p_type"), (5, "CAST(p_size AS STRING)"))
)

# Upload files with a header row, a thousand parts each.
_UPLOAD = "'upload/U' || CAST(CAST(floor(p_partkey / 1000.0) AS BIGINT) AS STRING) || '.xlsx'"
_UPLOAD_HEADERS = [(0, "'Product Name'"), (1, "'Dept'"), (2, "'Rate'"), (3, "'QTY'")]
_UPLOAD_BODY = [(0, "p_name || ' ' || p_brand"), (1, "CASE WHEN p_partkey % 3 > 0 THEN p_type END"), (2, _PRICE), (3, _COUNT)]
UPLOAD_CELLS = " UNION ALL ".join(
    [f"SELECT {_UPLOAD} AS path, CAST(p_partkey % 1000 AS INT) + 1 AS row_idx, {col} AS col_idx, {value} AS value FROM part" for col, value in _UPLOAD_BODY]
    + [f"SELECT DISTINCT {_UPLOAD}, 0, {col}, {value} FROM part" for col, value in _UPLOAD_HEADERS]
)
UPLOAD_CELLS = f"SELECT path, row_idx, col_idx, value FROM ({UPLOAD_CELLS}) c WHERE value IS NOT NULL"
# What the uploads hold, file by file.
UPLOAD_ROWS = f"SELECT {_UPLOAD} AS path, p_name || ' ' || p_brand AS product_name, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS category, {_PRICE} AS price, {_COUNT} AS quantity FROM part"

TEMPLATE_ROWS = f"""
    SELECT CASE WHEN p_partkey % 41 = 0 THEN ' ' ELSE ' ' || p_name || ' ' END AS name,
           CASE WHEN p_partkey % 43 = 0 THEN '' ELSE p_type END AS category,
           CASE WHEN p_partkey % 31 = 0 THEN 'on request' WHEN p_partkey % 29 = 0 THEN '-5'
                ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) END AS price,
           {_COUNT} AS quantity
    FROM part"""

INVENTORY_EDITS = f"""
    SELECT l_partkey AS id, {LINE_KEY} AS edit_id, l_shipdate AS edited_at,
           '  Item ' || CAST(l_partkey AS STRING) || ' ' AS product_name,
           CASE l_linenumber % 3 WHEN 0 THEN ' ' WHEN 1 THEN ' New   Line' ELSE 'NULL' END AS category,
           CASE l_linenumber % 4 WHEN 0 THEN 'abc' ELSE CAST(CAST(l_quantity AS INT) AS STRING) || '.25' END AS price,
           CASE l_suppkey % 5 WHEN 0 THEN '3.5' WHEN 1 THEN '-1' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS quantity,
           CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE '7' END AS reorder_level,
           ' ' AS supplier_name, ' Branch ' AS branch_name, CAST(NULL AS STRING) AS image_url,
           CASE l_linenumber % 2 WHEN 0 THEN '' ELSE '2024-05-05' END AS entry_date
    FROM lineitem"""

STATUS_CHANGES = f"""
    SELECT l_orderkey AS order_id, {LINE_KEY} AS change_id, l_shipdate AS changed_at,
           CASE l_linenumber % 4 WHEN 0 THEN 'shipped ' WHEN 1 THEN 'DELIVERED' WHEN 2 THEN 'lost' ELSE ' packed' END AS status
    FROM lineitem"""

CART_CHANGES = f"""
    SELECT {LINE_ID} AS cart_item_id, o_custkey AS user_id, l_shipdate AS changed_at, 'a' AS change_id,
           CASE l_linenumber % 4 WHEN 0 THEN '2.5' WHEN 1 THEN '-2' WHEN 2 THEN CAST(CAST(l_tax * 100 AS INT) AS STRING)
                ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS quantity
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    UNION ALL
    SELECT {LINE_ID}, o_custkey, l_shipdate, 'b', CAST(CAST(l_discount * 100 AS INT) AS STRING)
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""

# The same changes from one scan and one join, for Spark.
SPARK_CART_CHANGES = f"""
    SELECT {LINE_ID} AS cart_item_id, o_custkey AS user_id, l_shipdate AS changed_at, change_id, quantity
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, inline(array(
              struct('a' AS change_id, CASE l_linenumber % 4 WHEN 0 THEN '2.5' WHEN 1 THEN '-2' WHEN 2 THEN CAST(CAST(l_tax * 100 AS INT) AS STRING)
                     ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS quantity),
              struct('b' AS change_id, CAST(CAST(l_discount * 100 AS INT) AS STRING) AS quantity)))
          FROM lineitem) c JOIN orders ON o_orderkey = l_orderkey"""

CART_ADDS = f"""
    SELECT {LINE_KEY} AS request_id, o_orderdate AS requested_at, o_custkey AS user_id,
           'tok' || CAST(l_partkey % 25 AS STRING) AS share_token, l_partkey AS inventory_id,
           CAST(l_quantity AS INT) - 1 AS quantity
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'"""

# One open line per user with a recent part-shipped order.
OPEN_CARTS = f"""
    SELECT cart_item_id, user_id, share_token, inventory_id, report_id, product_name, category, unit_price, quantity, created_at
    FROM (SELECT {LINE_ID} AS cart_item_id, o_custkey AS user_id, 'tok' || CAST(l_partkey % 25 AS STRING) AS share_token,
                 l_partkey AS inventory_id, 'R' || CAST(l_partkey % 25 AS STRING) AS report_id,
                 p_name || ' ' || p_brand AS product_name, p_type AS category,
                 CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price, 1 AS quantity, o_orderdate AS created_at,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, {LINE_ID}) AS nth
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
          WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2000-01-01 00:00:00') n
    WHERE nth = 1"""

REVIEW_DECISIONS = """
    SELECT o_orderkey AS decision_id, o_custkey AS request_id, o_orderdate AS decided_at,
           CASE o_orderpriority WHEN '5-LOW' THEN 'reject' ELSE 'approve' END AS decision,
           o_custkey % 10 AS reviewer_id, 'N' || CAST(o_orderkey AS STRING) AS code, CAST(NULL AS STRING) AS code_expires_at
    FROM orders"""

SCANNED = """
    SELECT p_partkey AS scan_id,
           CASE p_partkey % 5 WHEN 0 THEN ' https://shop.example.com/product/' || CAST(p_partkey AS STRING) || '?qr=1 '
                WHEN 1 THEN CAST(p_partkey AS STRING)
                WHEN 2 THEN '{"url": "/product/' || CAST(p_partkey AS STRING) || '"}'
                WHEN 3 THEN '{"name": "' || p_name || '"}' ELSE p_name END AS scanned
    FROM part"""

FORM_VALUES = """
    SELECT p_partkey AS form_id,
           CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN CAST(p_size AS STRING) || '.50'
                WHEN 2 THEN '-' || CAST(p_size AS STRING) WHEN 3 THEN ' ' || CAST(p_size AS STRING) || ' '
                WHEN 4 THEN '' ELSE p_name END AS entered
    FROM part"""


def pack_workbooks(cells: DataFrame) -> DataFrame:
    """Workbook files as (path, content). A file holds a thousand rows, so its cells fit one row of Spark."""
    packed = cells.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("row_idx", "col_idx", "value"))).alias("cells"))
    return packed.mapInPandas(_pack, "path string, content binary")


def save_workbooks(files: DataFrame, folder: str) -> None:
    """Write (path, content) files below a folder that all tasks share; a repeated task writes the same bytes again."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            store, root = pafs.FileSystem.from_uri(folder)
            for path, content in zip(batch["path"], batch["content"], strict=True):
                store.create_dir(f"{root}/{path}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{root}/{path}") as out:
                    out.write(bytes(content))
            yield batch[["path"]]

    files.mapInPandas(save, "path string").count()


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame(
            {"path": batch["path"], "content": [workbook_bytes(_as_rows(cells)) for cells in batch["cells"]]}
        )


def _as_rows(cells) -> dict[int, dict[int, str]]:
    rows: dict[int, dict[int, str]] = {}
    for cell in cells:
        rows.setdefault(int(cell["row_idx"]), {})[int(cell["col_idx"])] = cell["value"]
    return rows


def workbook_bytes(rows: dict[int, dict[int, str]]) -> bytes:
    """A minimal spreadsheet file with text cells at the given places."""
    body = []
    for row, cells in sorted(rows.items()):
        inner = "".join(
            f'<c r="{chr(ord("A") + col)}{row + 1}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
            for col, text in sorted(cells.items())
        )
        body.append(f'<row r="{row + 1}">{inner}</row>')
    sheet = (
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
        + "".join(body) + "</sheetData></worksheet>"
    )
    buffer = BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("xl/worksheets/sheet1.xml", sheet)
    return buffer.getvalue()
