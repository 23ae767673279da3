import pytest
from books import BOOKS, PLAIN, workbook, write_books
from pyspark.sql import functions as F

from stocklens.functions import columns as C
from stocklens.operators import ingest
from stocklens.sources import tables, workbooks

TODAY = "2024-06-01"


@pytest.fixture(scope="module")
def upload(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    write_books(folder)
    cells = workbooks.read_workbooks(spark, str(folder)).withColumn("path", C.file_name(F.col("path"))).cache()
    header_rows = ingest.detect_header_row(cells)
    named = ingest.headers(cells, header_rows)
    mapping = ingest.auto_map_columns(ingest.header_context(named))
    status = ingest.mapping_status(header_rows, mapping)
    typed = ingest.type_rows(ingest.cells_to_records(cells, header_rows, mapping, named), TODAY)
    report = ingest.ingest_report(header_rows, named, mapping, typed, status)
    return {
        "cells": cells, "headers": named, "mapping": mapping, "typed": typed,
        "header_rows": {r.path: r.header_row for r in header_rows.collect()},
        "status": {r.path: r for r in status.collect()},
        "report": {r.path: r for r in report.collect()},
        "rows": {(r.path, r.product_name): r for r in typed.collect()},
    }


def test_only_spreadsheets_are_listed_and_broken_ones_reported(upload):
    bad = upload["cells"].filter("error IS NOT NULL").collect()
    assert [row.path for row in bad] == ["broken.xlsx"]
    paths = {row.path for row in upload["cells"].select("path").distinct().collect()}
    assert paths == {name for name in BOOKS if name.lower().endswith(".xlsx")}


def test_cells_are_placed_by_reference(upload):
    cells = {(r.row_idx, r.col_idx): r.value for r in upload["cells"].filter("path = 'sparse.xlsx'").collect()}
    assert cells[(2, 3)] == "stray" and cells[(2, 4)] == "5" and (2, 0) not in cells


def test_shared_and_inline_strings_give_the_same_cells(upload):
    def cells(name):
        rows = upload["cells"].filter(F.col("path") == name).select("row_idx", "col_idx", "value").collect()
        return sorted(map(tuple, rows))

    assert cells("plain.xlsx") == cells("inline.xlsx")


def test_header_rows(upload):
    rows = upload["header_rows"]
    assert rows["title_rows.XLSX"] == 3 and rows["plain.xlsx"] == 0 and rows["sparse.xlsx"] == 0
    assert "broken.xlsx" not in rows


def test_empty_columns_and_stray_cells_are_left_out(upload):
    found = {r.header for r in upload["headers"].filter("path = 'sparse.xlsx'").collect()}
    assert found == {"product name", "price", "quantity"}
    assert {n for p, n in upload["rows"] if p == "sparse.xlsx"} == {"Shirt", "Belt"}


def test_mapping_status(upload):
    assert upload["status"]["aliases.xlsx"].status == "success"
    assert upload["status"]["unmapped.xlsx"].missing_fields == ["price"]
    assert upload["status"]["no_category.xlsx"].warning == ingest.NO_CATEGORY_WARNING
    assert upload["report"]["aliases.xlsx"].mapped_columns == {
        "category": "Dept", "date": "Order Date", "price": "Rate", "product_name": "Item Name", "quantity": "Qty",
    }


def test_rejects_keep_their_reason(upload):
    rows = {name: row for (path, name), row in upload["rows"].items() if path == "rejects.xlsx"}
    assert rows["Good"].is_valid and str(rows["Good"].entry_date) == "2024-01-02"
    assert rows["Text price"].reason == "price is not a number"
    assert rows[""].reason == "product name is blank"
    assert rows["Cut"].quantity == 3 and rows["Minus"].quantity == -4 and rows["Cut"].is_valid
    assert rows["No count"].reason == "quantity is not a number"
    report = upload["report"]["rejects.xlsx"]
    assert (report.rows_processed, report.valid_rows, report.failed_rows) == (6, 3, 3)


def test_date_serials_and_default_day(upload):
    assert str(upload["rows"][("aliases.xlsx", "Tote")].entry_date) == "2024-01-01"
    assert str(upload["rows"][("no_category.xlsx", "Scarf")].entry_date) == TODAY


def test_manual_mapping(spark):
    mapping = spark.createDataFrame([("a", "quantity", 1, "q"), ("b", "price", 0, "p")], "path string, field string, col_idx int, header string")
    named = spark.createDataFrame([("a", 0, "n"), ("a", 1, "q"), ("a", 2, "cost x")], "path string, col_idx int, header string")
    wanted = spark.createDataFrame(
        [("a", "product_name", "n"), ("a", "price", "cost x"), ("a", "supplier", "q"), ("a", "category", "absent")],
        "path string, field string, header string",
    )
    got = sorted((r.path, r.field, r.col_idx) for r in ingest.apply_manual_mapping(mapping, named, wanted).collect())
    assert got == [("a", "price", 2), ("a", "product_name", 0), ("b", "price", 0)]


def test_oversized_files_are_reported(spark, tmp_path):
    (tmp_path / "big.xlsx").write_bytes(workbook(PLAIN))
    rows = workbooks.read_workbooks(spark, str(tmp_path), max_bytes=10).collect()
    assert len(rows) == 1 and "size limit" in rows[0].error


def test_inventory_sink_prunes_to_one_report(spark, tmp_path):
    rows = spark.range(200).select(
        "id", F.concat(F.lit("R"), (F.col("id") % 10).cast("string")).alias("report_id"), F.lit("n").alias("product_name")
    )
    path = str(tmp_path / "inventory")
    tables.append_inventory(rows, path, user_id=5)
    tables.append_inventory(rows.limit(10), path, user_id=6)
    one = tables.read_inventory(spark, path, "R3")
    assert one.count() == 21 and one.select("reorder_level").distinct().collect()[0][0] == 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "report_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(report_id,R3)" in plan


def test_old_tables_gain_new_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "product_id long, name string").write.parquet(str(tmp_path / "products"))
    row = tables.load_table(spark, str(tmp_path), "products").collect()[0]
    assert row.reorder_level == 10 and row.price is None and row.name == "a"


def test_strict_import_of_a_template(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Name,CATEGORY,price,quantity\nTote,Bags,799,20\n,Bags,1,1\nTop,Tops,-1,2\nBelt,Belts,x,2\n")
    imported = ingest.import_products_strict(spark.read.csv(str(tmp_path / "t.csv"), header=True))
    counts = ingest.import_counts(imported).collect()[0]
    assert (counts.inserted, counts.skipped) == (1, 3)
    with pytest.raises(ValueError):
        ingest.import_products_strict(spark.createDataFrame([("a",)], "name string"))


def test_report_ids_are_stable(spark):
    files = spark.createDataFrame([("f/a.xlsx",), ("f/b.xlsx",)], "path string").withColumn(
        "modificationTime", C.timestamp("2024-01-01 00:00:00")
    )
    first = {r.path: r for r in ingest.register_reports(files).collect()}
    again = {r.path: r for r in ingest.register_reports(files.repartition(3)).collect()}
    assert first == again and first["f/a.xlsx"].title == "a catalog"
    assert len(first["f/a.xlsx"].report_id) == 32 and len(first["f/a.xlsx"].token) == 16


def test_large_workbooks_are_read(spark, tmp_path):
    """No size limit unless one is asked for."""
    import random

    rng = random.Random(1)
    rows = [[f"{rng.getrandbits(256):064x}{rng.getrandbits(256):064x}", "c", n, 1, None] for n in range(60_000)]
    (tmp_path / "large.xlsx").write_bytes(workbook([PLAIN[0], *rows]))
    assert (tmp_path / "large.xlsx").stat().st_size > 10 * 2**20
    assert workbooks.read_workbooks(spark, str(tmp_path)).filter("error is null").select("row_idx").distinct().count() == 60_001
    limited = workbooks.read_workbooks(spark, str(tmp_path), max_bytes=10 * 2**20).collect()
    assert len(limited) == 1 and limited[0].error


def test_header_far_down(spark):
    title = [("a", n, c, "note") for n in range(40) for c in (0, 1)]
    header = [("a", 40, c, v) for c, v in enumerate(["product_name", "price", "quantity"])]
    body = [("a", 41, c, v) for c, v in enumerate(["Hat", "5", "2"])]
    early = [("b", 2, 0, "my product"), ("b", 2, 1, "its price"), ("b", 30, 0, "product_name"), ("b", 30, 1, "price"), ("c", 0, 0, "x"), ("c", 0, 1, "y")]
    cells = spark.createDataFrame(title + header + body + early, "path string, row_idx int, col_idx int, value string")
    found = {r.path: (r.header_row, r.header_found) for r in ingest.detect_header_row(cells).collect()}
    assert found == {"a": (40, True), "b": (2, True), "c": (0, False)}
    assert {r.path: r.header_row for r in ingest.detect_header_row(cells, depth=None).collect()}["b"] == 30


def test_cells_are_joined_once(spark):
    cells = spark.createDataFrame([("a", 0, 0, "x")], "path string, row_idx int, col_idx int, value string")
    header_rows = spark.createDataFrame([("a", 0, True)], "path string, header_row int, header_found boolean")
    named = spark.createDataFrame([("a", 0, "x", "x")], "path string, col_idx int, header string, normalized string")
    mapping = spark.createDataFrame([("a", "price", 0, "x")], "path string, field string, col_idx int, header string")
    plan = ingest.cells_to_records(cells, header_rows, mapping, named)._jdf.queryExecution().optimizedPlan().toString()
    # the cells are the left side of the topmost join: no join lies below them
    lines = plan.splitlines()
    joins = [n for n, line in enumerate(lines) if "Join" in line]
    assert len(joins) == 3 and "row_idx" in "".join(lines[joins[0] + 1 : joins[1]])


def test_counts_out_of_range_are_named(spark):
    rows = spark.createDataFrame([("p", 1, "Hat", None, "1", "3000000000", None)], "path string, row_idx int, product_name string, category string, price string, quantity string, date string")
    assert ingest.type_rows(rows, TODAY).collect()[0].reason == "quantity is out of range"
