from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from books import BOOKS, PLAIN, workbook, write_books
from pyspark.sql import functions as F

from stocklens import session
from stocklens.operators import changes, rollups, topk
from stocklens.schemas import TABLES
from stocklens.streaming import jobs

START = datetime(2024, 1, 1)
CART = "cart_item_id string, user_id long, share_token string, inventory_id long, report_id string, product_name string, category string, unit_price double, quantity int, created_at timestamp"


def test_workbooks_are_ingested_once(spark, tmp_path):
    folder, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    write_books(folder)

    def run():
        jobs.stream_ingest(spark, str(folder), sink, checkpoint, "2024-06-01", user_id=3, availableNow=True).awaitTermination()

    run()
    log = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(f"{sink}/ingest_log").collect()}
    assert log["plain.xlsx"].status == "success" and log["unmapped.xlsx"].status == "mapping_required"
    assert log["broken.xlsx"].status == "error" and "notes.txt" not in log
    stored = spark.read.parquet(f"{sink}/inventory")
    expected = {"Silk saree", "Kurti", "Tote", "Shirt", "Belt", "Good", "Cut", "Minus", "Scarf"}
    assert {r.product_name for r in stored.collect()} == expected
    assert stored.count() == stored.select("id").distinct().count() == 10
    assert stored.filter("category = 'Uncategorized'").count() == 6
    reports = spark.read.parquet(f"{sink}/uploaded_reports")
    assert stored.join(reports, "report_id", "left_anti").count() == 0 and reports.count() == 7
    assert spark.read.parquet(f"{sink}/rejected_rows").count() == 3

    run()
    assert spark.read.parquet(f"{sink}/inventory").count() == 10
    (folder / "later.xlsx").write_bytes(workbook([PLAIN[0], ["Late", "c", 1, 1, None]]))
    run()
    assert spark.read.parquet(f"{sink}/inventory").count() == 11


def test_replayed_ingest_batch_leaves_the_same_rows(spark, tmp_path):
    folder, sink = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    write_books(folder, ["plain.xlsx", "aliases.xlsx"])
    files = spark.read.format("binaryFile").load(str(folder))

    def rows():
        jobs.ingest_files(files, sink, "2024-06-01", batch_id=4)
        return sorted(map(tuple, spark.read.parquet(f"{sink}/inventory").select("id", "report_id", "product_name").collect()))

    assert rows() == rows() and len(rows()) == len({r[0] for r in rows()}) == 2
    assert BOOKS


def test_cells_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Their files are far smaller than the cells in memory."""
    folder, plans = tmp_path / "in", []
    folder.mkdir()
    write_books(folder, ["plain.xlsx", "aliases.xlsx"])
    for name in ("detect_header_row", "headers", "cells_to_records"):
        made = getattr(jobs.ingest, name)
        monkeypatch.setattr(jobs.ingest, name, lambda *a, made=made: plans.append(made(*a)) or plans[-1])
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        jobs.ingest_files(spark.read.format("binaryFile").load(str(folder)), str(tmp_path / "out"), "2024-06-01", batch_id=1)
        joins = [line for df in plans for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(plans) == 3 and any("SortMergeJoin [path" in line for line in joins)
    assert not any("Join [path" in line and "BuildLeft" in line for line in joins)


def test_a_checkout_batch_leaves_no_work_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_root", lambda _: f"file://{tmp_path}/work")
    inventory = spark.createDataFrame([(1, "R1", "p", "c", 5.0, 4)], "id long, report_id string, product_name string, category string, price double, quantity int")
    rows = [(f"l{user}", user, "t", 1, "R1", "p", "c", 5.0, 3, START + timedelta(minutes=user)) for user in (1, 2)]
    jobs.checkout_batch(spark.createDataFrame(rows, CART), inventory, str(tmp_path / "out"), 0)
    assert {(r.user_id, r.verdict) for r in jobs.committed(spark, str(tmp_path / "out"), "verdicts").collect()} == {(1, "confirmed"), (2, "over stock")}
    assert list((tmp_path / "work").iterdir()) == []


def test_trend_stream_equals_batch_however_late_a_sale_comes(spark, tmp_path):
    source, sink = tmp_path / "sales", str(tmp_path / "out")
    rows = [("p" if n % 5 else " ", n % 7, START + timedelta(hours=5 * n)) for n in range(60)]
    schema = "product_name string, quantity int, sale_date timestamp"
    parts = [rows[20:], rows[:10], [("late", 3, START - timedelta(days=900))], rows[10:20], [("p", 1, START)], [("late", 2, START - timedelta(days=60))], [(" ", 1, START)]]
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        jobs.stream_sales_trend(stream, sink, str(tmp_path / "cp"), fold_every=2, availableNow=True).awaitTermination()
        whole = spark.createDataFrame([r for some in parts[: n + 1] for r in some], schema)
        got = {r.day: r.units for r in jobs.sales_trend_of(spark, sink).collect()}
        assert got == {r.day: r.units for r in rollups.sales_trend(whole).collect()} and len(got) > 8
        assert len(jobs._batches(spark, sink, "trend")) <= 3
    assert jobs.sales_trend_of(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("snapshot_every", [1, 2, 100])
def test_a_cart_over_several_batches_is_one_order(spark, tmp_path, snapshot_every):
    schema = CART.replace("unit_price double", "unit_price decimal(12,2)")
    inventory = spark.createDataFrame([(i, "R1", f"p{i}", "c", 10.0, 40) for i in range(30)], "id long, report_id string, product_name string, category string, price double, quantity int")
    inventory = inventory.withColumn("price", F.col("price").cast("decimal(12,2)"))

    def line(user, item, minute, closes=False, quantity=1):
        return (f"l{user}-{item}-{minute}" if item is not None else None, user, "t1", item, "R1", "p", "c", Decimal("10.25") if item is not None else None, quantity if item is not None else None, START + timedelta(minutes=minute), closes)

    batches = [
        [line(1, k, 0) for k in range(12)] + [line(2, 1, 0), line(3, 2, 0)],
        [line(1, k, 1) for k in range(12, 20)] + [line(2, 2, 1, closes=True), line(4, 1, 1, quantity=50), line(4, None, 2, closes=True)],
        [line(1, 25, 2), line(1, None, 3, closes=True), line(1, 26, 4), line(5, None, 3, closes=True)],
        [line(1, None, 5, closes=True)],
    ]
    source, sink = str(tmp_path / "carts"), str(tmp_path / "out")
    (tmp_path / "carts").mkdir()
    stream = spark.readStream.schema(schema + ", closes boolean").option("maxFilesPerTrigger", 1).parquet(source)
    for batch in batches:  # every batch in a new run from the checkpoint
        spark.createDataFrame(batch, schema + ", closes boolean").coalesce(1).write.mode("append").parquet(source)
        jobs.stream_checkout(stream, inventory, sink, str(tmp_path / "cp"), snapshot_every, availableNow=True).awaitTermination()
    jobs.checkout_batch(jobs.closed_carts(spark.createDataFrame(batches[-1], schema + ", closes boolean"), sink, 3, snapshot_every), inventory, sink, 3, snapshot_every)  # replayed
    verdicts = [(r.user_id, r.verdict, r.total_amount) for r in jobs.committed(spark, sink, "verdicts").collect()]
    assert sorted(verdicts) == [(1, "confirmed", Decimal("10.00")), (1, "confirmed", Decimal("210.00")), (2, "confirmed", Decimal("20.00")), (4, "over stock", Decimal("500.00"))]
    items = jobs.committed(spark, sink, "order_items").collect()
    assert len(items) == 24 and {i.unit_price for i in items} == {Decimal("10.25")}
    assert jobs.committed(spark, sink, "orders").count() == 3
    assert len(list((tmp_path / "out" / "commits").iterdir())) <= 4
    assert snapshot_every > 1 or {p.name for p in (tmp_path / "out" / "cart_lines").iterdir()} == {"batch_id=2", "batch_id=3"}


def test_lines_that_come_after_their_closing_and_lines_nobody_closes(spark, tmp_path):
    sink, schema = str(tmp_path / "out"), "report_id string, user_id bigint, share_token string, inventory_id bigint, created_at timestamp, closes boolean"

    def batch(number, *events, **more):
        rows = [("R", 1, None, item, START + timedelta(days=day), closes) for item, day, closes in events]
        return sorted(r.inventory_id for r in jobs.closed_carts(spark.createDataFrame(rows, schema), sink, number, 2, **more).collect())

    keep = {"keep": timedelta(days=30)}
    assert batch(0, (1, 0, False), (2, 5, False)) == []
    assert batch(1, (None, 1, True), (3, 0, False)) == [1, 3]
    assert batch(2, (4, 0, False), (None, 0, False), **keep) == []  # late: the next closing takes it
    assert batch(3, (5, 40, False), **keep) == []
    assert batch(4, (6, 41, True), **keep) == [5, 6]  # 2 and 4 were forgotten at the snapshot
    assert batch(5, (None, 50, True), **keep) == []


def test_a_batch_that_fails_between_two_writes_is_not_seen(spark, tmp_path, monkeypatch):
    sink = str(tmp_path / "out")
    inventory = spark.createDataFrame([(1, "R1", "p", "c", 10.0, 9)], "id long, report_id string, product_name string, category string, price double, quantity int").withColumn("price", F.col("price").cast("decimal(12,2)"))
    carts = [spark.createDataFrame([(f"l{n}", n, "t", 1, "R1", "p", "c", 10.0, 2, START)], CART).withColumn("unit_price", F.col("unit_price").cast("decimal(12,2)")) for n in range(2)]

    def seen():
        return {table: jobs.committed(spark, sink, table).count() for table in ("orders", "order_items", "verdicts")}

    jobs.checkout_batch(carts[0], inventory, sink, 0)
    write = jobs._write
    with monkeypatch.context() as patch:
        patch.setattr(jobs, "_write", lambda df, sink, table, batch: write(df, sink, table, batch) if table != "order_items" else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.checkout_batch(carts[1], inventory, sink, 1)
    assert spark.read.parquet(f"{sink}/orders").count() == 2 and seen() == {"orders": 1, "order_items": 1, "verdicts": 1}
    jobs.checkout_batch(carts[1], inventory, sink, 1)
    assert seen() == {"orders": 2, "order_items": 2, "verdicts": 2}


def test_recently_viewed_stream_equals_batch(spark, tmp_path):
    source, sink = tmp_path / "views", str(tmp_path / "out")
    schema = "user_id bigint, item int, viewed_at timestamp"
    rows = [(n % 3 if n % 2 else 1, n * n % 11, START + timedelta(minutes=(n * 37) % 90)) for n in range(90)] + [(None, 1, START), (5, None, START)]
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    for n in range(5):
        spark.createDataFrame(rows[n::5], schema).coalesce(1).write.mode("append").parquet(str(source))
        jobs.stream_recently_viewed(stream, sink, str(tmp_path / "cp"), k=4, fold_every=2, availableNow=True).awaitTermination()
        seen = spark.createDataFrame([r for m in range(n + 1) for r in rows[m::5]], schema)
        assert sorted(map(str, jobs.recently_viewed_of(spark, sink, 4).collect())) == sorted(map(str, topk.recently_viewed(seen, 4).collect()))
        assert len(jobs._batches(spark, sink, "views")) <= 3
    later = jobs.recently_viewed_of(spark, sink, 4, START + timedelta(hours=1)).collect()
    assert later and all(r.viewed_at >= START + timedelta(hours=1) for r in later)
    assert jobs.recently_viewed_of(spark, str(tmp_path / "none")).count() == 0


def test_two_uploads_into_one_sink_keep_both(spark, tmp_path):
    folder, sink = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    write_books(folder, ["plain.xlsx", "aliases.xlsx"])
    for name in ("plain.xlsx", "aliases.xlsx"):
        jobs.ingest_files(spark.read.format("binaryFile").load(str(folder / name)), sink, "2024-06-01")
    stored = spark.read.parquet(f"{sink}/inventory")
    assert stored.count() == 2 and stored.select("batch_id").distinct().count() == 2
    jobs.ingest_files(spark.read.format("binaryFile").load(str(folder / "plain.xlsx")), sink, "2024-06-01", batch_id=10**6)
    assert spark.read.parquet(f"{sink}/inventory/batch_id=1000000").count() == 1
    assert not (tmp_path / "out" / "staging" / "batch_id=1000000").exists()
    seen = spark.createDataFrame([], TABLES["products"])
    assert {r.name for r in jobs.product_master(spark, sink, seen).collect()} == {r.product_name for r in stored.collect()}
    assert spark.read.parquet(f"{sink}/activity_logs").count() == 3


def test_overrides_map_what_was_not_mapped(spark, tmp_path):
    sink = str(tmp_path / "out")
    (tmp_path / "book.xlsx").write_bytes(workbook([["Thing", "Cost", "How many"], ["Hat", 5, 2], ["Cap", 6, 1]]))
    (tmp_path / "none.xlsx").write_bytes(workbook([["x", "y"], ["1", "2"]]))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(str(tmp_path))
    jobs.ingest_files(files, sink, "2024-06-01", batch_id=1)
    status = {r.path.rsplit("/", 1)[1]: r.status for r in spark.read.parquet(f"{sink}/ingest_log").collect()}
    assert status == {"book.xlsx": "mapping_required", "none.xlsx": "header_not_found"}
    path = [r.path for r in files.select("path").collect() if r.path.endswith("book.xlsx")][0]
    chosen = [("product_name", "Thing"), ("price", "Cost"), ("quantity", "How many")]
    overrides = spark.createDataFrame([(path, *c) for c in chosen], "path string, field string, header string")
    jobs.ingest_files(files, sink, "2024-06-01", batch_id=2, overrides=overrides)
    log = {r.path.rsplit("/", 1)[1]: r.status for r in spark.read.parquet(f"{sink}/ingest_log/batch_id=2").collect()}
    assert log["book.xlsx"] == "success"
    assert {r.product_name for r in spark.read.parquet(f"{sink}/inventory").collect()} == {"Hat", "Cap"}


def test_compaction_keeps_every_row(spark, tmp_path):
    sink = str(tmp_path / "out")
    for n in range(3):
        (tmp_path / f"b{n}.xlsx").write_bytes(workbook([PLAIN[0], [f"P{n}", "c", 1, 1, None]]))
        jobs.ingest_files(spark.read.format("binaryFile").load(str(tmp_path / f"b{n}.xlsx")), sink, "2024-06-01", batch_id=n)
    before = sorted(map(tuple, spark.read.parquet(f"{sink}/inventory").drop("batch_id").collect()))
    jobs.compact_inventory(spark, sink, [0, 1, 2], into=100)
    after = spark.read.parquet(f"{sink}/inventory")
    assert sorted(map(tuple, after.drop("batch_id").collect())) == before and {r.batch_id for r in after.collect()} == {100}


def test_checkout_opens_a_bounded_number_of_folders():
    assert len(jobs.sold_folders("s", 0, 50)) == 50
    for batch in range(1000):
        base = batch // 20 * 20
        assert len(jobs.sold_folders("s", base, batch)) <= 20


def test_checkout_stream_equals_one_batch(spark, tmp_path):
    inventory = spark.createDataFrame(
        [(i, "R1", f"p{i}", "c", 10.0, 12) for i in range(4)],
        "id long, report_id string, product_name string, category string, price double, quantity int",
    ).withColumn("price", F.col("price").cast("decimal(12,2)"))
    carts = [
        (f"l{u}-{i}", u, "t1", (u + i) % 4, "R1", "p", "c", 10.0, 1 + (u * 3 + i) % 5, START + timedelta(minutes=u))
        for u in range(30) for i in range(2)
    ]
    lines = spark.createDataFrame(carts, CART).withColumn("unit_price", F.col("unit_price").cast("decimal(12,2)"))
    source, sink = str(tmp_path / "carts"), str(tmp_path / "out")
    for first in range(0, 30, 6):
        lines.filter(F.col("user_id").between(first, first + 5)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def run():
        jobs.stream_checkout(stream, inventory, sink, str(tmp_path / "cp"), snapshot_every=2, availableNow=True).awaitTermination()

    run()
    got = {r.user_id: r.verdict for r in spark.read.parquet(f"{sink}/verdicts").collect()}
    assert got == {r.user_id: r.verdict for r in changes.checkout(lines, inventory)["verdicts"].collect()}
    run()
    assert spark.read.parquet(f"{sink}/verdicts").count() == 30
    # A replayed batch sees the stock it saw the first time.
    third = lines.filter(F.col("user_id").between(12, 17))
    jobs.checkout_batch(third, inventory, sink, 2, snapshot_every=2)
    assert {r.user_id: r.verdict for r in spark.read.parquet(f"{sink}/verdicts").collect()} == got
