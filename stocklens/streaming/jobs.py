"""Continuous ingestion, sales trend and checkout.

Writes of a micro-batch go to a folder of that batch and replace it, so a batch that is replayed after a failure leaves
the same files. Queries are started by the caller's options (trigger, checkpoint folder) and returned running.
"""

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from stocklens.functions import columns as C
from stocklens.operators import changes, ingest, topk
from stocklens.schemas import TABLES, TEXTS
from stocklens.session import WorkTables, folder_exists, folder_names, remove_folder
from stocklens.sources.tables import append_inventory, conform_schema, report_bucket
from stocklens.sources.workbooks import CELL_SCHEMA, WORKBOOK_GLOB, cells_of

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _write(df: DataFrame, sink: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{sink}/{table}/batch_id={batch_id}")


def batch_number(files: DataFrame) -> int:
    """A number of the list of files: a digest over path and time that does not depend on their order."""
    of_file = C.key_id(F.col("path"), F.col("modificationTime"))
    row = files.agg(F.bit_xor(of_file).alias("digest"), F.count("*").alias("n")).first()
    return (row["digest"] or 0) ^ row["n"]


def ingest_files(
    files: DataFrame, sink: str, today: str, user_id: int | None = None, batch_id: int | None = None,
    max_bytes: int | None = None, overrides: DataFrame | None = None,
) -> None:
    """Ingest workbooks given as (path, modificationTime, length, content) into the tables under ``sink``.

    Every call has its own ``batch_id``; without one it is :func:`batch_number` of the files, so the same upload replaces
    itself and another upload never does. ``overrides`` (path, field, header) map columns by hand. Tables:
    ``inventory``, ``uploaded_reports``, ``products_seen``, ``activity_logs``, ``rejected_rows`` and ``ingest_log``.

    Cells, and then typed rows, are written to staging tables that several steps read, because unpacking the workbooks
    or mapping their columns again would cost more; staging goes when the batch is done.
    """
    spark = files.sparkSession
    if batch_id is None:
        batch_id = batch_number(files.select("path", "modificationTime"))
    fits = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    staging = f"{sink}/staging/batch_id={batch_id}"
    files.select("path", "modificationTime", fits.alias("fits")).write.mode("overwrite").parquet(f"{staging}/files")
    cells_of(files.filter(fits)).write.mode("overwrite").parquet(f"{staging}/cells")
    listed = spark.read.parquet(f"{staging}/files")
    staged = spark.read.schema(CELL_SCHEMA).parquet(f"{staging}/cells")

    def stage(name: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{staging}/{name}")
        return spark.read.schema(table.schema).parquet(f"{staging}/{name}")

    # Cells take little room in files and much in memory: by their size on disk alone Spark would broadcast all of them.
    cells = staged.filter(F.col("error").isNull()).drop("error").hint("merge")
    header_rows = stage("headers", ingest.detect_header_row(cells))  # these three have a few rows per file
    named = stage("named", ingest.headers(cells, header_rows))
    mapping = ingest.auto_map_columns(ingest.header_context(named))
    if overrides is not None:
        mapping = ingest.apply_manual_mapping(mapping, named, overrides)
    mapping = stage("mapping", mapping)
    status = ingest.mapping_status(header_rows, mapping)
    complete = status.filter(F.col("status") == "success").select("path")
    records = ingest.cells_to_records(cells, header_rows, mapping.join(complete, "path", "left_semi"), named.join(complete, "path", "left_semi"))
    rows = ingest.type_rows(records, today)
    rows.write.mode("overwrite").partitionBy("is_valid").parquet(f"{staging}/typed")
    typed = spark.read.schema(rows.schema).parquet(f"{staging}/typed")

    log = ingest.ingest_report(header_rows, named, mapping, typed, status)
    failed = (
        staged.filter(F.col("error").isNotNull())
        .select("path", "error")
        .unionByName(listed.filter("NOT fits").select("path", F.lit(TEXTS["file_too_large"]).alias("error")))
    )
    log = (
        listed.select("path")
        .join(log, "path", "left")
        .join(failed, "path", "left")
        .withColumn("status", F.when(F.coalesce("valid_rows", F.lit(0)) > 0, "success").otherwise(
            F.when(F.col("status").isin("mapping_required", "header_not_found"), F.col("status")).otherwise("error")
        ))
    )
    _write(log, sink, "ingest_log", batch_id)
    _write(ingest.split_rows(typed)[1], sink, "rejected_rows", batch_id)

    done = spark.read.parquet(f"{sink}/ingest_log/batch_id={batch_id}").filter(F.col("status") == "success")
    reports = ingest.register_reports(listed.join(done.select("path"), "path", "left_semi"), user_id)
    _write(reports, sink, "uploaded_reports", batch_id)
    reports = spark.read.schema(reports.schema).parquet(f"{sink}/uploaded_reports/batch_id={batch_id}")
    inventory = ingest.inventory_of(typed, reports, user_id)
    target = f"{sink}/inventory/batch_id={batch_id}"
    append_inventory(inventory, target, mode="overwrite")
    stored = spark.read.schema(TABLES["inventory_data"]).parquet(target)
    if not ingest.repeated_ids(stored).isEmpty():
        remove_folder(spark, target)
        raise ValueError(f"batch {batch_id}: two rows of a report share an id")
    _write(products_of(stored), sink, "products_seen", batch_id)
    logged = changes.activity_rows(
        reports.select(F.lit(None).cast("string").alias("actor_username"), F.col("source_file_name").alias("detail"), "created_at"), TEXTS["upload_log"]
    )
    _write(logged, sink, "activity_logs", batch_id)
    remove_folder(spark, staging)


def products_of(inventory: DataFrame) -> DataFrame:
    """One row per product of an upload, the last one in the report's order winning: input of the product master."""
    details = ["price", "quantity", "reorder_level", "supplier_name", "branch_name", "image_url"]
    return (
        inventory.groupBy(F.col("product_name").alias("name"), "category")
        .agg(F.max_by(F.struct(*details, F.col("created_at").alias("loaded_at")), F.struct("created_at", "id")).alias("d"))
        .select("name", "category", "d.*")
    )


def product_master(spark: SparkSession, sink: str, products: DataFrame) -> DataFrame:
    """``products`` after all uploads of the sink."""
    return ingest.merge_product_master(products, spark.read.parquet(f"{sink}/products_seen").drop("batch_id"))


def compact_inventory(spark: SparkSession, sink: str, batches: list[int], into: int) -> None:
    """Merge the inventory folders of finished ``batches`` into one folder ``batch_id=into``, which is none of them.

    Small batches leave small files. To be run while nobody reads these batches; a failure before the last step leaves
    the old folders in place, and running again replaces the new one.
    """
    if into in batches:
        raise ValueError("choose a number of its own for the merged batch")
    folders = [f"{sink}/inventory/batch_id={b}" for b in batches]
    merged = spark.read.option("basePath", f"{sink}/inventory").parquet(*folders).drop("batch_id", "report_bucket")
    append_inventory(merged, f"{sink}/compacting/batch_id={into}", mode="overwrite")
    rows = spark.read.parquet(f"{sink}/compacting/batch_id={into}").drop("report_bucket")
    append_inventory(conform_schema(rows, TABLES["inventory_data"]), f"{sink}/inventory/batch_id={into}", mode="overwrite")
    for folder in [*folders, f"{sink}/compacting"]:
        remove_folder(spark, folder)


def stream_ingest(
    spark: SparkSession, folder: str, sink: str, checkpoint: str, today: str, user_id: int | None = None,
    files_per_trigger: int = 1000, max_bytes: int | None = None, **trigger,
) -> StreamingQuery:
    """Ingest workbooks as they arrive in ``folder``."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", WORKBOOK_GLOB)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(folder)
    )

    def ingest_batch(batch: DataFrame, batch_id: int) -> None:
        ingest_files(batch, sink, today, user_id, batch_id, max_bytes)

    return files.writeStream.foreachBatch(ingest_batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


_TREND = "day string, units bigint"


def stream_sales_trend(sales: DataFrame, sink: str, checkpoint: str, fold_every: int = 100, **trigger) -> StreamingQuery:
    """Units per day over a stream of (product_name, quantity, sale_date), however late a sale comes.

    The sums are Spark's own aggregation state in update mode, keyed by the day of the event. There is no watermark to
    drop late sales, because the state cannot outgrow the calendar: it is one row per day that has sales. Each batch
    writes the new totals of the days it changed; :func:`sales_trend_of` takes each day's latest. Every ``fold_every``
    batches the latest totals are written as one folder and the folders before are removed, so there are never more
    than ``fold_every`` + 1 of them. A replayed batch writes the same totals again.
    """
    named = sales.filter(C.strip(F.coalesce("product_name", F.lit(""))) != "")
    units = F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("units")
    totals = named.groupBy(C.day_key(F.col("sale_date")).alias("day")).agg(units)

    def put(batch: DataFrame, batch_id: int) -> None:
        if not batch_id or batch_id % fold_every:
            return _write(batch, sink, "trend", batch_id)
        before = _batches(batch.sparkSession, sink, "trend")
        before = [b for b in before if b < batch_id]
        earlier = _latest(batch.sparkSession, sink, before)
        _write(earlier.join(batch, "day", "left_anti").unionByName(batch), sink, "trend", batch_id)
        for old in before:
            remove_folder(batch.sparkSession, f"{sink}/trend/batch_id={old}")

    return totals.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _batches(spark: SparkSession, sink: str, table: str) -> list[int]:
    """The numbers of the batches that have a folder; folded tables have few."""
    return sorted(int(name.split("=")[1]) for name in folder_names(spark, f"{sink}/{table}") if name.startswith("batch_id="))


def _latest(spark: SparkSession, sink: str, batches: list[int]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], _TREND)
    rows = spark.read.schema(f"{_TREND}, batch_id bigint").option("basePath", f"{sink}/trend").parquet(*(f"{sink}/trend/batch_id={b}" for b in batches))
    return rows.groupBy("day").agg(F.max_by("units", "batch_id").alias("units"))


def sales_trend_of(spark: SparkSession, sink: str) -> DataFrame:
    """Units per day as of the last batch of :func:`stream_sales_trend`."""
    return _latest(spark, sink, _batches(spark, sink, "trend"))


_SOLD_SCHEMA = "report_id string, id long, sold long"


def sold_folders(sink: str, first: int, end: int) -> list[str]:
    """Folders that hold the units sold up to, not including, batch ``end``, given the sums up to ``first``."""
    snapshot = [f"{sink}/sold_snapshot/batch_id={first}"] if first > 0 else []
    return snapshot + [f"{sink}/sold/batch_id={batch}" for batch in range(first, end)]


def _sold_between(spark: SparkSession, sink: str, first: int, end: int) -> DataFrame:
    folders = sold_folders(sink, first, end)
    if not folders:
        return spark.createDataFrame([], _SOLD_SCHEMA)
    return spark.read.schema(_SOLD_SCHEMA).parquet(*folders).groupBy("report_id", "id").agg(F.sum("sold").alias("sold"))


def checkout_batch(
    requests: DataFrame, inventory: DataFrame | Callable[[], DataFrame], sink: str, batch_id: int, snapshot_every: int = 100
) -> None:
    """Check out the carts of one micro-batch against the stock left by the batches before it.

    The stock is the inventory less the units sold so far. Each batch adds only what it sold; every ``snapshot_every``
    batches the sums are folded into a snapshot, so a batch opens a bounded number of folders, by name. Folders folded two
    snapshots ago are removed. An ``inventory`` that is a function is asked again for every batch.
    """
    spark = requests.sparkSession
    inventory = inventory if isinstance(inventory, DataFrame) else inventory()
    base = batch_id // snapshot_every * snapshot_every
    if batch_id == base and base > 0:
        _write(_sold_between(spark, sink, base - snapshot_every, base), sink, "sold_snapshot", base)
        done = base - 2 * snapshot_every
        for folder in sold_folders(sink, max(0, done - snapshot_every), max(0, done)):
            remove_folder(spark, folder)
    keys = requests.select("report_id", F.col("inventory_id").alias("id")).distinct()
    by = ["report_id", "id"]
    if "report_bucket" in inventory.columns:  # lets the batch prune the folders of the stored inventory
        keys, by = keys.withColumn("report_bucket", report_bucket(F.col("report_id"))), [*by, "report_bucket"]
    work = WorkTables(spark, "checkout-batch")
    stock = (
        inventory.join(keys, by, "left_semi")
        .join(_sold_between(spark, sink, base, batch_id), ["report_id", "id"], "left")
        .withColumn("quantity", (F.coalesce("quantity", F.lit(0)) - F.coalesce("sold", F.lit(0))).cast("int"))
        .drop("sold")
    )
    result = changes.checkout(requests, work.keep(stock, "stock"), work=work)
    sold = result["sold"].select("report_id", "id", F.col("sold").cast("bigint").alias("sold"))
    tables = {"verdicts": result["verdicts"], "orders": result["orders"], "order_items": result["order_items"], "activity_logs": result["activity"], "sold": sold}
    for table, rows in tables.items():
        _write(rows, sink, table, batch_id)
    _write(spark.createDataFrame([(batch_id,)], "upto bigint"), sink, "commits", batch_id)
    for old in range(max(0, batch_id - 4), batch_id - 2):
        remove_folder(spark, f"{sink}/commits/batch_id={old}")
    remove_folder(spark, work.root)


def committed(spark: SparkSession, sink: str, table: str) -> DataFrame:
    """A table of :func:`checkout_batch` as of the last batch whose tables are all written.

    The folders of a batch are written one after the other, its mark last; batches follow each other. So an order is
    never seen without its items, nor the other way round. Folders of unfinished batches are not opened.
    """
    last = spark.read.schema("upto bigint").parquet(f"{sink}/commits").agg(F.max("upto")).first()[0] if folder_exists(spark, f"{sink}/commits") else None
    rows = spark.read.option("basePath", f"{sink}/{table}").parquet(f"{sink}/{table}")
    return rows.filter(F.col("batch_id") <= F.lit(-1 if last is None else last))


CART_KEY = ["report_id", "user_id", "share_token"]


def closed_carts(events: DataFrame, sink: str, batch_id: int, snapshot_every: int = 100, keep: timedelta | None = None) -> DataFrame:
    """The lines of the carts that a micro-batch closes, however many batches they came in.

    An event is a cart line, or closes its cart (``closes``, with the cart's key and ``created_at``), or both. A closing
    takes the cart's lines up to its time that have come by its batch; others wait for the next closing. Several closings of
    a cart in one batch count as the last of them. With ``keep``, lines that are older than that, as of the newest event,
    are forgotten when a snapshot is taken.

    A batch adds its lines and closings as tables of its own, and reads those since the last snapshot. Every
    ``snapshot_every`` batches the lines that are still open make a snapshot; folders that went into the one before are
    removed. So a batch opens a bounded number of folders by name, and a replayed batch finds what it found before.
    """
    spark = events.sparkSession
    line = events.drop("closes").schema
    closing = "report_id string, user_id bigint, share_token string, close_at timestamp, close_batch bigint"
    base = batch_id // snapshot_every * snapshot_every

    def lines_of(first: int, end: int) -> DataFrame:
        parts = [f"{sink}/open_carts/batch_id={first}"] if first else []
        parts += [f"{sink}/cart_lines/batch_id={b}" for b in range(first, end)]
        schema = StructType([*line.fields, StructField("line_batch", LongType())])
        return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)

    def closings_of(first: int, end: int) -> DataFrame:
        parts = [f"{sink}/closings/batch_id={b}" for b in range(first, end)]
        return spark.read.schema(closing).parquet(*parts) if parts else spark.createDataFrame([], closing)

    def taken() -> Column:
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in CART_KEY]
        return reduce(Column.__and__, [*same, F.col("l.created_at") <= F.col("c.close_at"), F.col("l.line_batch") <= F.col("c.close_batch")])

    def still_open(first: int, end: int) -> DataFrame:
        closings = closings_of(first, end).alias("c")
        return lines_of(first, end).alias("l").join(closings, taken(), "left_anti")

    if batch_id == base and base > 0:
        rows = still_open(base - snapshot_every, base)
        if keep is not None:
            newest = lines_of(base - snapshot_every, base).agg(F.max("created_at")).first()[0]
            rows = rows.filter(F.col("created_at") >= F.lit(newest) - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {keep.total_seconds()})"))
        _write(rows, sink, "open_carts", base)
        done = base - 2 * snapshot_every
        for b in range(max(0, done), base - snapshot_every):
            for table in ("cart_lines", "closings"):
                remove_folder(spark, f"{sink}/{table}/batch_id={b}")
        if done > 0:
            remove_folder(spark, f"{sink}/open_carts/batch_id={done}")
    of_batch = F.lit(batch_id).cast("bigint")
    marks = events.filter("closes").groupBy(*CART_KEY).agg(F.max("created_at").alias("close_at")).withColumn("close_batch", of_batch)
    _write(marks, sink, "closings", batch_id)
    _write(events.filter(F.col("inventory_id").isNotNull()).drop("closes").withColumn("line_batch", of_batch), sink, "cart_lines", batch_id)
    closings, earlier = closings_of(batch_id, batch_id + 1).alias("c"), closings_of(base, batch_id).alias("c")
    ready = lines_of(base, batch_id + 1).alias("l").join(closings, taken(), "left_semi")
    return ready.alias("l").join(earlier, taken(), "left_anti").drop("line_batch")


def stream_checkout(
    requests: DataFrame, inventory: DataFrame | Callable[[], DataFrame], sink: str, checkpoint: str, snapshot_every: int = 100,
    keep: timedelta | None = None, **trigger,
) -> StreamingQuery:
    """Check out a stream of cart lines.

    With a column ``closes``, carts may span micro-batches: :func:`closed_carts` keeps their lines until they are closed.
    Without it, all lines of a cart must come in one micro-batch.

    Neither stock nor open lines are keyed state: a state of the report would run a busy report in one task, and one of
    the cart costs a call of Python for every cart. The batch operators spread both, so the stream keeps them in tables.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if "closes" in batch.columns:
            batch = closed_carts(batch, sink, batch_id, snapshot_every, keep)
        checkout_batch(batch, inventory, sink, batch_id, snapshot_every)

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


_VIEWS = "user_id bigint, item int, viewed_at timestamp"


def stream_recently_viewed(views: DataFrame, sink: str, checkpoint: str, k: int = 5, fold_every: int = 100, **trigger) -> StreamingQuery:
    """The last ``k`` distinct items of each user, over a stream of (user_id, item, viewed_at) in any order.

    The last k of all views are among the last k of each part of them. So a batch writes the last k views of its own users,
    and :func:`recently_viewed_of` ranks what the batches left. Every ``fold_every`` batches what is left is ranked into
    one folder, and the folders before are removed: k rows a user are kept, however much is viewed.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, _ranked(batch, k)
        before = [b for b in _batches(spark, sink, "views") if b < batch_id]
        if batch_id and batch_id % fold_every == 0:
            rows = _ranked(_views(spark, sink, before).unionByName(rows), k)
        _write(rows, sink, "views", batch_id)
        for old in before if batch_id % fold_every == 0 else ():
            remove_folder(spark, f"{sink}/views/batch_id={old}")

    return views.select("user_id", "item", "viewed_at").writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _ranked(views: DataFrame, k: int) -> DataFrame:
    return topk.recently_viewed(views, k).drop("position")


def _views(spark: SparkSession, sink: str, batches: list[int]) -> DataFrame:
    folders = [f"{sink}/views/batch_id={b}" for b in batches]
    return spark.read.schema(_VIEWS).parquet(*folders) if folders else spark.createDataFrame([], _VIEWS)


def recently_viewed_of(spark: SparkSession, sink: str, k: int = 5, since: datetime | None = None) -> DataFrame:
    """user_id, item, viewed_at and position as of the last batch of :func:`stream_recently_viewed`; with ``since``, of
    views from that time on (items that were viewed before it are forgotten)."""
    rows = _views(spark, sink, _batches(spark, sink, "views"))
    return topk.recently_viewed(rows if since is None else rows.filter(F.col("viewed_at") >= F.lit(since)), k)
