"""From workbook cells to inventory rows.

Cells are a long table (path, row_idx, col_idx, value), so one plan handles any number of files at once. The steps that
look at headers work on the few header rows per file; the only wide shuffle is the pivot of cells into rows, keyed by
(path, row) and therefore even, whatever the size of a single file.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from stocklens.functions import columns as C
from stocklens.schemas import (
    DEFAULT_REORDER_LEVEL,
    HEADER_ALIASES,
    HEADER_KEYWORDS,
    HEADER_SEARCH_ROWS,
    MAPPING_FIELDS,
    MONEY,
    REQUIRED_FIELDS,
    TEXTS,
)

NO_CATEGORY_WARNING = TEXTS["no_category"]


def _plain(text: str) -> str:
    """Normalized form of an alias (aliases hold letters, blanks, hyphens and underscores only)."""
    return text.replace(" ", "_").replace("-", "_")


def alias_priorities() -> dict[str, dict[str, int]]:
    """Per field: normalized alias to its rank, the first spelling deciding."""
    ranks: dict[str, dict[str, int]] = {}
    for field, aliases in HEADER_ALIASES.items():
        for rank, alias in enumerate(aliases):
            ranks.setdefault(field, {}).setdefault(_plain(alias), rank)
    return ranks


def _alias_lookup() -> Column:
    """The fixed alias list as a constant map: normalized alias to (field, priority)."""
    entries = []
    for field, found in alias_priorities().items():
        for alias, rank in found.items():
            entries += [F.lit(alias), F.struct(F.lit(field).alias("field"), F.lit(rank).alias("priority"))]
    return F.create_map(*entries)


def _header_points(value: Column) -> Column:
    """Three points for an alias, one for every keyword in the text."""
    aliases = sorted({alias for found in alias_priorities().values() for alias in found})
    text = F.lower(C.strip(value))
    points = F.when(C.normalize_header(value).isin(aliases), 3).otherwise(0)
    for keyword in HEADER_KEYWORDS:
        points = points + text.contains(keyword).cast("int")
    return points


def _filled(value: Column) -> Column:
    return (C.strip(value) != "") & (F.lower(value) != "nan")


def detect_header_row(cells: DataFrame, depth: int | None = HEADER_SEARCH_ROWS) -> DataFrame:
    """Header row per file, and whether one was found.

    The best scoring of the first ``depth`` rows with two or more filled cells; if none of them scores, the best of all
    later rows. ``None`` ranks all rows alike. A file without any such row takes row 0 and ``header_found`` is false.
    One pass: rows and then files are aggregated.
    """
    filled = _filled(F.col("value"))
    rows = (
        cells.filter(F.col("row_idx").isNotNull())
        .groupBy("path", "row_idx")
        .agg(F.count_if(filled).alias("filled"), F.sum(F.when(filled, _header_points(F.col("value")))).alias("score"))
    )
    usable = (F.col("filled") >= 2) & (F.col("score") > 0)
    late = F.lit(False) if depth is None else F.col("row_idx") >= depth
    order = F.struct(late.alias("late"), (-F.col("score")).alias("s"), "row_idx")
    best = F.min_by("row_idx", F.when(usable, order))
    return rows.groupBy("path").agg(best.alias("best")).select(
        "path", F.coalesce("best", F.lit(0)).alias("header_row"), F.col("best").isNotNull().alias("header_found")
    )


def headers(cells: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Named columns that hold data: (path, col_idx, header, normalized). Blank and 'unnamed' headers are dropped."""
    value, below = F.col("value"), F.col("row_idx") > F.col("header_row")
    return (
        cells.join(header_rows.select("path", "header_row"), "path")
        .groupBy("path", "col_idx")
        .agg(
            F.max(F.when(F.col("row_idx") == F.col("header_row"), C.strip(value))).alias("header"),
            F.bool_or(below & (C.strip(value) != "")).alias("has_data"),
        )
        .filter(F.col("has_data") & (F.col("header") != "") & ~F.lower("header").startswith("unnamed"))
        .select("path", "col_idx", "header", C.normalize_header(F.col("header")).alias("normalized"))
    )


def header_context(named: DataFrame) -> DataFrame:
    """Normalized header to its first column per file: (path, normalized, col_idx, header)."""
    return (
        named.filter(F.col("normalized") != "")
        .groupBy("path", "normalized")
        .agg(F.min(F.struct("col_idx", "header")).alias("first"))
        .select("path", "normalized", "first.col_idx", "first.header")
    )


def auto_map_columns(context: DataFrame) -> DataFrame:
    """Column of each known field: (path, field, col_idx, header); the earliest alias in the list wins."""
    return (
        context.withColumn("alias", F.try_element_at(_alias_lookup(), F.col("normalized")))
        .filter(F.col("alias").isNotNull())
        .groupBy("path", "alias.field")
        .agg(F.min_by(F.struct("col_idx", "header"), "alias.priority").alias("best"))
        .select("path", "field", "best.col_idx", "best.header")
    )


def mapping_status(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per file: status, missing required fields and the category warning.

    A file that cannot be mapped has status ``header_not_found`` if ``files`` says so, else ``mapping_required``.
    """
    fields = mapping.groupBy("path").agg(F.collect_set("field").alias("fields"))
    have = F.coalesce("fields", F.array().cast("array<string>"))
    required = F.array(*[F.lit(field) for field in REQUIRED_FIELDS])
    missing = F.array_except(required, have)
    found = F.col("header_found") if "header_found" in files.columns else F.lit(True)
    return (
        files.select("path", found.alias("header_found"))
        .distinct()
        .join(fields, "path", "left")
        .select(
            "path",
            F.when(F.size(missing) == 0, "success")
            .when(~F.col("header_found"), "header_not_found")
            .otherwise("mapping_required")
            .alias("status"),
            missing.alias("missing_fields"),
            F.when(~F.array_contains(have, "category"), NO_CATEGORY_WARNING).alias("warning"),
        )
    )


def apply_manual_mapping(mapping: DataFrame, named: DataFrame, overrides: DataFrame) -> DataFrame:
    """Mapping after explicit choices (path, field, header): a file with choices takes its mapping from them alone.

    Only the known fields count. A file whose choices leave out a required field keeps status ``mapping_required``
    through :func:`mapping_status`.
    """
    asked = overrides.filter(F.col("field").isin(MAPPING_FIELDS) & (F.col("header") != ""))
    first = named.groupBy("path", "header").agg(F.min("col_idx").alias("col_idx"))
    chosen = asked.join(first, ["path", "header"]).select("path", "field", "col_idx", "header")
    return mapping.join(asked.select("path").distinct(), "path", "left_anti").unionByName(chosen)


def cells_to_records(cells: DataFrame, header_rows: DataFrame, mapping: DataFrame, named: DataFrame) -> DataFrame:
    """Rows below the header with the mapped fields as text columns; rows without any named value are dropped.

    What is known of columns is joined first, a few rows per file; the cells, by far the largest table, are joined once.
    """
    fields = mapping.select("path", "col_idx", "field")
    columns = (
        named.select("path", "col_idx")
        .distinct()
        .join(fields, ["path", "col_idx"], "left")
        .join(header_rows.select("path", "header_row"), "path")
    )
    body = cells.join(columns, ["path", "col_idx"]).filter(
        (F.col("row_idx") > F.col("header_row")) & (C.strip(F.col("value")) != "")
    )
    return body.groupBy("path", "row_idx").agg(
        *[F.max(F.when(F.col("field") == field, F.col("value"))).alias(field) for field in MAPPING_FIELDS]
    )


def type_rows(records: DataFrame, today: str) -> DataFrame:
    """Typed rows with ``is_valid``; invalid ones keep their raw text and a reason instead of disappearing."""
    name = C.strip(F.coalesce("product_name", F.lit("")))
    price, quantity = C.to_price(F.col("price")), C.truncated_count(F.col("quantity"))
    reason = (
        F.when(price.isNull(), "price is not a number")
        .when(quantity.isNull() & C.to_number(F.col("quantity")).isNotNull(), "quantity is out of range")
        .when(quantity.isNull(), "quantity is not a number")
        .when(name == "", "product name is blank")
    )
    raw_date = F.coalesce(C.blank_to_null(F.substring("date", 1, 10)), F.lit(today))
    return records.select(
        "path",
        "row_idx",
        name.alias("product_name"),
        C.clean_category(F.col("category")).alias("category"),
        price.alias("price"),
        quantity.alias("quantity"),
        F.lit(DEFAULT_REORDER_LEVEL).alias("reorder_level"),
        raw_date.alias("raw_date"),
        F.when(raw_date.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw_date.try_cast("date")).alias("entry_date"),
        F.col("price").alias("raw_price"),
        F.col("quantity").alias("raw_quantity"),
        reason.alias("reason"),
        reason.isNull().alias("is_valid"),
    )


def split_rows(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rows."""
    return typed.filter("is_valid").drop("reason", "is_valid"), typed.filter("NOT is_valid").drop("is_valid")


def normalize_rows(rows: DataFrame, today: str) -> DataFrame:
    """Manual or uploaded rows made ready to store: defaults, trimmed texts, clean category."""
    return (
        rows.withColumn("product_name", C.strip(F.coalesce("product_name", F.lit(""))))
        .filter(F.col("product_name") != "")
        .withColumns(
            {
                "category": C.clean_category(F.col("category"), fallback=True),
                "price": F.coalesce("price", F.lit(0).cast(MONEY)),
                "quantity": F.coalesce("quantity", F.lit(0)),
                "reorder_level": C.default_if_falsy(F.col("reorder_level"), DEFAULT_REORDER_LEVEL),
                "supplier_name": C.blank_to_null(F.col("supplier_name")),
                "branch_name": C.blank_to_null(F.col("branch_name")),
                "image_url": C.blank_to_null(F.col("image_url")),
                "entry_date": F.coalesce("entry_date", F.lit(today).cast("date")),
            }
        )
    )


def ingest_report(
    header_rows: DataFrame, named: DataFrame, mapping: DataFrame, typed: DataFrame, status: DataFrame
) -> DataFrame:
    """One row per file: counts, header row, headers in column order and the mapped columns.

    A file has at most a few hundred columns, so the header arrays are small; its rows are only counted.
    """
    counts = typed.groupBy("path").agg(
        F.count("*").alias("rows_processed"), F.count_if("is_valid").alias("valid_rows")
    )
    columns = named.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", "header", "normalized"))).alias("columns")
    )
    mapped = mapping.groupBy("path").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "header")))).alias("mapped_columns")
    )
    zero = F.lit(0)
    return (
        header_rows.join(counts, "path", "left")
        .join(columns, "path", "left")
        .join(mapped, "path", "left")
        .join(status, "path", "left")
        .select(
            "path",
            "status",
            "missing_fields",
            "warning",
            (F.col("header_row") + 1).alias("detected_header_row"),
            "header_found",
            F.coalesce("rows_processed", zero).alias("rows_processed"),
            F.coalesce("valid_rows", zero).alias("valid_rows"),
            F.greatest(F.coalesce(F.col("rows_processed") - F.col("valid_rows"), zero), zero).alias("failed_rows"),
            F.col("columns.header").alias("raw_headers"),
            F.col("columns.normalized").alias("normalized_headers"),
            "mapped_columns",
        )
    )


def preview_rows(typed: DataFrame, n: int = 8) -> DataFrame:
    """First valid rows per file. The rank limit also runs before the shuffle, so a large file sends n rows per task."""
    order = Window.partitionBy("path").orderBy("row_idx")
    return typed.filter("is_valid").withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def register_reports(files: DataFrame, user_id: int | None = None) -> DataFrame:
    """Report rows for files given as (path, modificationTime).

    Ids are digests of path and time, in the usual 32 and 16 digit form: a task that runs again after a lost executor,
    or a batch that is replayed, gives the same report.
    """
    source = F.concat_ws("|", "path", F.col("modificationTime").cast("string"))
    return files.select(
        "path",
        F.md5(source).alias("report_id"),
        F.concat(C.file_stem(F.col("path")), F.lit(" catalog")).alias("title"),
        F.lit(user_id).cast("bigint").alias("created_by_admin"),
        F.substring(F.sha2(source, 256), 1, 16).alias("token"),
        C.file_name(F.col("path")).alias("source_file_name"),
        F.lit("active").alias("status"),
        F.col("modificationTime").alias("created_at"),
    )


def inventory_of(typed: DataFrame, reports: DataFrame, user_id: int | None = None) -> DataFrame:
    """Valid rows of registered files in the inventory layout, categories filled in.

    The id is a digest of report and row, so it depends on nothing but the file; it is a key together with ``report_id``,
    which :func:`repeated_ids` checks.
    """
    tagged = typed.filter("is_valid").join(reports.select("path", "report_id", "created_at"), "path")
    return tagged.select(
        C.key_id(F.col("report_id"), F.col("row_idx")).alias("id"),
        "report_id",
        F.lit(user_id).cast("bigint").alias("user_id"),
        "product_name",
        C.clean_category(F.col("category"), fallback=True).alias("category"),
        "price",
        "quantity",
        "reorder_level",
        F.lit(None).cast("string").alias("supplier_name"),
        F.lit(None).cast("string").alias("branch_name"),
        F.lit(None).cast("string").alias("image_url"),
        "entry_date",
        "created_at",
    )


def repeated_ids(inventory: DataFrame) -> DataFrame:
    """(report_id, id) that two rows share; empty unless two digests of one report collide."""
    return inventory.groupBy("report_id", "id").count().filter(F.col("count") > 1)


def merge_product_master(products: DataFrame, rows: DataFrame) -> DataFrame:
    """Product master after an upload: one row per (name, category), the newest details winning.

    ``rows`` carry ``name``, ``category``, the detail columns and a sortable ``loaded_at``. Products seen before keep
    their id; that of a new one is a digest of name and category. Union and one aggregate: a product uploaded very often
    is combined on the map side.
    """
    details = [name for name in products.columns if name not in ("product_id", "name", "category", "created_at")]
    stored = products.withColumn("loaded_at", F.lit(None).cast(rows.schema["loaded_at"].dataType))
    fresh = rows.withColumn("category", C.clean_category(F.col("category"), fallback=True))
    both = stored.unionByName(fresh, allowMissingColumns=True)
    newest = F.struct("loaded_at", "product_id", F.struct(*details))
    keep = [F.coalesce(F.max("product_id"), C.key_id(F.col("name"), F.col("category"))).alias("product_id")]
    if "created_at" in products.columns:
        keep.append(F.min("created_at").alias("created_at"))
    return (
        both.groupBy("name", "category")
        .agg(*keep, F.max_by(F.struct(*details), newest).alias("d"))
        .withColumns({name: F.col(f"d.{name}") for name in details})
        .select(*products.columns)
    )


def import_products_strict(rows: DataFrame) -> DataFrame:
    """Rows of the product template as typed columns with ``is_inserted``.

    Column names are matched without regard to case or outer blanks. Blank names or categories, negative or unreadable
    numbers are skipped; decimals in ``quantity`` are cut.
    """
    by_name = {name.strip().lower(): name for name in rows.columns}
    absent = {"name", "category", "price", "quantity"} - set(by_name)
    if absent:
        raise ValueError(TEXTS["template_columns"])
    text = {key: F.col(f"`{by_name[key]}`").cast("string") for key in ("name", "category", "price", "quantity")}
    typed = rows.select(
        C.strip(text["name"]).alias("name"),
        C.strip(text["category"]).alias("category"),
        C.to_price(text["price"]).alias("price"),
        C.truncated_count(text["quantity"]).alias("quantity"),
    )
    good = (F.col("name") != "") & (F.col("category") != "") & (F.col("price") >= 0) & (F.col("quantity") >= 0)
    return typed.withColumn("is_inserted", F.coalesce(good, F.lit(False)))


def import_counts(imported: DataFrame) -> DataFrame:
    return imported.agg(
        F.count_if("is_inserted").alias("inserted"), F.count_if(~F.col("is_inserted")).alias("skipped")
    )
