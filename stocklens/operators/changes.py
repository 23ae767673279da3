"""Batch table updates: each takes a table and a set of changes and returns the new table.

Nothing is changed in place; the caller writes the result. Competing changes to one row are reduced by aggregates
(``max_by``), so a row with very many changes is combined on the map side.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stocklens.functions import columns as C
from stocklens.operators.allocation import allocate, number_claims
from stocklens.operators.joins import known_categories, resolve_catalog_report
from stocklens.operators.scope import valid_catalogs
from stocklens.schemas import DEFAULT_REORDER_LEVEL, RESETTABLE_TABLES, TABLES, TEXTS, UNCATEGORIZED
from stocklens.session import WorkTables


def _last(changes: DataFrame, key: str, order: list[str], fields: list[str], counts: Column) -> DataFrame:
    """The last change per key among those that count, as a struct column ``change``.

    The condition sits in the aggregate: as a filter it would be pushed below the parsing and repeat it.
    """
    return changes.groupBy(key).agg(
        F.max_by(F.struct(*fields), F.when(counts, F.struct(*order))).alias("change")
    )


def check_inventory_edits(edits: DataFrame, today: str) -> DataFrame:
    """Edits as typed values with a ``problem`` when the form would have refused them."""
    reorder = C.default_if_falsy(F.col("reorder_level"), str(DEFAULT_REORDER_LEVEL), is_text=True)
    day = F.coalesce(C.blank_to_null(F.col("entry_date")), F.lit(today))
    return edits.select(
        "id",
        "edited_at",
        "edit_id",
        C.strip(F.coalesce("product_name", F.lit(""))).alias("product_name"),
        C.clean_category(F.col("category"), fallback=True).alias("category"),
        C.to_price(F.col("price")).alias("price"),
        C.to_count(F.col("quantity")).alias("quantity"),
        C.to_count(reorder).alias("reorder_level"),
        C.blank_to_null(F.col("supplier_name")).alias("supplier_name"),
        C.blank_to_null(F.col("branch_name")).alias("branch_name"),
        C.blank_to_null(F.col("image_url")).alias("image_url"),
        F.substring(day, 1, 10).try_cast("date").alias("entry_date"),
        F.coalesce(
            C.price_problem(F.col("price")),
            C.count_problem(F.col("quantity")),
            C.count_problem(reorder, "Reorder level"),
        ).alias("problem"),
    )


EDITED_FIELDS = [
    "product_name", "category", "price", "quantity", "reorder_level", "supplier_name", "branch_name", "image_url",
    "entry_date",
]


def apply_inventory_edits(inventory: DataFrame, edits: DataFrame, today: str) -> DataFrame:
    """Full-row updates by id; the last accepted edit of a row wins, refused edits change nothing."""
    checked = check_inventory_edits(edits, today)
    last = _last(checked, "id", ["edited_at", "edit_id"], EDITED_FIELDS, F.col("problem").isNull())
    edited = F.col("change").isNotNull()
    updated = {
        field: F.when(edited, F.col(f"change.{field}")).otherwise(F.col(field)) for field in EDITED_FIELDS
    }
    return inventory.join(last, "id", "left").withColumns(updated).select(*inventory.columns)


def apply_deletes(table: DataFrame, ids: DataFrame, key: str, owner: str | None = None) -> DataFrame:
    """Rows of ``table`` left after deleting the given keys; with ``owner``, only rows of the same owner."""
    keys = [key] if owner is None else [key, owner]
    return table.join(ids.select(*keys), keys, "left_anti")


def clear_carts(cart: DataFrame, users: DataFrame) -> DataFrame:
    return apply_deletes(cart, users, "user_id")


def cart_sources(catalogs: DataFrame, adds: DataFrame, reports: DataFrame, inventory: DataFrame, as_of: str) -> DataFrame:
    """``share_token`` and ``report_id`` of the valid catalogs that cart additions name; other catalogs are not resolved."""
    asked = adds.select(F.col("share_token").alias("token")).distinct()
    valid = valid_catalogs(catalogs, as_of).join(asked, "token", "left_semi").select(*catalogs.columns)
    resolved = resolve_catalog_report(valid, reports, inventory, few=True)
    return resolved.select(F.col("token").alias("share_token"), F.col("resolved_report_id").alias("report_id"))


def merge_cart(cart: DataFrame, adds: DataFrame, inventory: DataFrame, catalogs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cart additions in order of request: returns the new cart and a verdict per request.

    ``catalogs``: ``share_token`` and ``report_id`` of the valid catalogs. ``adds``: ``request_id``, ``requested_at``,
    ``user_id``, ``share_token``, ``inventory_id``, ``quantity``. A cart holds one catalog: that of its present lines,
    else that of the first addition that passes on its own. The id of a new line is a digest of user, item, catalog and
    the time of the first request. The requests with what is known of each are written once, as the allocation and both
    results read them; only those that pass on their own are joined with carts and carry the details of their product.
    """
    work = WorkTables(adds.sparkSession, "cart")
    stock = inventory.select(
        F.col("id").alias("inventory_id"),
        "report_id",
        "product_name",
        C.clean_category(F.col("category"), fallback=True).alias("category"),
        F.col("price").alias("unit_price"),
        F.coalesce("quantity", F.lit(0)).alias("available"),
    )
    held = cart.groupBy("user_id").agg(
        F.min(F.struct("share_token", "report_id")).alias("held_from"),
        F.max(F.struct("share_token", "report_id")).alias("held_to"),
    )
    on_line = cart.groupBy("user_id", "inventory_id", "share_token").agg(F.sum("quantity").alias("already"))
    own = (
        F.when(F.col("report_id").isNull(), "invalid catalog")
        .when(F.col("quantity") <= 0, "quantity too small")
        .when(F.col("product_name").isNull(), "not in catalog")
        .when(~C.is_real_name(F.col("product_name")), "not available")
        .when(F.col("quantity") > F.col("available"), "over stock")
    )
    checked = (
        adds.join(catalogs.select("share_token", "report_id").distinct(), "share_token", "left")
        .join(stock, ["inventory_id", "report_id"], "left")
        .withColumn("problem", own)
        .withColumns({name: F.when(F.col("problem").isNull(), F.col(name)) for name in ("product_name", "category", "unit_price")})
    )
    checked = work.keep(checked, "checked")
    passing = checked.filter(F.col("problem").isNull()).withColumn("source", F.struct("share_token", "report_id"))
    first = (
        passing.groupBy("user_id")
        .agg(F.min_by("source", F.struct("requested_at", "request_id")).alias("first_source"))
    )
    other = F.when(
        F.col("held_from").isNotNull(), (F.col("held_from") != F.col("source")) | (F.col("held_to") != F.col("source"))
    ).otherwise(F.col("first_source") != F.col("source"))
    # What is known of a user is one row, joined last: a join on the finer key after it would keep its partitioning, and
    # a user with very many requests would stay in one task.
    of_user = held.join(first, "user_id", "full_outer")
    judged = (
        passing.join(on_line, ["user_id", "inventory_id", "share_token"], "left")
        .join(of_user, "user_id", "left")
        .withColumn("problem", F.when(other, "other catalog"))
        .withColumn("item", F.struct("user_id", "inventory_id"))
        .withColumn("claim", F.col("request_id"))
        .drop("source", "first_source", "held_from", "held_to")
    )
    judged = work.keep(judged, "judged")
    contenders = judged.filter(F.col("problem").isNull())
    verdicts = allocate(
        contenders.select("claim", F.col("requested_at").alias("arrival"), "item", F.col("quantity").alias("units")),
        contenders.groupBy("item").agg(
            F.max(F.col("available") - F.coalesce("already", F.lit(0))).alias("units")
        ),
    )
    requests = judged.join(verdicts, "claim", "left").withColumn(
        "verdict", F.coalesce("problem", F.when(F.col("accepted"), "added").otherwise("over stock"))
    )
    added = (
        requests.filter(F.col("verdict") == "added")
        .groupBy("user_id", "inventory_id", "share_token", "report_id", "product_name", "category", "unit_price")
        .agg(F.sum("quantity").cast("int").alias("added"), F.min("requested_at").alias("added_at"))
        .withColumn("cart_item_id", C.key_id(F.col("user_id"), F.col("inventory_id"), F.col("share_token"), F.col("added_at")))
    )
    line = ["user_id", "inventory_id", "share_token"]
    grown = (
        cart.join(added.select(*line, "added"), line, "left")
        .withColumn("quantity", F.col("quantity") + F.coalesce("added", F.lit(0)))
        .select(*cart.columns)
    )
    fresh = added.join(cart.select(*line), line, "left_anti")
    new_lines = fresh.select(
        *[
            F.col("cart_item_id").cast(cart.schema[name].dataType) if name == "cart_item_id"
            else F.col("added").alias("quantity") if name == "quantity"
            else F.col("added_at").alias("created_at") if name == "created_at"
            else F.col(name) if name in fresh.columns
            else F.lit(None).cast(cart.schema[name].dataType).alias(name)
            for name in cart.columns
        ]
    )
    fields = ["request_id", "user_id", "inventory_id", "quantity"]
    refused = checked.filter(F.col("problem").isNotNull()).select(*fields, F.col("problem").alias("verdict"))
    return grown.unionByName(new_lines), refused.unionByName(requests.select(*fields, "verdict"))


def update_cart_quantity(cart: DataFrame, changes: DataFrame, inventory: DataFrame) -> DataFrame:
    """New quantities per cart line. Zero deletes the line for good; refused values leave it as it is.

    ``changes``: ``cart_item_id``, ``user_id``, ``changed_at``, ``change_id``, ``quantity`` (form text).
    """
    stock = inventory.select(
        F.col("id").alias("inventory_id"), "report_id", F.coalesce("quantity", F.lit(0)).alias("available")
    )
    # the stock is joined to the lines, not to their changes, which then meet line, outcome and cart by one key
    lines = (
        cart.select("cart_item_id", "user_id", "inventory_id", "report_id")
        .join(stock, ["inventory_id", "report_id"], "left")
        .select("cart_item_id", "user_id", "available")
    )
    wanted = changes.withColumn("wanted", C.to_count(F.col("quantity"))).filter(F.col("wanted").isNotNull()).drop("quantity").join(lines, ["cart_item_id", "user_id"])
    fits = F.col("wanted") <= F.coalesce("available", F.lit(0))
    outcome = wanted.groupBy("cart_item_id", "user_id").agg(
        F.bool_or(F.col("wanted") == 0).alias("removed"),
        F.max_by("wanted", F.when(fits, F.struct("changed_at", "change_id"))).alias("wanted"),
    )
    return (
        cart.join(outcome, ["cart_item_id", "user_id"], "left")
        .filter(~F.coalesce("removed", F.lit(False)))
        .withColumn("quantity", F.coalesce("wanted", "quantity"))
        .select(*cart.columns)
    )


def checkout(
    cart: DataFrame, inventory: DataFrame, users: DataFrame | None = None, work: WorkTables | None = None
) -> dict[str, DataFrame]:
    """Check out every cart, in order of its last change within its report.

    A cart goes through when each of its lines still has enough stock after the carts before it. Returns ``verdicts``,
    ``orders`` and ``order_items`` in the layout of their tables, ``activity``, units ``sold``, the reduced ``inventory``
    and the ``cart`` lines that stay. The order total uses inventory prices, the line totals use cart prices. Order ids
    are digests of the cart and its last change, item ids of the order and the line, so a repeated run gives the same
    ids. User names come from ``users`` and are null without it. The lines and the carts are written once below ``work``,
    as the allocation and all results read them; a caller may remove its ``work`` when it has written the results.
    """
    work = work or WorkTables(cart.sparkSession, "checkout")
    key = ["report_id", "user_id", "share_token"]
    ref = F.md5(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
    of_cart = F.struct(*key).alias("of_cart")
    lines = work.keep(cart, "lines")
    carts = lines.groupBy(*key).agg(F.max("created_at").alias("checkout_at")).withColumn("order_ref", ref)
    carts = number_claims(carts, ["checkout_at", "order_ref"], work, "carts").withColumn("order_ref", ref).select("*", of_cart)
    order_id = C.key_id(F.col("order_ref"), F.col("checkout_at"))
    stock = inventory.select(
        F.col("id").alias("inventory_id"),
        "report_id",
        F.coalesce("quantity", F.lit(0)).alias("available"),
        F.col("price").alias("current_price"),
        F.lit(True).alias("found"),
    )
    item = F.struct("report_id", "inventory_id")
    asked = (
        lines.select(of_cart, "inventory_id", "quantity")
        .join(carts.select("of_cart", "claim_no"), "of_cart")
        .groupBy(F.col("claim_no").alias("claim"), F.struct("of_cart.report_id", "inventory_id").alias("item"))
        .agg(F.sum(F.coalesce("quantity", F.lit(0))).alias("units"))
    )
    verdicts_of = allocate(asked, stock.select(item.alias("item"), F.col("available").alias("units")), work=work, numbered=True)
    decided = carts.join(verdicts_of.withColumnRenamed("claim", "claim_no"), "claim_no")
    priced = lines.join(stock, ["report_id", "inventory_id"], "left")
    totals = priced.groupBy(*key).agg(
        F.max("created_at").alias("created_at"),
        F.sum(C.line_total(F.col("current_price"), F.col("quantity"))).alias("total_amount"),
        F.bool_or(F.col("found").isNull()).alias("has_missing"),
    ).select("*", of_cart)
    verdict = F.when(F.col("accepted"), "confirmed").when(F.col("has_missing"), "missing").otherwise("over stock")
    verdicts = totals.join(decided.select("of_cart", "order_ref", "accepted"), "of_cart").withColumn("verdict", verdict)
    accepted = decided.filter("accepted")
    of_lines = lines.select("*", of_cart)
    sold_lines = of_lines.join(accepted.select("of_cart", order_id.alias("order_id")), "of_cart")
    named = verdicts.filter("accepted").withColumn("checkout_at", F.col("created_at")).withColumn("order_id", order_id)
    if users is None:
        named = named.withColumn("username", F.lit(None).cast("string"))
    else:
        named = named.join(users.select("user_id", "username"), "user_id", "left")
    sold = sold_lines.groupBy("report_id", F.col("inventory_id").alias("id")).agg(F.sum("quantity").alias("sold"))
    return {
        "verdicts": verdicts.select("order_ref", *key, "created_at", "total_amount", "verdict"),
        "orders": _as_table("orders", named.withColumn("status", F.lit("Confirmed"))),
        "order_items": _as_table(
            "order_items",
            sold_lines.withColumns(
                {
                    "order_item_id": C.key_id(F.col("order_id"), F.col("cart_item_id")),
                    "line_total": C.line_total(F.col("unit_price"), F.col("quantity")),
                }
            ),
        ),
        "activity": activity_rows(
            named.select(F.col("username").alias("actor_username"), F.col("order_id").cast("string").alias("detail"), "created_at"), TEXTS["checkout_log"]
        ),
        "sold": sold,
        "inventory": inventory.join(sold, ["report_id", "id"], "left")
        .withColumn("quantity", (F.col("quantity") - F.coalesce("sold", F.lit(0))).cast("int"))
        .select(*inventory.columns),
        "cart": of_lines.join(accepted, "of_cart", "left_anti").select(*cart.columns),
    }


def _as_table(name: str, rows: DataFrame) -> DataFrame:
    """Rows in the layout of a stored table."""
    return rows.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in TABLES[name].fields])


def apply_order_status(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Last allowed status per order. ``changes``: ``order_id``, ``changed_at``, ``change_id``, ``status``."""
    titled = changes.withColumn("status", C.title_status(F.col("status")))
    last = _last(titled, "order_id", ["changed_at", "change_id"], ["status"], F.col("status").isNotNull())
    return (
        orders.join(last, "order_id", "left")
        .withColumn("status", F.coalesce("change.status", "status"))
        .select(*orders.columns)
    )


def clean_invalid_categories(inventory: DataFrame) -> DataFrame:
    """Drop rows that have no usable category and also a blank or demo name."""
    category = F.trim(F.coalesce("category", F.lit("")))
    unusable = F.lower(category).isin("", UNCATEGORIZED.lower())
    return inventory.filter(~(unusable & ~C.is_real_name(F.col("product_name"))))


def apply_category_repairs(inventory: DataFrame, products: DataFrame) -> DataFrame:
    """Inventory with suggested categories written back; ``is_repaired`` marks the changed rows.

    Only uncategorized rows enter the join; the rest of the table is not shuffled.
    """
    uncategorized = F.lower(F.coalesce("category", F.lit(""))) == UNCATEGORIZED.lower()
    rest = inventory.filter(~uncategorized).withColumn("is_repaired", F.lit(False))
    repaired = (
        inventory.filter(uncategorized)
        .withColumn("name_key", F.lower("product_name"))
        .join(known_categories(products), "name_key", "left")
        .withColumn("is_repaired", F.col("found").isNotNull())
        .withColumn("category", F.when(F.col("is_repaired"), C.clean_category(F.col("found"))).otherwise(F.col("category")))
        .select(*inventory.columns, "is_repaired")
    )
    return rest.unionByName(repaired)


def normalize_stored_tokens(table: DataFrame) -> DataFrame:
    """Stored tokens in bare form; a token that would become empty stays as it is."""
    return table.withColumn("token", F.coalesce(C.normalize_token(F.col("token")), F.col("token")))


def upsert_shared_catalogs(catalogs: DataFrame, reports: DataFrame) -> DataFrame:
    """Share reports under their token: a known token is refreshed, a new one becomes a catalog.

    The id of a new catalog is a digest of its token.
    """
    newest = F.max_by(F.struct("title", "report_id"), F.struct("created_at", "report_id"))
    shared = reports.groupBy(C.normalize_token(F.col("token")).alias("token")).agg(
        newest.alias("report"), F.max("created_at").alias("shared_at")
    )
    hit = F.col("report").isNotNull()
    updated = {
        "share_id": F.coalesce("share_id", C.key_id(F.col("token"))),
        "title": F.coalesce("report.title", "title"),
        "source_report_id": F.when(hit, F.col("report.report_id")).otherwise(F.col("source_report_id")),
        "status": F.when(hit, F.lit("active")).otherwise(F.col("status")),
        "expires_at": F.when(hit, F.lit(None).cast("string")).otherwise(F.col("expires_at")),
        "created_at": F.coalesce("created_at", "shared_at"),
    }
    return catalogs.join(shared, "token", "full_outer").withColumns(updated).select(*catalogs.columns)


def apply_review_decisions(requests: DataFrame, codes: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Owner decisions on access requests: new ``requests``, ``codes``, ``notifications`` and ``activity``.

    ``decisions``: ``decision_id``, ``request_id``, ``decided_at``, ``decision`` (approve or reject), ``reviewer_id``,
    ``code``, ``code_expires_at``. A rejected request cannot be approved again; every decision that counts retires the
    request's earlier unused codes. Ids of new codes and notifications are digests of decision and request.
    """
    order = F.struct("decided_at", "decision_id")
    is_reject = F.col("decision") == "reject"
    known = requests.select(
        F.col("id").alias("request_id"), "email", "username", (F.lower("status") == "rejected").alias("was_rejected")
    )
    facing = decisions.filter(F.col("decision").isin("approve", "reject")).join(known, "request_id")
    first_reject = (
        facing.filter(is_reject).groupBy("request_id").agg(F.min(order).alias("first_reject"))
    )
    blocked = ~is_reject & (
        F.coalesce("was_rejected", F.lit(False)) | F.coalesce(order > F.col("first_reject"), F.lit(False))
    )
    counted = facing.join(first_reject, "request_id", "left").filter(~blocked)
    last = counted.groupBy("request_id").agg(
        F.max_by(F.struct("decision", "reviewer_id", "decided_at", "decision_id"), order).alias("last")
    )
    status = F.when(F.col("last.decision") == "reject", "rejected").when(
        F.col("last.decision") == "approve", "approved"
    )
    new_requests = (
        requests.join(last.withColumnRenamed("request_id", "id"), "id", "left")
        .withColumns(
            {
                "status": F.coalesce(status, F.col("status")),
                "reviewed_by": F.coalesce("last.reviewer_id", "reviewed_by"),
                "reviewed_at": F.coalesce("last.decided_at", "reviewed_at"),
            }
        )
        .select(*requests.columns)
    )
    retired = (F.col("status") == "active") & F.col("used_at").isNull() & F.col("last").isNotNull()
    old_codes = (
        codes.join(last, "request_id", "left")
        .withColumn("status", F.when(retired, "inactive").otherwise(F.col("status")))
        .select(*codes.columns)
    )
    is_last = F.col("last.decision_id") == F.col("decision_id")
    issued = {
        "id": C.key_id(F.col("decision_id"), F.col("request_id")).cast(codes.schema["id"].dataType),
        "request_id": F.col("request_id"),
        "email": F.col("email"),
        "code": F.col("code"),
        "status": F.when(is_last, "active").otherwise(F.lit("inactive")),
        "expires_at": F.col("code_expires_at"),
        "generated_by": F.col("reviewer_id"),
        "created_at": F.col("decided_at"),
    }
    new_codes = (
        counted.filter(~is_reject)
        .join(last, "request_id")
        .select(
            *[
                issued[name].alias(name) if name in issued else F.lit(None).cast(codes.schema[name].dataType).alias(name)
                for name in codes.columns
            ]
        )
    )
    approved_text = F.concat(F.lit(TEXTS["request_approved"]), F.coalesce("code", F.lit("")))
    notifications = counted.select(
        C.key_id(F.col("decision_id"), F.col("request_id")).alias("id"),
        "request_id",
        "email",
        "username",
        F.when(is_reject, TEXTS["request_rejected"]).otherwise(approved_text).alias("message"),
        F.col("decided_at").alias("created_at"),
    )
    verb = F.when(is_reject, "rejected").otherwise("approved")
    logged = counted.select(
        F.col("reviewer_id").cast("string").alias("actor_username"), F.col("email").alias("detail"), F.col("decided_at").alias("created_at"),
        F.format_string(TEXTS["review_log"], verb).alias("action"),
    )
    return {
        "requests": new_requests,
        "codes": old_codes.unionByName(new_codes),
        "notifications": notifications,
        "activity": activity_rows(logged),
    }


def mark_codes_used(codes: DataFrame, uses: DataFrame) -> DataFrame:
    """Access codes or reset tokens after use: ``uses`` holds ``id`` and ``used_at``, the first use counting."""
    first = uses.groupBy("id").agg(F.min("used_at").alias("first_use"))
    used = codes.join(first, "id", "left").withColumn("used_at", F.coalesce("used_at", "first_use"))
    if "status" in codes.columns:
        used = used.withColumn("status", F.when(F.col("first_use").isNotNull(), "used").otherwise(F.col("status")))
    return used.select(*codes.columns)


def attach_pictures(catalogs: DataFrame, pictures: DataFrame) -> DataFrame:
    """Catalogs with the picture file of their token; ``pictures`` holds one ``qr_filename`` per ``token``."""
    newest = pictures.groupBy("token").agg(F.max("qr_filename").alias("picture"))
    return (
        catalogs.join(newest, "token", "left")
        .withColumn("qr_filename", F.coalesce("picture", "qr_filename"))
        .select(*catalogs.columns)
    )


def append_activity(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.unionByName(rows, allowMissingColumns=True)


def activity_rows(rows: DataFrame, action: str | None = None) -> DataFrame:
    """Log rows from (actor_username, detail, created_at[, action]); the id is a digest of the row."""
    rows = rows if action is None else rows.withColumn("action", F.lit(action))
    key = C.key_id(F.col("action"), F.col("actor_username"), F.col("detail"), F.col("created_at"))
    return _as_table("activity_logs", rows.withColumns({"activity_id": key, "actor_role": F.lit(None).cast("string")}))


def apply_repaired_pointers(catalogs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Catalogs with the repaired report pointers of :func:`joins.resolve_catalog_report` written back."""
    found = resolved.filter("is_repaired").select("share_id", "resolved_report_id")
    return (
        catalogs.join(found, "share_id", "left")
        .withColumn("source_report_id", F.coalesce("resolved_report_id", "source_report_id"))
        .select(*catalogs.columns)
    )


def reset_tables(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Uploaded-data tables emptied, others as they are; and per emptied table the rows it lost."""
    emptied = [name for name in tables if name in RESETTABLE_TABLES]
    kept = {name: table.filter(F.lit(False)) if name in emptied else table for name, table in tables.items()}
    counts = [tables[name].agg(F.lit(name).alias("table_name"), F.count("*").alias("removed_rows")) for name in emptied]
    return kept, reduce(DataFrame.unionByName, counts)
