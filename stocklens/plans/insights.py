"""Insight sentences and chart series as rows.

Every sentence needs one row of a ranking. All rankings over one table are taken in a single global aggregate
(``min_by``/``max_by`` keep one candidate per task) instead of one sort per sentence.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stocklens.functions import columns as C
from stocklens.operators import rollups, topk
from stocklens.schemas import DASHBOARD_LOW_STOCK, MIN_ROWS_FOR_INSIGHTS, TEXTS

_LAST = 2**63 - 1


def _messages(row: DataFrame, sentences: list[Column], empty_text: str | None) -> DataFrame:
    """One row per non-null sentence, numbered from 1."""
    kept = F.filter(F.array(*sentences), lambda s: s.isNotNull())
    if empty_text:
        kept = F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(empty_text)))
    return row.select(F.posexplode(kept).alias("position", "message")).select(
        (F.col("position") + 1).alias("position"), "message"
    )


def _say(template: str, *columns: Column) -> Column:
    """A sentence; null when the first value is absent."""
    return F.when(columns[0].isNotNull(), F.format_string(template, *columns))


def _first(fields: list[str], order: Column, condition: Column | None = None) -> Column:
    """The fields of the first row by ``order``, among the rows meeting ``condition``."""
    key = order if condition is None else F.when(condition, order)
    return F.min_by(F.struct(*fields), key)


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _seen_rank() -> list[Column]:
    """First-seen order as ascending numbers: false sorts before true, and newer before older."""
    return [
        F.col("is_sales_only"),
        F.coalesce(-_micros(F.col("newest_row.created_at")), F.lit(_LAST)),
        -F.col("newest_row.id"),
        F.col("first_sale"),
    ]


def _ranked(*columns: Column) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])


def leading_products(facts: DataFrame) -> DataFrame:
    """First row of each product ranking and the totals of the summary, in one pass over the product facts."""
    seen = _seen_rank()
    low = F.col("stock").between(0, 9)
    return facts.agg(
        F.count("*").alias("products"),
        F.sum("value").alias("total_value"),
        F.count_if(low).alias("low_products"),
        F.sum("sold").alias("units_sold"),
        _first(["product_name", "sold"], _ranked(-F.col("sold"), *seen), F.col("sold") > 0).alias("fast"),
        _first(
            ["product_name", "sold", "stock"],
            _ranked(F.col("sold"), -F.col("stock"), *seen),
            F.col("stock") > 0,
        ).alias("slow"),
        _first(["product_name", "stock"], _ranked(F.col("stock"), *seen), low).alias("low"),
        _first(["product_name", "value"], _ranked(-F.col("value"), *seen)).alias("valuable"),
    )


def business_summary(facts: DataFrame) -> DataFrame:
    """Headline numbers; ``low_stock_count`` counts all low products, not only those a list shows."""
    return leading_products(facts).select(
        F.col("products").alias("total_products"),
        F.coalesce("total_value", F.lit(0)).alias("total_inventory_value"),
        F.col("low_products").alias("low_stock_count"),
        F.coalesce("fast.product_name", F.lit(TEXTS["no_orders"])).alias("top_selling_product"),
        F.coalesce("units_sold", F.lit(0)).alias("total_orders"),
    )


def business_insights(facts: DataFrame, categories: DataFrame) -> DataFrame:
    """Sentences of the business page; ``categories`` is the category rollup."""
    strongest = categories.agg(
        F.max_by(F.struct("category", "stock"), F.struct("stock", "newest_row")).alias("strongest")
    ).scalar()
    row = leading_products(facts).withColumn("strongest", strongest)
    return _messages(
        row,
        [
            _say(
                TEXTS["business_fast"], F.col("fast.product_name"), F.col("fast.sold")
            ),
            _say(
                TEXTS["business_slow"],
                F.col("slow.product_name"), F.col("slow.sold"), F.col("slow.stock"),
            ),
            _say(
                TEXTS["business_low"], F.col("low.product_name"), F.col("low.stock")
            ),
            _say(
                TEXTS["business_category"],
                F.col("strongest.category"), F.col("strongest.stock"),
            ),
            _say(
                TEXTS["business_value"],
                F.col("valuable.product_name"), F.col("valuable.value").cast("decimal(38,2)").cast("string"),
            ),
        ],
        TEXTS["business_empty"],
    )


def inventory_insights(inventory: DataFrame) -> DataFrame:
    """Dashboard recommendations; a single hint below the minimum number of rows."""
    value = C.line_total(F.col("price"), F.col("quantity"))
    newest = F.struct("created_at", "id")
    quantity = F.coalesce("quantity", F.lit(0))
    rows = inventory.agg(
        F.count("*").alias("rows"),
        F.max_by(
            F.struct("product_name", quantity.alias("quantity")), F.when(quantity <= DASHBOARD_LOW_STOCK, newest)
        ).alias("low"),
        F.max_by(
            F.struct("product_name"), F.struct(value.alias("v"), "created_at", "id")
        ).alias("valuable"),
    )
    strongest = rollups.category_units(inventory).agg(
        F.max_by(F.struct("category", "units"), F.struct("units", "newest_row")).alias("strongest")
    ).scalar()
    row = rows.withColumn("strongest", strongest)
    enough = F.col("rows") >= MIN_ROWS_FOR_INSIGHTS
    best = F.coalesce(F.col("strongest.category"), F.lit("None"))
    return _messages(
        row,
        [
            F.when(
                enough,
                F.format_string(
                    TEXTS["dashboard_category"], best, F.col("strongest.units")
                ),
            ).otherwise(F.lit(TEXTS["dashboard_few"])),
            F.when(
                enough,
                _say(
                    TEXTS["dashboard_low"], F.col("low.product_name"), F.col("low.quantity")
                ),
            ),
            F.when(
                enough,
                _say(
                    TEXTS["dashboard_value"],
                    F.col("valuable.product_name"),
                ),
            ),
        ],
        None,
    )


def stock_insights(inventory: DataFrame, short: bool = False) -> DataFrame:
    """Sentences of the decision page; ``short`` gives the second wording."""
    products = rollups.product_quantity(inventory).agg(
        F.min_by("product_name", _ranked(-F.col("quantity"), F.col("product_name"))).alias("fast"),
        F.min_by("product_name", _ranked(F.col("quantity"), F.col("product_name"))).alias("slow"),
    )
    top = (
        rollups.category_quantity(inventory)
        .agg(F.min_by("category", _ranked(-F.col("quantity"), F.col("category"))).alias("top"))
        .scalar()
    )
    quantity = F.coalesce("quantity", F.lit(0))
    by_order = F.struct(
        F.coalesce(-_micros(F.col("created_at")), F.lit(_LAST)).alias("t"), (-F.col("id")).alias("i")
    )
    lowest = by_order if short else F.struct(quantity.alias("q"), F.col("id").alias("i"))
    low = inventory.agg(F.min_by("product_name", F.when(quantity < 10, lowest)).alias("low")).scalar()
    wording = "_short" if short else ""
    row = products.withColumn("top", top).withColumn("low", low)
    return _messages(
        row,
        [
            _say(TEXTS[f"stock_fast{wording}"], F.col("fast")),
            _say(TEXTS[f"stock_slow{wording}"], F.col("slow")),
            _say(TEXTS[f"stock_category{wording}"], F.col("top")),
            _say(TEXTS["stock_low"], F.col("low")),
        ],
        TEXTS["stock_empty"],
    )


def _series(chart: str, rows: DataFrame, label: str, value: str, position: Column | None = None) -> DataFrame:
    at = F.lit(None).cast("int") if position is None else position.cast("int")
    return rows.select(
        F.lit(chart).alias("chart"),
        at.alias("position"),
        F.col(label).alias("label"),
        F.col(value).cast("double").alias("value"),
    )


def _top_series(chart: str, rows: DataFrame, label: str, value: str) -> DataFrame:
    return _series(chart, rows, label, value, F.col("position"))


def chart_series(facts: DataFrame, categories: DataFrame, trend: DataFrame) -> DataFrame:
    """Series of the business page as (chart, position, label, value).

    The category and trend series are whole groupings of any size, so they carry no position: their labels order them.
    """
    valuable = topk.valuable_products(facts).withColumn("value", F.round("value", 2))
    return reduce(
        DataFrame.unionByName,
        [
            _top_series("fast", topk.fast_movers(facts), "product_name", "sold"),
            _top_series("slow", topk.slow_movers(facts), "product_name", "sold"),
            _top_series("value", valuable, "product_name", "value"),
            _series("category", categories, "category", "stock"),
            _series("trend", trend, "day", "units"),
        ],
    )


def entry_chart_series(inventory: DataFrame) -> DataFrame:
    """Units per category and per entry day."""
    return _series("category", rollups.category_units(inventory), "category", "units").unionByName(
        _series("trend", rollups.entry_trend(inventory), "day", "units")
    )


def upload_charts(inventory: DataFrame) -> DataFrame:
    """Data behind the charts of an upload: top products, all months, low stock and category share.

    Months carry no position: there may be any number of them, and their labels order them.
    """
    return reduce(
        DataFrame.unionByName,
        [
            _top_series("top_products", topk.quantity_leaders(inventory), "product_name", "quantity"),
            _series("monthly_sales", rollups.monthly_quantity(inventory), "month", "quantity"),
            _top_series("low_stock", topk.low_stock_rows(inventory, 5), "product_name", "quantity"),
            _top_series("category_distribution", rollups.category_share(inventory), "category", "percent"),
        ],
    )
