"""Scalar rules of the domain as native column expressions (no Python workers)."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from stocklens.schemas import (
    DEMO_NAME_MARKERS,
    EMPTY_CATEGORY_WORDS,
    MONEY,
    NO_DATE,
    ORDER_STATUSES,
    TEXTS,
    UNCATEGORIZED,
    WHITESPACE,
)

_GROUPED_DIGITS = r"^[+-]?([0-9](_?[0-9])*)?\.?([0-9](_?[0-9])*)?([eE][+-]?[0-9](_?[0-9])*)?$"
_MAX_INT = 2_147_483_647


def strip(c: Column) -> Column:
    """Trim every kind of whitespace, not only spaces.

    Trimming by a character set is several times slower than trimming spaces, so it runs only where an end is not a
    printable ASCII character after that.
    """
    text = F.trim(c)
    clean = F.substring(text, 1, 1).between("!", "~") & F.substring(text, -1, 1).between("!", "~")
    return F.when(clean, text).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def default_if_falsy(c: Column, default, is_text: bool = False) -> Column:
    """Null, number zero and empty text take the default (so reorder level 0 becomes 10)."""
    empty = (c == "") if is_text else (c == 0)
    return F.when(c.isNull() | empty, F.lit(default)).otherwise(c)


def clean_category(c: Column, fallback: bool = False) -> Column:
    text = strip(c)
    missing = c.isNull() | (text == "") | F.lower(text).isin(EMPTY_CATEGORY_WORDS)
    empty = F.lit(UNCATEGORIZED) if fallback else F.lit(None).cast("string")
    # Printable ASCII without double blanks has nothing to collapse; the general pattern is slow.
    even = text.rlike("^[ -~]*$") & ~text.contains("  ")
    collapsed = F.when(even, text).otherwise(F.regexp_replace(text, f"[{WHITESPACE}]+", " "))
    return F.when(missing, empty).otherwise(collapsed)


def is_real_name(c: Column) -> Column:
    """True unless the name is blank or contains a demo marker anywhere."""
    name = F.lower(strip(F.coalesce(c, F.lit(""))))
    return (name != "") & ~reduce(or_, [name.contains(marker) for marker in DEMO_NAME_MARKERS])


def normalize_header(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_token(c: Column) -> Column:
    """The bare token of a pasted link: no query string, fragment, trailing slashes or leading path."""
    bare = F.substring_index(F.substring_index(strip(c), "?", 1), "#", 1)
    return blank_to_null(F.substring_index(F.regexp_replace(bare, "/+$", ""), "/", -1))


def normalize_email(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def _product_path_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"/product/(\d+)", 1), F.lit(""))


def extract_product_id(c: Column) -> Column:
    """Product id of scanned text: a product link, plain digits, or JSON with a link under ``url``."""
    text = strip(c)
    digits = F.when(text.rlike(r"^\d+$"), text)
    found = F.coalesce(_product_path_id(text), digits, _product_path_id(F.get_json_object(text, "$.url")))
    return found.try_cast("bigint")


def parse_payload(c: Column, schema: str) -> Column:
    """JSON text as a struct; null when it does not parse."""
    return F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))


def payload_label(c: Column) -> Column:
    """Name and category of a scanned payload, with the wording used when they are absent."""
    return F.struct(
        F.coalesce(F.get_json_object(c, "$.name"), F.lit("product")).alias("name"),
        F.coalesce(F.get_json_object(c, "$.category"), F.lit("category")).alias("category"),
    )


def _plain_digits(text: Column) -> Column:
    """Number text without the underscores that may group its digits; null where they stand elsewhere."""
    grouped = F.when(text.rlike(_GROUPED_DIGITS), F.replace(text, F.lit("_"), F.lit("")))
    return F.when(text.contains("_"), grouped).otherwise(text)


def to_number(c: Column) -> Column:
    """Text as a double. Null for text such as '12d' that a lenient cast would take."""
    text = _plain_digits(strip(c.cast("string")))
    return F.when(~text.rlike("[^0-9eE.+-]"), text.try_cast("double"))


def to_price(c: Column) -> Column:
    """Number text as money."""
    return to_number(c).try_cast(MONEY)


def price_problem(c: Column, label: str = "Price") -> Column:
    return F.when(to_price(c).isNull(), F.lit(TEXTS["not_a_number"] % label))


def _whole(c: Column) -> Column:
    return _plain_digits(strip(c.cast("string"))).try_cast("int")


def to_count(c: Column) -> Column:
    """Whole number text of zero or more; null for decimals, negatives and other text."""
    value = _whole(c)
    return F.when(value >= 0, value)


def count_problem(c: Column, label: str = "Quantity") -> Column:
    value = _whole(c)
    return F.when(value < 0, F.lit(TEXTS["negative"] % label)).when(
        value.isNull(), F.lit(TEXTS["not_whole"] % label)
    )


def key_id(*columns: Column) -> Column:
    """A 60-bit id from the texts of a row's key, so that a repeated run gives the same id; nulls count as empty."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return digest_id(F.md5(text))


def digest_id(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def truncated_count(c: Column) -> Column:
    """Spreadsheet quantity: number text cut toward zero, negatives kept; null above the range of the column."""
    number = to_number(c)
    return F.when(F.abs(number) <= _MAX_INT, number.cast("int"))


def day_key(c: Column, is_text: bool = False) -> Column:
    key = F.substring(c, 1, 10) if is_text else F.date_format(c, "yyyy-MM-dd")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit(NO_DATE))


def month_key(c: Column, is_text: bool = False) -> Column:
    key = F.substring(c, 1, 7) if is_text else F.date_format(c, "yyyy-MM")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit(NO_DATE))


def title_status(c: Column) -> Column:
    """Order status in title case; null when it is not an allowed status."""
    status = F.initcap(F.lower(strip(c)))
    return F.when(status.isin(ORDER_STATUSES), status)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def filename_from_title(c: Column) -> Column:
    """File name in a title of the form 'catalog from <file>'."""
    found = F.regexp_extract(strip(F.coalesce(c, F.lit(""))), r"(?i)catalog from\s+(.+)$", 1)
    return blank_to_null(found)


def line_total(price: Column, quantity: Column) -> Column:
    zero = F.lit(0)
    return F.coalesce(price, zero.cast(MONEY)) * F.coalesce(quantity, zero)


def parse_expiry(c: Column) -> Column:
    """Expiry text as a timestamp; null when absent or not a date."""
    text = F.replace(F.replace(strip(c.cast("string")), F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def is_expired(c: Column, as_of: Column, unparseable_expires: bool) -> Column:
    """A blank expiry never expires; text that is not a date follows the given policy."""
    blank = c.isNull() | (c.cast("string") == "")
    parsed = parse_expiry(c)
    return (
        F.when(blank, F.lit(False)).when(parsed.isNull(), F.lit(unparseable_expires)).otherwise(parsed < as_of)
    )


def stock_status(quantity: Column, reorder_level: Column) -> Column:
    """Label of a catalog card."""
    return (
        F.when(quantity <= 0, F.lit(TEXTS["out_of_stock"]))
        .when(quantity <= reorder_level, F.lit(TEXTS["low_stock"]))
        .otherwise(F.lit(TEXTS["ready"]))
    )


def product_stock_label(quantity: Column) -> Column:
    """Label of a product page."""
    return F.when(F.coalesce(quantity, F.lit(0)) < 10, F.lit(TEXTS["product_low"])).otherwise(F.lit(TEXTS["product_available"]))


def timestamp(text: str) -> Column:
    return F.to_timestamp(F.lit(text))
