"""Typed table scans, schema conformance and the inventory sink."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stocklens.schemas import COLUMN_DEFAULTS, TABLES

DEFAULT_BUCKETS = 64


def conform_schema(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Columns of ``schema`` in order: missing ones are added, nulls take the column's default."""
    columns = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if defaults and field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One stored table with its declared types; columns added later are null or default in old files.

    The declared schema is enough to read files of any age, so no footer is read for its schema.
    """
    stored = spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")
    return conform_schema(stored, TABLES[name], COLUMN_DEFAULTS.get(name))


def load_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {name: load_table(spark, folder, name) for name in names or list(TABLES)}


def report_bucket(report_id: Column, buckets: int = DEFAULT_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(report_id), F.lit(buckets)).cast("int")


def append_inventory(
    rows: DataFrame, path: str, user_id: int | None = None, buckets: int = DEFAULT_BUCKETS, mode: str = "append"
) -> None:
    """Append rows tagged with their report, all or nothing through the job commit.

    The files are split by a hash bucket of the report, not by report: millions of uploads must not become millions of
    folders. ``rebalance`` gives each bucket files of a good size and splits a bucket that one large report fills.
    """
    schema = TABLES["inventory_data"]
    if user_id is not None:
        rows = rows.withColumn("user_id", F.lit(user_id))
    (
        conform_schema(rows, schema, COLUMN_DEFAULTS["inventory_data"])
        .withColumn("report_bucket", report_bucket(F.col("report_id"), buckets))
        .hint("rebalance", "report_bucket")
        .sortWithinPartitions("report_bucket", "report_id")
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy("report_bucket")
        .parquet(path)
    )


def read_inventory(
    spark: SparkSession, path: str, report_id: str | None = None, buckets: int = DEFAULT_BUCKETS,
    with_bucket: bool = False,
) -> DataFrame:
    """The stored inventory; naming a report prunes to its bucket and skips row groups of other reports.

    Keep the bucket column where a later join on it can prune folders at run time.
    """
    schema = T.StructType([*TABLES["inventory_data"].fields, T.StructField("report_bucket", T.IntegerType())])
    stored = spark.read.schema(schema).parquet(path)
    if report_id is not None:
        same_bucket = F.col("report_bucket") == report_bucket(F.lit(report_id), buckets)
        stored = stored.filter(same_bucket & (F.col("report_id") == report_id))
    return stored if with_bucket else stored.drop("report_bucket")
