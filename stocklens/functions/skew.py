"""Order within a key, when one key may hold a large share of all rows."""

from pyspark.sql import DataFrame, Window, functions as F

#: A key is hot if it holds more than this share of the rows, so there are fewer than ``HOT_PARTS`` hot keys.
HOT_PARTS = 256


def ordered_chunks(df: DataFrame, key: str, order: str, parts: int = HOT_PARTS) -> DataFrame:
    """``df`` with ``chunk``: 0, but for the rows of a hot key a number that grows with the numeric column ``order``.

    Hot keys are fewer than ``parts``, so what is needed of them is broadcast. Their values of ``order`` are cut into
    ``parts`` ranges of equal width.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_size"), F.min(order).alias("_low"), F.max(order).alias("_high"))
    total = sizes.agg(F.sum("_size").alias("n")).scalar()
    hot = sizes.filter(F.col("_size") * parts > total).select(key, "_low", "_high")
    width = F.greatest((F.col("_high") - F.col("_low") + 1) / parts, F.lit(1.0))
    chunk = F.coalesce(F.floor((F.col(order) - F.col("_low")) / width), F.lit(0)).cast("int")
    return df.join(F.broadcast(hot), key, "left").withColumn("chunk", chunk).drop("_low", "_high")


def numbered(df: DataFrame, key: str, order: str, parts: int = HOT_PARTS) -> DataFrame:
    """``df`` with ``position`` (from 1) by ``order`` within ``key``, and ``chunk``; a hot key is spread over tasks."""
    chunked = ordered_chunks(df, key, order, parts).repartition(key, "chunk")
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunked.groupBy(key, "chunk").count().select(key, "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(key, "chunk").orderBy(order))
    return chunked.withColumn("_within", inner).join(offsets, [key, "chunk"]).withColumn("position", F.col("_before") + F.col("_within")).drop("_before", "_within")
