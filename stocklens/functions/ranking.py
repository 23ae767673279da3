"""Ranked prefixes of a table."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_rows(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows, with their ``position``; only those k rows are numbered."""
    keys = [F.asc(key) if isinstance(key, str) else key for key in order]
    return df.orderBy(*keys).limit(k).withColumn("position", F.row_number().over(Window.orderBy(*keys)))
