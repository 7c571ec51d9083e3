"""Joins that may meet a hot key: its rows are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from so many rows, or from the 10,000th part of all, so that there are at most 10,000 hot keys.
HOT_ROWS, HOT_KEYS = 256, 10_000


def hot_keys(counted: DataFrame, key: str, n: int, rows: int = HOT_ROWS) -> DataFrame:
    """key and pieces (at least 2) of the hot keys in a table of keys with their numbers of rows m, n in all."""
    least = max(rows, n // HOT_KEYS)
    return counted.filter(F.col("m") > least).select(key, F.ceil(F.col("m") / least).cast("int").alias("pieces"))


def dealt_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, by: str) -> DataFrame:
    """Inner join on key of left with right, which has one row a key: the rows of a hot key are dealt by a hash of column by, and right's row goes to each piece."""
    hot = F.broadcast(hot)  # at most HOT_KEYS rows
    dealt = left.join(hot, key, "left").withColumn("piece", F.pmod(F.xxhash64(by), F.coalesce("pieces", F.lit(1)))).drop("pieces")
    copies = right.join(hot, key, "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)).cast("long") - 1))).drop("pieces")
    return dealt.join(copies, [key, "piece"]).drop("piece")
