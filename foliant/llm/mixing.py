"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Each source asks for its weight's share of all words and stops at max_epochs times its own size; what
it leaves is shared by weight among the others, until none is above. With the sources ordered by
cap / weight that is one pass: source i is full if the words left for it and all after it, at the
level of its own cap, suffice. A target of e times a source's size takes every document floor(e)
times, and once more the first of them in the order of a seeded hash until the rest is filled; the
document at the edge is taken in part, so that a source gives its target rounded to a word.

The order within a source is cut into buckets by the first digits of the hash, about as many as a bucket then has
rows where one source has all: sums of the buckets are added up, then the rows within each, so no source meets in one
task. The hash is of key and text, so neither do rows without a key or of one key. Only the sources themselves,
a few numbers each, are ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import checkpointed, column

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weight(place: Column, weights: tuple[int, ...] = (1, 2, 3)) -> Column:
    return F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from one row a source; weights go round by code point, null last."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    s = sizes.withColumn("weight", cycled_weight(F.row_number().over(by_name), weights)).withColumn("cap", F.col("source_size") * max_epochs)
    s = s.withColumn("room", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(after)).withColumn("full", F.col("room").cast("double") * F.col("weight") >= F.col("cap").cast("double") * F.col("open"))
    # all before a source that is not full are full, so the first such one has the words and weights that are left
    s = s.withColumn("share", F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), "source", "room", "open"))).over(Window.partitionBy()))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("share.room").cast("double") * F.col("weight") / F.col("share.open")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = SEED, carry: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row, after columns carry.

    A null or empty text has no words, very long ones are counted whole; null is a source of its own, last in the order.
    Rows alike in key and text take turns. A source without words has target 0. An empty table gives an empty
    result. Only key, text, source and carry are read, so other columns may have any name; a carried column named as
    a new one gives way to it.
    """
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(column(text), F.lit("")))))
    all_rows = docs.select(column(key).alias("doc_id"), column(source).alias("source"), n_words(column(text)).alias("size"), place.alias("place"), *(column(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    sized = all_rows if carry else checkpointed(all_rows)
    digits = digits or max(1, math.ceil(math.log(max(1, (docs if carry else sized).count()), 16) / 2))  # buckets by the square root of the rows
    sized = sized.withColumn("bucket", F.substring("place", 1, digits))
    name, null = F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none")
    buckets = sized.groupBy(name, null, "bucket").agg(F.sum("size").alias("own"))
    buckets = buckets.withColumn("ahead", F.sum("own").over(Window.partitionBy("name", "none").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own"))
    per = buckets.groupBy("name", "none").agg(F.sum("own").alias("source_size")).withColumn("source", F.when(~F.col("none"), F.col("name")))
    per = targets(per.select("source", "source_size"), weights, max_epochs).select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"), "source_size", "target")
    known = buckets.join(per, ["name", "none"]).drop("own")
    rows = sized.select("doc_id", "size", "place", "bucket", name, null, *(f"_c{i}" for i in range(len(carry)))).join(known, ["name", "none", "bucket"])
    inside = Window.partitionBy("name", "none", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.col("ahead") + F.sum("size").over(inside) - F.col("size"))
    wanted = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0)
    rest = wanted - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    made = {"doc_id": F.col("doc_id"), "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": taken.cast("long")}
    return rows.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry) if c not in made), *(x.alias(c) for c, x in made.items()))
