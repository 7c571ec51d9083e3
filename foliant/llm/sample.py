"""A bounded sample of labelled texts, the same for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import checkpointed, column


#: Bytes of text of a sample.
SAMPLE_BYTES = 64 << 20


def chosen(docs: DataFrame, labels: DataFrame, label: str, sample: int, text: str = "text", key: str = "doc_id", most_bytes: int = SAMPLE_BYTES) -> DataFrame | None:
    """k, y, t: key, label and text of at most sample labelled keys that docs have, those with the least hash, the greatest label of a repeated key. None without such.

    Of their texts, in this order, as many are taken as have most_bytes bytes, the first one in any case. Rows without a key or label don't count;
    a repeated key of docs gives its least text; null is empty. What is learned from texts is worked out by tasks, so that only numbers come to the driver.
    """
    known = labels.select(column(key).alias("k"), column(label).cast("int").alias("y")).filter("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    own = docs.select(column(key).alias("k"), F.coalesce(column(text), F.lit("")).alias("t"))
    rows = known.join(own.select("k"), "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(sample).collect()
    if not rows:
        return None
    few = docs.sparkSession.createDataFrame([(r.k, r.y) for r in rows], known.schema)  # at most sample rows of two numbers
    found = checkpointed(own.join(F.broadcast(few), "k").groupBy("k", "y").agg(F.min("t").alias("t")))
    upto = Window.orderBy(F.xxhash64("k"), "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = found.select("k", F.octet_length("t").alias("n")).withColumns({"to": F.sum("n").over(upto), "nth": F.row_number().over(upto)})  # sample rows of two numbers
    inside = sized.filter((F.col("to") <= most_bytes) | (F.col("nth") == 1)).select("k")
    return found.join(F.broadcast(inside), "k", "left_semi")


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, text: str = "text", key: str = "doc_id") -> tuple[list[str], list[int]]:
    """Texts and labels of chosen() by key."""
    rows = chosen(docs, labels, label, sample, text, key)
    if rows is None:
        return [], []
    got = rows.orderBy("k").toArrow()
    return got.column("t").to_pylist(), got.column("y").to_pylist()
