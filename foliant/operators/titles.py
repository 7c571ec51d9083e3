"""The last distinct titles up to each row, with a bounded state.

Rows are dealt by ranges of group and order, so a group of any size is spread over tasks. What a range leaves to the next one is its own last n
distinct titles, put behind those that it was given, so the states of all ranges come from a few words of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from foliant.session import checkpointed


def _pushed(titles: list[str], title: str | None, n: int) -> list[str]:
    if title is None or titles and titles[-1] == title:
        return titles
    return [*(t for t in titles if t != title), title][-n:]


def last_titles(rows: DataFrame, group: str, order: list[Column | str], title: Column, n: int = 3, name: str = "titles", ranges: int | None = None) -> DataFrame:
    """rows with name, the last n distinct titles of the group up to the row, each at the place where it was last.

    Null titles are none; a null group is a group. Every row stays, repeated ones too; columns pass through, one of the result's name gives way. The rows
    are written once to the shared folder.
    """
    spark, names = rows.sparkSession, [c for c in rows.columns if c != name]
    n_ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.xxhash64(F.col(group).isNull(), F.coalesce(F.col(group).cast("string"), F.lit("")))
    own = rows.select(key.alias("_group"), title.cast("string").alias("_title"), *names)
    own = checkpointed(own.repartitionByRange(n_ranges, "_group", *order).sortWithinPartitions("_group", *order))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First and last group of a range, whether these are one, and the titles that the last one ends with."""
        first, last, one, titles = None, None, True, []
        for x in batches:
            for g, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                if first is None:
                    first = last = g
                elif g != last:
                    last, one, titles = g, False, []
                titles = _pushed(titles, t, n)
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"at": TaskContext.get().partitionId(), "first": first, "last": last, "one": one, "titles": titles}], schema=pa.schema([("at", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("one", pa.bool_()), ("titles", pa.list_(pa.string()))]))

    enter: dict[int, list[str]] = {}
    group_now, now = None, []
    for r in sorted(own.select("_group", "_title").mapInArrow(told, "at int, first long, last long, one boolean, titles array<string>").collect(), key=lambda r: r.at):  # a row a range
        enter[r.at] = now if r["first"] == group_now else []
        now = list(r.titles) if not r.one else enter[r.at]
        for t in r.titles if r.one else ():
            now = _pushed(now, t, n)
        group_now = r["last"]
    sent = spark.sparkContext.broadcast(enter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        titles, last = sent.value.get(TaskContext.get().partitionId(), []), None
        for x in batches:
            out = []
            for g, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                if last is not None and g != last:
                    titles = []
                last, titles = g, _pushed(titles, t, n)
                out.append(titles)
            yield pa.RecordBatch.from_arrays([*x.columns[2:], pa.array(out, pa.list_(pa.string()))], names=[*names, name])

    return own.mapInArrow(run, StructType([*(rows.schema[c] for c in names), StructField(name, ArrayType(StringType()))]))
