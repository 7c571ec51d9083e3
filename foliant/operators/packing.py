"""Greedy packing in order: a new batch begins where the open one is full or the next row would not fit.

Rows are dealt by ranges of group and order, so that a group of any size is spread over tasks. Where a batch begins depends on all
before it, but only through where the first one begins in a range, and that is among its first most_rows rows. So each range says, for
each of these, where the batches that follow would end (pointers from each row to the next begin, followed backwards); what the
ranges say, a few numbers each, is put together in order; and each range is numbered from what it then knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliant.session import checkpointed

_OWN = ("_group", "_size")
#: Rows of a batch, of which each range tells as many numbers.
MOST_ROWS = 4096


def next_begins(sizes: np.ndarray, most_rows: int, most_size: int) -> np.ndarray:
    """For a batch that begins at each row, where the next one does (the number of rows if none)."""
    total, n = np.concatenate(([0], np.cumsum(sizes))), len(sizes)
    fits = np.searchsorted(total, total[:-1] + most_size, side="right") - 1  # rows before which all fit
    return np.minimum(n, np.maximum(np.arange(n) + 1, np.minimum(fits, np.arange(n) + most_rows)))


def first_begin(sizes: np.ndarray, held: int, size: int, most_rows: int, most_size: int) -> int:
    """Where the first batch of a range begins if an open one holds so many rows (0: none is open) of so much size."""
    if not held:
        return 0
    for i, n in enumerate(sizes[: max(0, most_rows - held) + 1].tolist()):
        if held >= most_rows or size + n > most_size:
            return i
        held, size = held + 1, size + n
    return len(sizes)


def summary(sizes: np.ndarray, most_rows: int, most_size: int) -> list[tuple[int, int, int]]:
    """For a first begin at each of the first most_rows rows: batches begun, and rows and size of the last one."""
    if not len(sizes):
        return []
    to, total = next_begins(sizes, most_rows, most_size).tolist(), np.concatenate(([0], np.cumsum(sizes)))
    n = len(to)
    begun, last = [0] * (n + 1), [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        begun[i] = 1 + begun[to[i]]
        last[i] = i if to[i] == n else last[to[i]]
    return [(begun[j], n - last[j], int(total[n] - total[last[j]])) for j in range(min(most_rows, n))]


def _parts(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, np.ndarray]]:
    """Groups of a range in order, with the sizes of their rows."""
    out: list[tuple[int, list[np.ndarray]]] = []
    for batch in batches:
        group, size = (batch.column(i).to_numpy() for i in (0, 1))
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if out and out[-1][0] == group[a]:
                out[-1][1].append(size[a:b])
            else:
                out.append((int(group[a]), [size[a:b]]))
    return [(g, np.concatenate(x)) for g, x in out]


def greedy(rows: DataFrame, group: str, order: list[Column | str], size: Column, most_rows: int, most_size: int, name: str = "batch_id", ranges: int | None = None) -> DataFrame:
    """rows with a batch number from 0 within each group, in order of the columns of order.

    Every row stays as it is, repeated ones too; null is a group of its own, and a null size is 0. A row that is larger than most_size is
    alone. Columns of rows pass through; one of the result's name gives way. The rows are written once to the shared folder.
    """
    if not 1 <= most_rows <= MOST_ROWS:
        raise ValueError(f"a batch has from 1 to {MOST_ROWS} rows")
    spark, names = rows.sparkSession, [c for c in rows.columns if c != name]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(F.xxhash64(F.col(group).isNull(), F.coalesce(F.col(group).cast("string"), F.lit(""))).alias("_group"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"), *names)
    own = checkpointed(own.repartitionByRange(n, "_group", *order).sortWithinPartitions("_group", *order))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's first and last group, the first sizes of its first one, its summary, and the state in which the last one ends."""
        parts = _parts(batches)
        if parts:
            (group, sizes), (last, end) = parts[0], parts[-1]
            ends = summary(end, most_rows, most_size)[0]
            row = {"at": TaskContext.get().partitionId(), "first": group, "last": last, "one": len(parts) == 1, "n": len(sizes), "sizes": sizes[: most_rows + 1].tolist(), "ways": [x for w in summary(sizes, most_rows, most_size) for x in w], "ends": list(ends)}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("at", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("one", pa.bool_()), ("n", pa.int64()), ("sizes", pa.list_(pa.int64())), ("ways", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]))

    said = own.select(*_OWN).mapInArrow(told, "at int, first long, last long, one boolean, n long, sizes array<long>, ways array<long>, ends array<long>").collect()  # a row a range
    enter: dict[int, tuple[int, int]] = {}  # first begin and batch of the first group of each range
    open_: tuple[int, int, int, int] | None = None  # group, batch, rows, size
    for r in sorted(said, key=lambda r: r.at):
        _, batch, held, filled = open_ if open_ and open_[0] == r.first else (r.first, -1, 0, 0)
        sizes = np.array(r.sizes, np.int64)
        first = first_begin(sizes, held, filled, most_rows, most_size)
        enter[r.at] = (first, batch)
        if not r.one:
            begun, rows_, filled = r.ends
            open_ = (r.last, begun - 1, rows_, filled)
        elif first >= r.n:
            open_ = (r.first, batch, held + r.n, filled + int(sizes.sum()))
        else:
            begun, rows_, filled = r.ways[3 * first : 3 * first + 3]
            open_ = (r.first, batch + begun, rows_, filled)
    sent = spark.sparkContext.broadcast(enter)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, batch = sent.value.get(TaskContext.get().partitionId(), (0, -1))
        now, held, filled, seen = None, 0, 0, 0
        for x in batches:
            out = []
            for group, size in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                if now is None:
                    now = group
                elif group != now:
                    now, batch, held, filled, first = group, -1, 0, 0, seen
                if seen >= first and (held == 0 or held >= most_rows or filled + size > most_size):
                    batch, held, filled = batch + 1, 0, 0
                if seen >= first:
                    held, filled = held + 1, filled + size
                seen += 1
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*x.columns[2:], pa.array(out, pa.int64())], names=[*names, name])

    return own.mapInArrow(number, StructType([*(rows.schema[c] for c in names), StructField(name, LongType())]))
