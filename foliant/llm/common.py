"""What several operators share: Arrow batches cut by bytes and vectorised word hashes.

Python work runs in ``mapInArrow`` only, one pass over the rows, with memory bounded by a slice of
a few megabytes of text (or by the longest single text, where that is longer).
"""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from foliant.session import checkpointed

__all__ = ["checkpointed", "column", "dealt_join", "grams", "hot_keys", "map_texts", "partitions", "places", "prefix", "quoted", "resource", "shared_folder", "slices", "stored", "utf8", "Words"]

#: Text bytes that one call of a batch function sees.
SLICE_BYTES = 1 << 20
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def prefix(df: DataFrame) -> str:
    """As many _ as no column of df begins with: an operator's own columns beside those of df begin so."""
    out = "_"
    while any(c.startswith(out) for c in df.columns):
        out += "_"
    return out


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


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in that of spark.checkpoint.dir, or in the warehouse where it is unset; deleted when this program ends in an orderly way."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_folder, spark, path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def stored(df: DataFrame, name: str = "table", tidy: bool = False) -> DataFrame:
    """df, written once to the shared folder as Parquet and read from there, column by column.

    tidy: shuffle files of the write go when it is done, not when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    old = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if old is None else spark.conf.set(TIDY, old)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and ends in them. Nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(batch: pa.RecordBatch, by: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about slice_bytes of text in column by; a longer text is a run of its own."""
    if batch.num_rows == 0:
        return
    before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False)) // max(1, slice_bytes)
    cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def map_texts(
    df: DataFrame,
    using: Sequence[str],
    carry: Sequence[str],
    fields: Sequence[StructField],
    make: Callable[[], Callable[..., Sequence]],
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Columns carry of df, then fields as make()(*arrays of using) gives them for each slice of rows.

    using[0] is the text by which slices are cut. A carried column that has the name of a new field
    gives way to it.
    """
    new = {f.name for f in fields}
    carry = [c for c in carry if c not in new]
    given = df.select(*(column(c).alias(f"_u{i}") for i, c in enumerate(using)), *(column(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    kept = [StructField(c, given.schema[f"_c{i}"].dataType) for i, c in enumerate(carry)]
    n = len(using)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        work, names = make(), [*carry, *(f.name for f in fields)]
        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for part in slices(batch, 0, slice_bytes):
                made = work(*part.columns[:n])
                yield pa.RecordBatch.from_arrays([*part.columns[n:], *(pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t) for x, t in zip(made, types, strict=True))], names=names)

    return given.mapInArrow(run, StructType([*kept, *fields]))


# -- words as 64-bit hashes -------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2**64 to the powers 0 to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + n // 4 + 2, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def byte_table(inside: Callable[[int], bool], fold: bool = True) -> np.ndarray:
    """Maps a byte to itself (A-Z to a-z with fold), to 0 if no word has it."""
    return np.array([(b + 32 if fold and 65 <= b <= 90 else b) if inside(b) else 0 for b in range(256)], np.uint8)


#: Words between the ASCII white space characters.
SPACED = byte_table(lambda b: b != 32 and not 9 <= b <= 13 and b > 0)
#: Runs of ASCII letters and digits and of all beyond ASCII.
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


#: A long word is cut where the hash of so many bytes before says so; what has no such place for so many times most is cut by length.
WINDOW, PLAIN = 6, 16


class Words:
    """All words of some texts: hash, first and last byte, and the text each is of.

    With most, words of more bytes are cut where their bytes say so, at each eighth character or so, so that an
    insertion changes only the pieces next to it.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray = ALNUM, most: int = 0):
        raw, self.ends_of = utf8(texts)
        self.x = x = table[raw]
        n = len(x)
        word = np.zeros(n + 2, bool)
        word[1:-1] = x != 0
        first = np.zeros(n + 1, bool)
        first[self.ends_of] = True
        self.start = np.flatnonzero(word[1:-1] & (~word[:-2] | first[:n]))
        self.end = np.flatnonzero(word[1:-1] & (~word[2:] | first[1:])) + 1
        if most and len(self.start) and int((self.end - self.start).max()) > most:
            long = self.end - self.start > most
            size = (self.end - self.start)[long] - WINDOW
            at = np.repeat(self.start[long] + WINDOW - np.cumsum(size) + size, size) + np.arange(size.sum())
            before = np.zeros(len(at), np.uint64)
            for j in range(WINDOW):
                before = before * np.uint64(_BASE) + x[at - WINDOW + j]
            cuts = at[(mixed(before) >> np.uint64(61) == 0) & (x[at] & 0xC0 != 0x80)]  # not within a character
            self.start, self.end = np.sort(np.concatenate((self.start, cuts))), np.sort(np.concatenate((self.end, cuts)))
            size = self.end - self.start
            step = np.where(size > PLAIN * most, most, size)
            pieces = -(-size // step)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            step = np.repeat(step, pieces)
            self.start, self.end = np.repeat(self.start, pieces) + nth * step, np.repeat(self.end, pieces)
            self.end = np.minimum(self.start + step, self.end)
        up, down = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=total[1:])
        self.hash = mixed((total[self.end] - total[self.start]) * down[self.start])
        self.of = np.searchsorted(self.ends_of, self.start, side="right") - 1
        self.n_texts = len(texts)

    def counts(self) -> np.ndarray:
        return np.bincount(self.of, minlength=self.n_texts)

    def said(self, i: int, k: int = 1) -> bytes:
        """Words i to i + k - 1, joined by a space."""
        return b" ".join(self.x[self.start[j] : self.end[j]].tobytes() for j in range(i, i + k))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive items."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mixed(h)


def places(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each of x is in the sorted table, -1 if nowhere."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def resource(path: str) -> bytes:
    """A vocabulary file by its path."""
    with open(os.path.expanduser(path), "rb") as f:
        return f.read()
