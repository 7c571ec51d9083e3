"""Lempel-Ziv phrase fingerprints.

A text is parsed as LZ78 does: the longest phrase that the dictionary has, with one more symbol, is a
new phrase. Symbols are what stands between white space; those of more than PIECE bytes are cut where the
bytes before say so, so that an insertion changes only the symbols next to it. The set of phrases is hashed into BINS bins, each of which keeps its least hash; the share of equal bins among
those that either text fills estimates how much of the two dictionaries is common, as a compressor
would find it.

Neighbours in the order of the key are met without a global sort: quantiles of the key cut the rows into
ranges, and those of a single frequent key, or of no key, into equal ranges of the text's hash; each text is moved
once to its range's partition, and the first row of a range once more to the range before it (around the end too),
so that a sorted partition reads each row with its next.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import Words, byte_table, column, mixed, partitions, slices

PIECE, BINS = 16, 128
SYMBOLS = byte_table(lambda b: b != 32 and not 9 <= b <= 13 and b > 0, fold=False)
_M = 0x9DDFEA08EB382D69
_ALL = (1 << 64) - 1


def phrases(symbols: list[int]) -> set[int]:
    """Hashes of the LZ78 dictionary phrases of a sequence of symbol hashes."""
    seen: set[int] = set()
    add, node = seen.add, 0
    for s in symbols:
        node = (node * _M + s) & _ALL
        if node not in seen:
            add(node)
            node = 0
    return seen


def signature(found: set[int], bins: int = BINS) -> np.ndarray:
    """For each bin 1 to 65535 from its least hash, 0 if it is empty."""
    h = mixed(np.fromiter(found, np.uint64, len(found)))
    least = np.full(bins, _ALL, np.uint64)
    np.minimum.at(least, (h % np.uint64(bins)).astype(np.int64), h)
    return np.where(least == np.uint64(_ALL), 0, mixed(least) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def signatures(texts: list[str], bins: int = BINS) -> list[np.ndarray]:
    w = Words(pa.array(texts, pa.string()), SYMBOLS, most=PIECE)
    cuts = np.concatenate(([0], np.cumsum(w.counts()))).tolist()
    symbols = w.hash.tolist()
    return [signature(phrases(symbols[a:b]), bins) for a, b in zip(cuts, cuts[1:], strict=False)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Equal bins among those that either fills; 1 for two empty ones."""
    filled = int(((a > 0) | (b > 0)).sum())
    return float(((a == b) & (a > 0)).sum() / filled) if filled else 1.0


def written(a: np.ndarray) -> str:
    return a.astype(">u2").tobytes().hex()


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _neighbours(bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose next is still to come: part, copy, key, text, signature
        for batch in batches:
            for piece in slices(batch, 3, 1 << 20):
                part, copy, key = (piece.column(i).to_pylist() for i in range(3))
                texts = piece.column(3).to_pylist()
                own = list(zip(part, copy, key, texts, signatures(texts, bins), strict=True))
                pairs = [(x, y) for x, y in zip([held, *own[:-1]] if held else own[:-1], own if held else own[1:], strict=True) if not x[1]]
                held = own[-1]
                new = [edited(x[3], y[3]) for x, y in pairs]
                marks = signatures(new, bins)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[2] for x, _ in pairs], piece.column(2).type),
                        pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
                        pa.array([written(x[4]) for x, _ in pairs], pa.string()),
                        pa.array([written(m) for m in marks], pa.string()),
                        pa.array([likeness(x[4], m) for (x, _), m in zip(pairs, marks, strict=True)], pa.float64()),
                        pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return run


def fingerprints_with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", bins: int = BINS, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The next row is that of the next lower key, after the last the first; rows of one key stand by a
    hash of the text, those without a key last. Keys are numbers. A null text is empty, very long ones are read whole;
    texts without symbols have the empty fingerprint and are alike (1). Repeated rows stay, each the next of another. A lone row
    is its own next. An empty table gives an empty result. Only key and text are read, so other columns may have any name.
    """
    own = docs.select(column(key).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = parts or partitions(spark)
    ids = own.filter("doc_id is not null").select(F.col("doc_id").cast("double").alias("x"))
    cuts = ids.approxQuantile("x", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    # a key at which several quantiles lie has a range of its own: [key, the next number)
    many = {x for x, n in Counter(cuts).items() if n > 1}
    cuts = sorted({*cuts, *(math.nextafter(x, math.inf) for x in many)}, reverse=True)
    bounds = "cast(array() as array<double>)" if not cuts else "array(" + ", ".join(f"{x!r}D" for x in cuts) + ")"
    steps = "array(" + ", ".join(str(1 << i) for i in reversed(range(max(1, len(cuts).bit_length())))) + ")"
    # how many bounds are above the key, found by halving
    range_ = F.expr(f"case when doc_id is null then {len(cuts) + 1} else aggregate({steps}, 0, (a, s) -> if(get({bounds}, a + s - 1) > doc_id, a + s, a)) end")
    ranged = own.withColumn("range", range_).withColumn("h", F.xxhash64("text"))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("range").collect()
    fair = max(1, sum(r.n for r in sizes) // parts)
    pieces, first, at = {}, {}, 0
    for r in sizes:
        pieces[r.range] = -(-r.n // fair) if r.low == r.high else 1  # null is no key, and equals itself here
        first[r.range] = at
        at += pieces[r.range]
    if not at:
        return ranged.select("range", F.lit(0).alias("copy"), "doc_id", "text").mapInArrow(_neighbours(bins), _schema(own))
    list_of = lambda values, kind: "array(" + ", ".join(f"cast({'null' if v is None else repr(v)} as {kind})" for v in values) + ")"
    slots = range(len(cuts) + 2)
    piece = f"cast(floor((h / 18446744073709551616D + 0.5D) * get({list_of([pieces.get(i, 1) for i in slots], 'int')}, range)) as int)"
    part = F.expr(f"get({list_of([first.get(i, 0) for i in slots], 'int')}, range) + least({piece}, get({list_of([pieces.get(i, 1) for i in slots], 'int')}, range) - 1)")
    ranged = ranged.withColumn("part", part)
    # the first rows of each part: those of its greatest key and, among them, the least hash
    tops = ranged.groupBy("part").agg(F.max("doc_id").alias("top")).orderBy("part")
    lows = ranged.join(F.broadcast(tops.withColumnRenamed("part", "of")), F.col("part") == F.col("of")).filter(F.col("doc_id").eqNullSafe(F.col("top")))
    lows = lows.groupBy("part").agg(F.min("h").alias("h"), F.max("doc_id").alias("top")).orderBy("part").collect()
    by, own_parts = {r.part: r for r in lows}, [r.part for r in lows]
    before = {p: own_parts[i - 1] for i, p in enumerate(own_parts)}
    last = max(own_parts)
    top = list_of([by[i].top if i in by else None for i in range(last + 1)], own.schema["doc_id"].dataType.simpleString())
    low = list_of([by[i].h if i in by else None for i in range(last + 1)], "bigint")
    to = list_of([before.get(i) for i in range(last + 1)], "int")
    is_first = F.expr(f"get({top}, part) <=> doc_id and get({low}, part) = h")
    here = F.struct("part", F.lit(0).alias("copy"))
    places = F.when(is_first, F.array(here, F.struct(F.expr(f"get({to}, part)").alias("part"), F.lit(1).alias("copy")))).otherwise(F.array(here))
    dealt = ranged.select("doc_id", "text", "h", F.explode(places).alias("at")).select("at.part", "at.copy", "doc_id", "text", "h")
    dealt = dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "copy", F.col("doc_id").desc_nulls_last(), "h").drop("h")
    return dealt.mapInArrow(_neighbours(bins), _schema(own))


def _schema(own: DataFrame) -> str:
    return f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
