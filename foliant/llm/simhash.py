"""SimHash near-duplicates, exact at a Hamming radius.

Fingerprints of equal documents are one node. Two of 64 bits that differ in at most RADIUS bits agree
in at least r of b blocks, where b - r = RADIUS; so nodes are dealt by each choice of r blocks and their
bits there, with r grown with the number of nodes until a bucket holds about BUCKET. In a bucket the
fingerprints stand by population count in tiles of TILE, and tiles are compared by exclusive-or and
bit counts in numpy; tile pairs whose population counts differ beyond the radius are skipped. A bucket
above HOT is dealt further as pairs of its tiles, by population count and hash, over many tasks. Only links that
join what was not yet joined are returned, so a dense group gives fewer links than members.

A radius that finds most near copies also links texts that have nothing in common, the more the larger a corpus is. So links may
be confirmed: a second fingerprint of the same shingles, of other hashes, goes with the first, and the bits of both count.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, MapType, StructField, StructType, VariantType

from foliant.llm.common import checkpointed, column, dealt_join, hot_keys, map_texts, mixed, prefix
from foliant.llm.components import components

RADIUS, SHINGLE = 4, 4
#: For near copies: bits of the first fingerprint and of both together in which two may differ.
NEAR, CONFIRMED = 10, 22
TILE, BUCKET, HOT = 2048, 2048, 1 << 16


def simhash(text: str, k: int = SHINGLE) -> int:
    """64 bits, each set if it is in over half of the shingles' XXH64 (seed 42); 0 without words."""
    return _majority(_shingles(text, k))


def simhash_pair(text: str, k: int = SHINGLE) -> tuple[int, int]:
    """simhash() and a second fingerprint of the same shingles by other hashes."""
    h = _shingles(text, k)
    return _majority(h), _majority(mixed(h + np.uint64(0x9E3779B97F4A7C15)))


def _shingles(text: str, k: int) -> np.ndarray:
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    said, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(said[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for part in range(0, len(h), 1 << 14):  # as bytes, counted by value
        own = h[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(own, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), k: int = SHINGLE, both: bool = False) -> DataFrame:
    """Columns carry of every row and fp, the fingerprint as a signed long (and more, the second one, with both). Null and empty texts have 0."""

    def make():
        def work(texts: pa.Array):
            said = texts.fill_null("").to_pylist()
            if both:
                return list(np.array([simhash_pair(x, k) for x in said], np.uint64).reshape(-1, 2).view(np.int64).T)
            return [np.array([simhash(x, k) for x in said], np.uint64).view(np.int64)]

        return work

    return map_texts(docs, [text], carry, [StructField("fp", LongType()), *([StructField("more", LongType())] * both)], make)


def scheme(n: int, radius: int = RADIUS, bucket: int = BUCKET) -> tuple[list[tuple[int, int]], int]:
    """Blocks of bits (first, size) and how many must agree, so that a bucket has about as many of n as asked."""
    r = 1
    while r < 4 and n / 2 ** (64 * r / (radius + r)) > bucket:
        r += 1
    edges = [round(64 * i / (radius + r)) for i in range(radius + r + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], r


def joined(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE, other: np.ndarray | None = None, more: np.ndarray | None = None, total: int = 0) -> list[tuple[int, int]]:
    """Links within radius that span the components of distinct fingerprints, or of those between two sets.

    With more, the second fingerprints of all (those of other last), links are places, and no more than total bits of both may differ.
    """
    own = np.concatenate((fps, other)) if other is not None else fps
    count = np.bitwise_count(own)
    root = np.arange(len(own))

    def sorted_tiles(at: np.ndarray) -> list[np.ndarray]:
        at = at[np.argsort(count[at], kind="stable")]
        return [at[i : i + tile] for i in range(0, len(at), tile)]

    left = sorted_tiles(np.arange(len(fps)))
    right = left if other is None else sorted_tiles(np.arange(len(fps), len(own)))
    links = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(left):
        for b in right[i:] if other is None else right:
            if int(count[b[0]]) - int(count[a[-1]]) > radius or int(count[a[0]]) - int(count[b[-1]]) > radius:
                continue
            apart = np.bitwise_count(own[a][:, None] ^ own[b][None, :])
            near = apart <= radius
            if more is not None and near.any():
                near &= apart + np.bitwise_count(more[a][:, None] ^ more[b][None, :]) <= total
            if a is b:
                near = np.triu(near, 1)
            while True:  # each row takes a link to another component, until none is left
                tops = np.array([top(x) for x in a.tolist()]), (np.array([top(x) for x in b.tolist()]) if near.any() else None)
                if tops[1] is None:
                    break
                open_ = near & (tops[0][:, None] != tops[1][None, :])
                rows = np.flatnonzero(open_.any(1))
                if not len(rows):
                    break
                for x, y in zip(rows.tolist(), open_[rows].argmax(1).tolist(), strict=True):
                    p, q = top(int(a[x])), top(int(b[y]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        links.append((int(a[x]), int(b[y])) if more is not None else (int(own[a[x]]), int(own[b[y]])))
                near = open_
    return links


def _links(radius: int, tile: int, total: int | None = None):
    """Links in all buckets: rows of bucket, side (0, or 1 for the second tile of a pair), fp (and more), sorted, so that one bucket at a time is held."""
    signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))

    def found(key: np.ndarray, side: np.ndarray, fp: np.ndarray, more: np.ndarray | None = None) -> pa.RecordBatch:
        fp, more = fp.view(np.uint64), None if more is None else more.view(np.uint64)
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        a, b = [], []
        for s, e in zip(edges, edges[1:], strict=False):
            if e - s < 2:
                continue
            cut = s + int(np.searchsorted(side[s:e], 1))
            if cut == s:
                continue
            for x, y in joined(fp[s:cut], radius, tile, fp[cut:e] if cut < e else None, None if more is None else more[s:e], total or 0):
                a.append(x if more is None else s + x)
                b.append(y if more is None else s + y)
        if more is None:
            return pa.RecordBatch.from_arrays([signed(a), signed(b)], names=["a", "b"])
        at = np.array(a, np.int64), np.array(b, np.int64)
        return pa.RecordBatch.from_arrays([signed(x[i]) for i in at for x in (fp, more)], names=["a", "a_more", "b", "b_more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the bucket that may go on
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not batch.num_rows:
                continue
            if held and held[0][0][0] != new[0][0]:
                yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            at = int(np.searchsorted(new[0], new[0][-1]))
            if at:
                yield found(*(np.concatenate(x) for x in zip(*held, [c[:at] for c in new], strict=True)))
                held = []
            held.append([c[at:] for c in new])
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(nodes: DataFrame, n: int, radius: int = RADIUS, bucket: int = BUCKET, hot: int = HOT, tile: int = TILE, total: int | None = None) -> DataFrame:
    """Links a, b that span the components of distinct fingerprints fp (n of them) within radius bits; with total, of distinct fp and more, by their ids."""
    own = ["fp"] if total is None else ["fp", "more"]
    blocks, r = scheme(n, radius, bucket)
    bits = lambda first, size: F.expr(f"shiftrightunsigned(fp, {first}) & {(1 << size) - 1}L" if size < 64 else "fp")
    keys, wide = [], max(sum(size for _, size in chosen) for chosen in combinations(blocks, r))
    for i, chosen in enumerate(combinations(blocks, r)):
        value = F.lit(i << (wide - sum(size for _, size in chosen))).cast("long")  # no two choices have a key in common
        for first, size in chosen:
            value = F.shiftleft(value, size).bitwiseOR(bits(first, size))
        keys.append(value)
    dealt = nodes.select(F.explode(F.array(*keys)).alias("key"), *own)
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "a long, b long" if total is None else "a long, a_more long, b long, b_more long"
    found = lambda df: df.repartition(spread, "key").sortWithinPartitions("key", "side").mapInArrow(_links(radius, tile, total), schema)
    made = lambda df: found(df) if total is None else found(df).select(_ident("a", "a_more").alias("a"), _ident("b", "b_more").alias("b"))
    plain = dealt.withColumn("side", F.lit(0).cast("byte")).select("key", "side", *own)
    if n <= hot:  # no bucket holds a node twice
        return made(plain)
    many = checkpointed(dealt.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > hot))
    if many.isEmpty():
        return made(plain)
    out = made(plain.join(many, "key", "left_anti").select("key", "side", *own))
    # a tile of a hot bucket: fingerprints of one population count, cut by hash; pairs within the radius only
    cut = F.ceil(F.col("m") / hot).cast("int")
    tiles = dealt.join(many, "key").withColumn("cut", cut).withColumn("own", F.expr("bit_count(fp) * cut + pmod(xxhash64(fp), cut)"))
    first = tiles.select("key", *own, F.lit(0).cast("byte").alias("side"), "own", F.explode(F.expr(f"sequence(own, (bit_count(fp) + {radius}) * cut + cut - 1)")).alias("with"))
    second = tiles.select("key", *own, F.lit(1).cast("byte").alias("side"), F.explode(F.expr(f"sequence(greatest(0, (bit_count(fp) - {radius}) * cut), own - 1)")).alias("from"), "own").filter("from < own")
    pairs = first.select(F.xxhash64("key", "own", "with").alias("key"), "side", *own).union(second.select(F.xxhash64("key", "from", "own").alias("key"), "side", *own))
    return out.union(made(pairs))


def _ident(fp: str, more: str) -> Column:
    """The id of a node of two fingerprints; of 3e10 some twenty pairs may have one id, and are then alike."""
    return F.xxhash64(fp, more)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, k: int = SHINGLE, bucket: int = BUCKET, hot: int = HOT, tile: int = TILE, total: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the least key reachable by links of at most radius bits (null only if all keys of
    the component are). Texts without words, null and empty ones too, have fingerprint 0 and link like any other;
    very long texts are read whole. Rows of a repeated key each have their own fingerprint, and equal texts have the
    same. An empty table gives an empty result. No column but key and text is read, so others may have any name.
    With total, links are confirmed: no more than total bits of the fingerprint and a second one together may differ.
    The rows of a frequent fingerprint or a large component are dealt to several tasks. Components whose longest path of
    links is beyond what components.MOST_ROUNDS rounds shorten (some 2 ** 30) raise an error.
    """
    own = docs.select(column(key).alias("doc_id"), column(text).alias("_text"))
    printed = fingerprints(own, "_text", ("doc_id",), k, total is not None)
    printed = checkpointed(printed if total is None else printed.withColumn("id", _ident("fp", "more")))
    ident, bits = ("fp", ["fp"]) if total is None else ("id", ["id", "fp", "more"])
    nodes = checkpointed(printed.groupBy(*bits).agg(F.min("doc_id").alias("least"), F.count("*").alias("m")))
    n, rows = nodes.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    root = components(links(nodes.select(*(c for c in bits if c != "id")), n, radius, bucket, hot, tile, total), n)
    named = nodes.join(root.withColumnRenamed("node", ident), ident, "left").withColumn("root", F.coalesce("root", ident))
    lone = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    named = dealt_join(named.select(ident, "root"), lone.select("root", "component_id"), "root", hot_keys(lone, "root", n), ident).select(ident, "component_id")
    joined_ = dealt_join(printed, named, ident, hot_keys(nodes, ident, rows), "doc_id")
    return joined_.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _ordered(kind: DataType) -> bool:
    """Whether values of a type have an order: those that hold maps or variants have none."""
    if isinstance(kind, ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return not isinstance(kind, MapType | VariantType)


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """One row of each component stays, with all its columns: the least by key (a null one first), then by a hash of key and text.

    Rows that are alike in key and text are one; rows of one hash and different keys are told apart. Null and empty
    texts are alike. An empty table gives an empty result; columns may have any names. Each row's text is moved once.
    """
    p = prefix(docs)
    own = F.xxhash64(F.coalesce(column(text), F.lit("")), column(key).isNull(), column(key))
    marked = docs.withColumn(f"{p}id", F.struct(column(key).alias("k"), own.alias("h")))
    named = near_duplicates(marked.select(f"{p}id", column(text)), text, f"{p}id", **how)
    stay = named.filter("doc_id = component_id").select(F.col("doc_id").alias(f"{p}id")).distinct()
    rest = [column(f.name) if _ordered(f.dataType) else F.to_json(F.struct(column(f.name))) for f in docs.schema.fields if f.name not in (text, key)]
    first = Window.partitionBy(f"{p}id").orderBy(*rest or [F.lit(0)])
    kept = marked.join(stay, f"{p}id", "left_semi").withColumn(f"{p}n", F.row_number().over(first))
    return kept.filter(F.col(f"{p}n") == 1).select(*(column(c) for c in docs.columns))
