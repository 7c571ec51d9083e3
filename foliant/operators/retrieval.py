"""Similarity search: exact top-k of many queries over all points, filtered, balanced across documents, gated.

Queries are met by matrix products. They are sent to the tasks in blocks of at most BLOCK_BYTES, whose size
is measured first; each task reads its points once a block and returns its own best k of each query, so what is
shuffled is k rows a query and task, and the last selection is a window over those.

What the queries of a block may use is pushed into the scan of the points, where all of them are restricted: a store laid
out by document then reads the folders of those documents only. In a task queries of one filter and one length of vector are a
group, which meets the rows of its documents and no others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

BLOCK_BYTES = 32 << 20
#: Scores that a task has at once, and bytes of best scores that it keeps.
SCORES, HELD = 1 << 22, 64 << 20
#: Values of a filter that go into the plan; more are joined.
LISTED = 1000
#: Decimals of a score, so that equal vectors tie wherever they stand in a product.
DIGITS = 12
STRONG = 0.45


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows as unit vectors in doubles; zeros for what is null, of another dimension or has no length."""
    size = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    out = np.zeros((len(vectors), dim))
    good = (size == dim) & vectors.is_valid().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    if good.all():
        out = flat.reshape(-1, dim)
    else:
        starts = np.cumsum(np.where(vectors.is_valid().to_numpy(zero_copy_only=False), size, 0)) - np.where(vectors.is_valid().to_numpy(zero_copy_only=False), size, 0)
        for i in np.flatnonzero(good):
            out[i] = flat[starts[i] : starts[i] + dim]
    return _unit(out)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def top_k(
    points: DataFrame,
    queries: DataFrame,
    k: int = 8,
    point_id: str = "point_id",
    vector: str = "vector",
    document: str | None = None,
    chunk_type: str | None = None,
    query_id: str = "query_id",
    documents: str | None = None,
    chunk_types: str | None = None,
    per_document: bool = False,
    threshold: float | None = None,
    limit: str | None = None,
) -> DataFrame:
    """query_id, point_id, document_id, score, rank: the best points of each query by cosine, ties by id.

    documents and chunk_types name array columns of queries with what is allowed (null, empty or only
    blank: all), compared as strings. With per_document the best k of each allowed document are kept, ranked within it. limit names a
    column of queries with each query's own k, at most k. k below 1 counts as 1. A query meets the points whose vectors are as
    long as its own; those without a length match nothing. A query without a vector is an error.
    """
    k = max(1, int(k))
    q = queries.select(
        F.col(query_id).alias("q"), F.col("vector").cast("array<double>").alias("v"),
        _clean(documents).alias("d"), _clean(chunk_types).alias("c"), (F.greatest(F.lit(1), F.col(limit)) if limit else F.lit(k)).alias("n"),
    )
    size, bad = q.agg(F.sum(F.size("v") * 8 + 64 + 32 * (F.coalesce(F.size("d"), F.lit(0)))), F.count_if(F.col("v").isNull() | (F.size("v") == 0))).first()
    if bad:
        raise ValueError(f"{bad} queries have no vector")
    n_blocks = max(1, math.ceil((size or 0) / BLOCK_BYTES))
    document_type = points.schema[document].dataType.simpleString() if document else "string"
    schema = f"q {q.schema['q'].dataType.simpleString()}, p {points.schema[point_id].dataType.simpleString()}, d {document_type}, score double, n int"
    own = Window.partitionBy("q", *(["d"] if per_document else [])).orderBy(F.desc("score"), "p")
    out = None
    for b in range(n_blocks):
        block = (q if n_blocks == 1 else q.filter(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == b)).toArrow()
        asked = _packed(block)
        few = points
        for column, name in ((document, "d"), (chunk_type, "c")):
            few = restricted(few, column, [*asked[f"{name}_sets"], *([None] if (asked[name] < 0).any() else [])])
        p = few.select(
            F.col(point_id).alias("p"), F.col(vector).cast("array<double>").alias("v"), (F.col(document) if document else F.lit(None).cast("string")).alias("d"),
            *(F.coalesce(F.col(c).cast("string") if c else F.lit(None), F.lit("")).alias(name) for c, name in ((document, "own_d"), (chunk_type, "own_c"))),
        )
        sent = points.sparkSession.sparkContext.broadcast(asked)
        near = p.mapInArrow(_nearest(sent, (q.schema["q"].dataType, p.schema["p"].dataType, p.schema["d"].dataType), per_document, threshold), schema)
        out = near if out is None else out.union(near)
    best = out.withColumn("rank", F.row_number().over(own)).filter("rank <= n")
    return best.select(F.col("q").alias("query_id"), F.col("p").alias("point_id"), F.col("d").alias("document_id"), "score", "rank")


def _packed(block: pa.Table) -> dict:
    """A block of queries as it is sent: vectors as one array of doubles with their sizes, and each distinct filter once, numbered by query (-1: none), so that a task holds about what the block measures."""
    v = block.column("v").combine_chunks()
    out = {"q": block.column("q").to_pylist(), "n": block.column("n").to_numpy().astype(np.int64), "flat": v.flatten().to_numpy(zero_copy_only=False).astype(float), "size": v.value_lengths().to_numpy().astype(np.int64)}
    for name in "dc":
        said: dict[str, str] = {}
        known: dict[frozenset, int] = {}
        codes = np.full(block.num_rows, -1, np.int64)
        at = 0
        for part in block.column(name).chunks:
            for row in range(0, len(part), 1 << 12):
                for x in part.slice(row, 1 << 12).to_pylist():
                    if x is not None:
                        codes[at] = known.setdefault(frozenset(said.setdefault(y, y) for y in x), len(known))
                    at += 1
        out |= {name: codes, f"{name}_sets": [sorted(x) for x in known]}
    return out


def _clean(name: str | None) -> Column:
    if name is None:
        return F.lit(None).cast("array<string>")
    kept = F.filter(F.col(name).cast("array<string>"), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, kept)


def restricted(points: DataFrame, column: str | None, allowed: list[list[str] | None]) -> DataFrame:
    """points whose column has, as a string, a value that some query allows; all if a query allows every one.

    Up to LISTED values are compared in the column's own type, so that partitions and row groups without them aren't read;
    more are joined, which prunes partitions while the query runs.
    """
    if column is None or not allowed or any(a is None for a in allowed):
        return points
    values, kind = sorted({v for a in allowed for v in a}), points.schema[column].dataType
    if len(values) > LISTED:
        wanted = points.sparkSession.createDataFrame([(v,) for v in values], "_wanted string")  # of one block of queries
        return points.join(wanted, F.col(column).cast("string") == F.col("_wanted"), "left_semi")
    if isinstance(kind, IntegralType):
        numbers = [int(v) for v in values if re.fullmatch("-?[0-9]{1,18}", v) and str(int(v)) == v]
        return points.filter(F.col(column).isin([F.lit(x).cast("long") for x in numbers]) if numbers else F.lit(False))
    return points.filter((F.col(column) if isinstance(kind, StringType) else F.col(column).cast("string")).isin(values))


class _Group:
    """Queries of one filter and one length of vector: their places, unit vectors, and the codes of documents and kinds that they allow (None: all)."""

    def __init__(self, at: list[int], asked: dict, documents: dict[str, int], kinds: dict[str, int]):
        self.at, self.n = np.array(at), asked["n"][at]
        self.dim = int(asked["size"][at[0]])
        self.unit = _unit(asked["flat"][asked["start"][at][:, None] + np.arange(self.dim)])
        d, c = (None if (i := asked[name][at[0]]) < 0 else asked[f"{name}_sets"][i] for name in "dc")
        self.documents = None if d is None else np.array(sorted({documents[x] for x in d}), np.int32)
        self.kinds = None if c is None else np.array(sorted({kinds[x] for x in c}))
        self.best: dict[tuple, np.ndarray] = {}  # of each document (or of all): the best scores so far, most x queries


def _codes(values: pa.Array, known: dict[str, int]) -> np.ndarray:
    """The number of each value, -1 for others."""
    coded = values.dictionary_encode()
    return np.array([known.get(x, -1) for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if len(values) else np.zeros(0, np.int64)


def _nearest(sent, kinds_of: tuple, per_document: bool, threshold: float | None):
    """Of each slice of points those that may be among the best: at least as good as the k-th best that the task has seen (of the document, with per_document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        q, (q_type, p_type, d_type) = sent.value, map(to_arrow_type, kinds_of)
        names = pa.array(q["q"], q_type)
        if not len(names):
            return
        documents, kinds = ({v: i for i, v in enumerate(sorted({v for own in q[f"{c}_sets"] for v in own}))} for c in "dc")
        alike: dict[tuple, list[int]] = {}
        for j, key in enumerate(zip(q["size"].tolist(), q["d"].tolist(), q["c"].tolist(), strict=True)):
            alike.setdefault(key, []).append(j)
        own = q | {"start": np.cumsum(q["size"]) - q["size"]}
        groups = [_Group(at, own, documents, kinds) for at in alike.values()]
        held, step = 0, max(64, SCORES // len(names))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, vectors, docs, own_d, own_c = (part.column(part.schema.names.index(c)) for c in ("p", "v", "d", "own_d", "own_c"))
                d, c = _codes(own_d, documents), _codes(own_c, kinds)
                if per_document:  # no document is one too, and not the blank one
                    named = docs.dictionary_encode()
                    each = named.indices.fill_null(-1).to_numpy()
                else:
                    each = np.zeros(len(d), np.int64)
                order = np.argsort(d, kind="stable")
                edge = np.searchsorted(d[order], np.arange(len(documents) + 1))
                own, found = {}, []
                for g in groups:
                    if g.dim not in own:
                        own[g.dim] = matrix(vectors, g.dim)
                    rows = np.arange(len(d)) if g.documents is None else np.concatenate([order[edge[x] : edge[x + 1]] for x in g.documents])
                    if g.kinds is not None:
                        rows = rows[np.isin(c[rows], g.kinds)]
                    rows = rows[own[g.dim][rows].any(1)]
                    for key in np.unique(each[rows]).tolist() if len(rows) else []:
                        mine = rows[each[rows] == key]
                        s = own[g.dim][mine] @ g.unit.T
                        np.round(s, DIGITS, out=s)
                        if threshold is not None:
                            s[s < threshold] = -np.inf
                        name, most = (key >= 0 and named.dictionary[key].as_py(), key >= 0) if per_document else (), int(g.n.max())
                        largest = lambda x, most=most: np.partition(x, len(x) - most, axis=0)[len(x) - most :].copy() if len(x) > most else x
                        top = largest(s)
                        top = largest(np.vstack((g.best[name], top))) if name in g.best else top
                        if name in g.best or held + most * len(g.at) * 8 <= HELD:
                            held += 0 if name in g.best else most * len(g.at) * 8
                            g.best[name] = top
                        rising = np.sort(top, axis=0)
                        place = len(top) - g.n
                        floor = np.where(place >= 0, rising[np.maximum(place, 0), np.arange(len(g.at))], -np.inf)
                        x, j = np.nonzero((s >= floor) & (s > -np.inf))
                        if len(x):
                            found.append((mine[x], g.at[j], s[x, j], g.n[j]))
                if found:
                    x, j, s, n = (np.concatenate(y) for y in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), ids.take(pa.array(x)).cast(p_type), docs.take(pa.array(x)).cast(d_type), pa.array(s, pa.float64()), pa.array(n.astype(np.int32))], names=["q", "p", "d", "score", "n"])

    return run


def balanced_limit(limit: Column, n_documents: Column) -> Column:
    """How many of each document a balanced search takes."""
    return F.greatest(F.lit(8), F.least(F.lit(16), F.ceil(limit / n_documents).cast("int") + 4))


def interleave(hits: DataFrame, order: DataFrame, limit: int) -> DataFrame:
    """Hits that are ranked within their documents, document after document by turns: query_id, point_id, document_id, score, rank.

    order has query_id, document_id, place. A point that several documents have counts where it comes first.
    """
    turn = Window.partitionBy("query_id").orderBy("rank", "place")
    first = Window.partitionBy("query_id", "point_id").orderBy("place", "rank")
    own = hits.join(order, ["query_id", "document_id"]).withColumn("_f", F.row_number().over(first)).filter("_f = 1")
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("rank")))
    return own.withColumn("_t", F.row_number().over(turn)).filter(F.col("_t") <= limit).select("query_id", "point_id", "document_id", "score", F.col("_t").alias("rank"))


def retrieve(points: DataFrame, queries: DataFrame, limit: int = 8, balance: bool = False, documents: str = "documents", **named) -> DataFrame:
    """Plain top-k, or by turns across the documents of a query where it has more than one."""
    if not balance:
        return top_k(points, queries, limit, documents=documents, **named)
    q = queries.withColumn("_n", F.size(F.coalesce(_clean(documents), F.array())))
    many = q.filter("_n > 1").withColumn("_k", balanced_limit(F.lit(limit), F.col("_n")))
    one = q.filter("_n <= 1")
    order = many.select("query_id", F.posexplode(F.array_distinct(_clean(documents))).alias("place", "document_id"))
    per = top_k(points, many, 16, documents=documents, per_document=True, limit="_k", **named)
    return interleave(per.withColumn("document_id", F.col("document_id").cast("string")), order, limit).unionByName(top_k(points, one, limit, documents=documents, **named).withColumn("document_id", F.col("document_id").cast("string")))


def strong_gate(queries: DataFrame, hits: DataFrame, least: float = STRONG) -> DataFrame:
    """query_id, top_score and strong for every query; without hits it is not strong."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("top_score"))
    return queries.select("query_id").join(best, "query_id", "left").withColumn("strong", F.coalesce(F.col("top_score") >= least, F.lit(False)))


def effective_limit(limit: Column, is_location: Column, is_computation: Column, n_documents: Column) -> Column:
    wide = is_location | (is_computation & (n_documents > 1))
    return F.when(wide, F.greatest(limit, F.lit(20))).otherwise(limit)
