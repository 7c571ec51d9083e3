"""Ranked lexical search over bit-sliced impacts.

What a term adds to a document's score is a whole number. An index block holds the documents of a task as bits of 64-bit words; a term
has a bitmap for each bit of its impacts there, of which only words with a document are kept. A query adds the bitmaps of its terms by
carry arithmetic on whole words: carries are saved (three numbers become two, all slices at once) until the last term is in, then one
pass over the slices resolves them. The best k are read from the slices of the sum, most significant first: a slice either has more than
k candidates, to which the search then narrows, or its documents are in. Of equal scores those with the least key are taken.

Queries go to the tasks in blocks of at most BLOCK_BYTES, measured before; a task keeps the best k of each query over all of its index
blocks, so k rows a query and task are shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from foliant.llm.common import column, map_texts, stored

#: Bytes of a block of queries; documents and term counts of an index block.
BLOCK_BYTES, DOCS, ENTRIES = 4 << 20, 2048, 1 << 18
SCALE, TF, LENGTH, FREE, NORM = 10**9, 1000, 8, 25, 75

#: Letters in lower case, digits and bytes beyond ASCII as they are, else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Slices:
    """The bitmaps of some documents: for each term the words that have one of its documents, and a row of them for each bit."""

    def __init__(self, term: np.ndarray, at: np.ndarray, value: np.ndarray, n_docs: int):
        """Entries: a term, the place of a document, and what it adds (0 or more)."""
        self.words = -(-n_docs // 64)
        order = np.lexsort((at, term))
        term, at, value = term[order], at[order], value[order]
        word = at >> 6
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (word[1:] != word[:-1])))) if len(term) else np.zeros(0, np.int64)
        self.word, own = word[first], term[first]
        begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        end = np.append(begin, len(own))[1:]
        self.place = dict(zip(own[begin].tolist(), zip(begin.tolist(), end.tolist(), strict=True), strict=True))
        most = np.maximum.reduceat(value, np.searchsorted(term, own[begin])) if len(own) else np.zeros(0, np.int64)
        self.most = dict(zip(own[begin].tolist(), most.tolist(), strict=True))
        n_bits = int(value.max(initial=0)).bit_length()
        self.bits = np.zeros((n_bits, len(first)), np.uint64)
        bit = np.uint64(1) << (at & 63).astype(np.uint64)
        for b in range(n_bits):
            if len(first):
                self.bits[b] = np.bitwise_or.reduceat(np.where((value >> b) & 1, bit, np.uint64(0)), first)

    def total(self, query: dict[int, int]) -> np.ndarray:
        """Slices of the sum of the query's terms, each as often as it says."""
        here = {t: r for t, r in query.items() if t in self.place}
        n = sum(self.most[t] * r for t, r in here.items()).bit_length()
        if n > 63:
            raise OverflowError("a score has more than 63 bits")
        if not n:
            return np.zeros((0, self.words), np.uint64)
        own, carried = np.zeros((n, self.words), np.uint64), np.zeros((n, self.words), np.uint64)
        for t, repeats in here.items():
            a, b = self.place[t]
            at, bits = self.word[a:b], self.bits[:, a:b]
            for shift in range(repeats.bit_length()):
                if not repeats >> shift & 1:
                    continue
                x = np.zeros((n, b - a), np.uint64)
                top = min(n, shift + len(bits))
                x[shift:top] = bits[: top - shift]
                s, c = own[:, at], carried[:, at]
                half = s ^ c
                over = (s & c) | (half & x)
                own[:, at] = half ^ x
                carried[1:, at] = over[:-1]
                carried[0, at] = 0
        carry = np.zeros(self.words, np.uint64)
        for b in range(n):
            half = own[b] ^ carried[b]
            carry, own[b] = (own[b] & carried[b]) | (half & carry), half ^ carry
        return own

    def best(self, total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k documents with the greatest scores above 0; of equal ones those that stand first."""
        if not len(total):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        count = lambda x: int(np.bitwise_count(x).sum())
        taken, open_ = np.zeros(self.words, np.uint64), np.bitwise_or.reduce(total, axis=0)
        if count(open_) <= k:
            taken, open_ = open_, taken
        for row in total[::-1] if open_.any() else ():
            more = taken | (open_ & row)
            n = count(more)
            if n > k:
                open_ = open_ & row
            else:
                taken, open_ = more, open_ & ~row
                if n == k:
                    open_[:] = 0
                    break
        at = places(taken)
        at = np.concatenate((at, places(open_)[: k - len(at)]))
        set_ = (total[:, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        return at, (set_.astype(np.int64) << np.arange(len(total))[:, None]).sum(0)


def places(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    text: str = "text",
    key: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    docs_a_block: int = DOCS,
    entries: int = ENTRIES,
) -> DataFrame:
    """item_id, rank, doc_id, score: of each row of queries the k documents with the greatest scores above 0, ties by doc_id, a null one last.

    Null and empty texts have no terms and count nowhere; very long ones are read whole. Rows of a repeated doc_id are documents each,
    rows of a repeated item_id queries each. Without queries, or without documents, the result is empty. Only the named
    columns are read, so others may have any name. Scores of more than 63 bits are an error.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    asked = queries.select(column(item_id).alias("i"), F.coalesce(column(item_text).cast("string"), F.lit("")).alias("t"))
    size = asked.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    key_type, out = docs.schema[key].dataType, None
    result = StructType([StructField("q", IntegerType()), StructField("doc_id", key_type), StructField("score", LongType())])
    for b in range(n_blocks):
        rows = (asked if n_blocks == 1 else asked.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b)).toArrow()
        said = [Counter(terms(t)) for t in rows.column("t").to_pylist()]
        number = {t: n for n, t in enumerate(sorted({t for q in said for t in q}))}
        sent = sc.broadcast(number)
        counted = stored(_counted(docs, text, key, sent), "counts")
        n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = counted.select(F.explode("t").alias("t")).groupBy("t").count().toArrow()  # a row for each term of the block at most
        in_docs = dict(zip(found.column("t").to_pylist(), found.column("count").to_pylist(), strict=True))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * in_docs.get(t, 0) + 1))) for t in range(len(number))], np.int64)
        plan = sc.broadcast((weight, n_docs, n_terms, [{number[t]: n for t, n in q.items()} for q in said]))
        near = counted.mapInArrow(_ranked(plan, key_type, k, docs_a_block, entries), result)
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(rows.select(["i"]).append_column("q", pa.array(range(rows.num_rows), pa.int32())))  # a block's queries
        own = near.join(F.broadcast(names), "q").select(F.col("i").alias("item_id"), "rank", "doc_id", "score")
        out = own if out is None else out.union(own)
    return out


def _counted(docs: DataFrame, text: str, key: str, sent) -> DataFrame:
    """doc_id and n, its number of terms, of documents with terms; those of them that a query has (t), and how often (f)."""

    def make():
        number = sent.value

        def work(texts: pa.Array):
            n, t, f = [], [], []
            for said in texts.to_pylist():
                own = terms(said)
                found = Counter(own)
                known = sorted((number[w], c) for w, c in found.items() if w in number)
                n.append(len(own))
                t.append([x for x, _ in known])
                f.append([c for _, c in known])
            return n, t, f

        return work

    own = docs.select(column(key).alias("doc_id"), column(text).cast("string").alias("_text"))
    fields = [StructField("n", LongType()), StructField("t", ArrayType(IntegerType())), StructField("f", ArrayType(IntegerType()))]
    return map_texts(own, ["_text"], ["doc_id"], fields, make).filter("n > 0")


def _ranked(plan, key_type, k: int, docs_a_block: int, entries: int):
    """The best k of each query over the rows of a task (q, doc_id, score), an index block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        weight, n_docs, n_terms, asked = plan.value
        best: list[list[tuple]] = [[] for _ in asked]

        def block(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids = table.column("doc_id").combine_chunks()
            order = pc.sort_indices(ids, null_placement="at_end")
            table, ids = table.take(order), ids.take(order).to_pylist()
            n = table.column("n").to_numpy()
            t, f = (table.column(c).combine_chunks() for c in "tf")
            at = np.repeat(np.arange(len(n)), np.diff(t.offsets.to_numpy()))
            t, f = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (t, f))
            norm = (FREE + NORM * n * n_docs // n_terms)[at]
            own = Slices(t, at, weight[t] * (SCALE * f // (TF * f + LENGTH * norm)), len(n))
            for q, query in enumerate(asked):
                where, scores = own.best(own.total(query), k)
                if len(where):
                    new = [(-s, ids[w] is None, ids[w]) for w, s in zip(where.tolist(), scores.tolist(), strict=True)]
                    best[q] = heapq.nsmallest(k, best[q] + new)

        held, n_held, n_entries = [], 0, 0
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(batch.schema.names.index("t"))), 0).to_numpy(zero_copy_only=False)
            first = 0
            for i, size in enumerate(sizes.tolist()):
                if n_held and (n_held >= docs_a_block or n_entries + size > entries):
                    block([*held, batch.slice(first, i - first)])
                    held, n_held, n_entries, first = [], 0, 0, i
                n_held, n_entries = n_held + 1, n_entries + size
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            block(held)
        for at in range(0, len(best), 4096):
            rows = [(q, x) for q, own in enumerate(best[at : at + 4096], at) for x in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int32()), pa.array([x[2] for _, x in rows], to_arrow_type(key_type)), pa.array([-x[0] for _, x in rows], pa.int64())], names=["q", "doc_id", "score"])

    return run
