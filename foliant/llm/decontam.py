"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of a benchmark item, or all words of a shorter item. Of the
K-word grams of each WINDOW consecutive words the one with the least hash is a fingerprint, so a
document that shares a window shares the fingerprint of it. Fingerprints are joined in numpy against
those of the benchmark, which is read in blocks of at most BLOCK_BYTES (measured before anything is
sent); hits are extended to all windows around them and compared word by word. Items shorter than a window,
for which winnowing promises nothing, are looked up at every position by a hash of their own length. A
benchmark of several blocks is a pass over the texts for each, of which only the hits are kept; they meet their rows
by a 128-bit hash of the text at the end.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField

from foliant.llm.common import Words, checkpointed, column, grams, map_texts, places, slices

WINDOW, K = 10, 5
BLOCK_BYTES = 16 << 20
#: A word as columns count it: what ALNUM says.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def winnowed(words: np.ndarray, of: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The grams of k words, and which of them are fingerprints: the leftmost least of each window that is within one text."""
    g, w = grams(words, k), window - k + 1
    n = len(g) - w + 1
    if n <= 0:
        return g, np.zeros(0, np.int64)
    best, least = np.arange(n), g[:n].copy()
    for j in range(1, w):
        less = g[j : j + n] < least
        least[less] = g[j : j + n][less]
        best[less] = np.flatnonzero(less) + j
    return g, np.unique(best[of[:n] == of[window - 1 : window - 1 + n]])


class Index:
    """Windows of some benchmark items, by length: sorted hashes and the first word of each. Arrays only, a few bytes a byte of text."""

    def __init__(self, ids: list, texts: pa.Array, window: int = WINDOW, k: int = K):
        self.window, self.k, self.ids = window, k, ids
        said, ends, of, prints, by = [], [np.zeros(1, np.int64)], [], [np.zeros(0, np.uint64)], {}
        n_said = n_words = first = 0
        sized = pa.RecordBatch.from_arrays([texts], names=["t"])
        for part in slices(sized, 0, 1 << 20):
            w = Words(part.column(0))
            size = w.end - w.start
            end = np.cumsum(size + 1)  # each word and a space
            flat = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
            inside = np.repeat(end - size - 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            flat[inside] = w.x[np.repeat(w.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            g, at = winnowed(w.hash, w.of, window, k)
            prints.append(np.unique(g[at]))
            n = w.counts()
            begin = np.cumsum(n) - n
            for m in np.unique(np.minimum(n[n > 0], window)).tolist():
                if m == window:
                    at = np.arange(max(0, len(w.hash) - m + 1))
                    at = at[w.of[at] == w.of[at + m - 1]]
                else:
                    at = begin[n == m]
                by.setdefault(m, []).append((grams(w.hash, m)[at], (at + n_words).astype(np.uint32)))
            said.append(flat)
            ends.append(end + n_said)
            of.append((w.of + first).astype(np.uint32))
            n_said, n_words, first = n_said + len(flat), n_words + len(size), first + part.num_rows
        self.said = np.concatenate(said) if said else np.zeros(0, np.uint8)
        self.ends = np.concatenate(ends).astype(np.uint32)
        self.of = np.concatenate(of) if of else np.zeros(0, np.uint32)
        self.prints = np.unique(np.concatenate(prints))
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in list(by):
            h, at = (np.concatenate(x) for x in zip(*by.pop(m), strict=True))
            order = np.lexsort((self.of[at], h))
            h, at = h[order], at[order]
            keep = np.ones(len(h), bool)  # a window that an item repeats is one
            for i in np.flatnonzero((h[1:] == h[:-1]) & (self.of[at[1:]] == self.of[at[:-1]])).tolist():
                keep[i + 1] = self.words(int(at[i]), m) != self.words(int(at[i + 1]), m)
            self.by[m] = h[keep], at[keep]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.said, self.ends, self.of, self.prints, *(y for z in self.by.values() for y in z)))

    def words(self, i: int, m: int) -> bytes:
        return self.said[int(self.ends[i]) : int(self.ends[i + m]) - 1].tobytes()

    def items(self, h: np.uint64, m: int, said: bytes) -> frozenset[int]:
        """Items that have the window of m words with hash h."""
        table, at = self.by[m]
        a, b = (int(np.searchsorted(table, h, side)) for side in ("left", "right"))
        return frozenset(int(self.of[i]) for i in at[a:b].tolist() if self.words(i, m) == said)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """First word and length of each window that occurs, and the items of each text."""
        found, items = [], [set() for _ in range(w.n_texts)]
        for m, (table, _) in self.by.items():
            h, n = grams(w.hash, m), len(w.hash) - m + 1
            if n <= 0:
                continue
            if m == self.window:
                g, at = winnowed(w.hash, w.of, self.window, self.k)
                at = at[places(self.prints, g[at]) >= 0]
                back = self.window - self.k
                near = np.unique((at[:, None] - np.arange(back + 1)).ravel())  # windows that hold the gram
                near = near[(near >= 0) & (near < n)]
            else:
                near = np.arange(n)
            near = near[w.of[near] == w.of[near + m - 1]]
            near = near[places(table, h[near]) >= 0]
            known: dict[bytes, frozenset[int]] = {}
            for s in near.tolist():
                t = w.said(s, m)
                if t not in known:
                    known[t] = self.items(h[s], m, t)
                if known[t]:
                    found.append((s, m))
                    items[w.of[s]].update(known[t])
        a = np.array(found, np.int64).reshape(-1, 2)
        return a[:, 0], a[:, 1], items


_kept: dict[str, Index] = {}


def index_of(key: str, sent, window: int) -> Index:
    """The index of a block, made once by a worker and kept until it needs another."""
    if key not in _kept:
        ids, texts = sent.value
        _kept.clear()
        _kept[key] = Index([x or "" for x in ids], pa.array(texts, pa.string()), window)
    return _kept[key]


def covered(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes, -1)
    return np.cumsum(edge[:n]) > 0


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    spans: bool = False,
) -> DataFrame:
    """Columns carry of every row, with n_words, n_hit, n_items, items_sha256 and contaminated.

    With spans also hit_spans: first word and end of each run of hit words, by turns. Null and empty
    texts have no words, very long ones are read whole; items without words match nothing; items of one item_id count
    once, those whose id is null as one item with an empty id; without benchmark rows nothing is hit. Repeated rows stay,
    and equal texts have equal results; an empty table gives an empty result. Only text and carry are read, so other columns
    may have any name; a carried column named as a new one gives way to it.
    """
    own = benchmark.select(column(item_id).cast("string").alias("i"), F.coalesce(column(item_text), F.lit("")).alias("t"))
    size = own.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    sc = docs.sparkSession.sparkContext
    result = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()), StructField("items_sha256", StringType()), StructField("contaminated", BooleanType())]
    result += [StructField("hit_spans", ArrayType(LongType()))] * spans

    def block(rows: DataFrame):
        got = rows.toArrow()
        return sc.broadcast((got.column("i").to_pylist(), got.column("t").to_pylist())), uuid.uuid4().hex

    def summary(names: set[str], hits: np.ndarray) -> list:
        n_hit = int(hits.sum())
        return [n_hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n_hit > 0]

    if n_blocks == 1:
        sent, key = block(own)

        def make():
            index = index_of(key, sent, window)

            def work(said: pa.Array):
                w = Words(said)
                starts, sizes, found = index.hits(w)
                n = w.counts()
                first = np.cumsum(n) - n
                hits = covered(starts, sizes, len(w.hash))
                made = [summary({index.ids[i] for i in x}, hits[a : a + m]) for x, a, m in zip(found, first.tolist(), n.tolist(), strict=True)]
                return [n, *(zip(*made, strict=True) if made else [[]] * 4), *([runs(hits, first, n)] * spans)]

            return work

        return map_texts(docs, [text], carry, result, make)

    names = [f.name for f in result]
    ident = F.unhex(F.md5(F.coalesce(column(text), F.lit(""))))
    kept = [c for c in carry if c not in names]
    rows = docs.select(*(column(c).alias(f"c{i}") for i, c in enumerate(kept)), ident.alias("id"), F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    texts, blocks = docs.select(ident.alias("id"), column(text).alias("t")), []
    for b in range(n_blocks):
        sent, key = block(own.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b))

        def make(sent=sent, key=key):
            index = index_of(key, sent, window)

            def work(said: pa.Array):
                w = Words(said)
                starts, sizes, found = index.hits(w)
                n = w.counts()
                return runs(covered(starts, sizes, len(w.hash)), np.cumsum(n) - n, n), [sorted(index.ids[i] for i in x) for x in found]

            return work

        hits = map_texts(texts, ["t"], ["id"], [StructField("hit", ArrayType(LongType())), StructField("items", ArrayType(StringType()))], make)
        blocks.append(checkpointed(hits.filter(F.size("hit") > 0).distinct()))
        sent.destroy()
    both = blocks[0]
    for x in blocks[1:]:
        both = both.union(x)
    both = both.groupBy("id").agg(F.flatten(F.collect_list("hit")).alias("hit"), F.flatten(F.collect_list("items")).alias("items"))

    def total():
        def work(_, hit: pa.Array, items: pa.Array):
            made, own_runs = [], []
            for h, it in zip(hit.to_pylist(), items.to_pylist(), strict=True):
                pair = np.array(h, np.int64).reshape(-1, 2)
                n = int(pair.max(initial=0))
                hits = covered(pair[:, 0], pair[:, 1] - pair[:, 0], n)
                made.append(summary(set(it), hits))
                own_runs += runs(hits, np.zeros(1, np.int64), np.array([n]))
            return [*(zip(*made, strict=True) if made else [[]] * 4), *([own_runs] * spans)]

        return work

    both = checkpointed(map_texts(both.withColumn("t", F.array_join("items", ",")), ["t", "hit", "items"], ["id"], result[1:], total))
    none = {"n_hit": F.lit(0), "n_items": F.lit(0), "items_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "contaminated": F.lit(False), "hit_spans": F.array().cast("array<bigint>")}
    # rows of one text that are many are dealt to several tasks by adaptive execution, since both sides are read as they are
    found = rows.join(both, "id", "left")
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), *(F.col(c) if c == "n_words" else F.coalesce(c, none[c]).alias(c) for c in names))


def runs(hits: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[list[int]]:
    """Begin and end of each run of hit words in each text, by turns."""
    out = []
    for a, m in zip(first.tolist(), n.tolist(), strict=True):
        own = hits[a : a + m]
        if not own.any():
            out.append([])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
        out.append(edge.tolist())
    return out
