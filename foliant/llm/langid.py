"""Language identification by unigram pieces with all segmentations summed.

The pieces are those of a fixed public vocabulary. Each language has a probability for each piece; a word's
probability is the sum over all ways to cut it into pieces, by the forward algorithm over its bytes,
and a text's is the product over its words, since no piece crosses a word. A word is a run of letters with their marks
of any length. The probabilities come from
expectation-maximisation (forward and backward sums) over the words of a bounded sample of labelled
texts: SAMPLE whole texts of each language, those with the least hash. Words are scored once
a batch for all languages, a byte of all words at a time, in logarithms.
"""

from __future__ import annotations

import base64
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField

from foliant.llm.common import column, map_texts, places, resource

SAMPLE = 250
ROUNDS, LEAST = 3, 1e-7
#: Bytes of a piece at most. The longest of a public vocabulary have some hundred, and only those that occur in words are looked for.
PIECE = 1 << 16
#: Words and bytes of words whose scores are kept, and numbers of a table of forward sums (of one word, if that needs more).
CACHED, CACHED_BYTES, TABLE = 200_000, 32 << 20, 1 << 19
#: In how many parts the counted words of the sample come to the driver.
WORD_TASKS = 12
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
_B = 0x9E3779B97F4A7C15


def vocabulary(path: str) -> list[bytes]:
    """All pieces in lower case without the space that begins a word, and every single byte. .tiktoken files or lines of text."""
    raw = resource(path).splitlines()
    pieces = {base64.b64decode(x.split()[0]) for x in raw if x.strip()} if path.endswith(".tiktoken") else set(raw)
    low = {_lower(p).lstrip(b" ") for p in pieces}
    return sorted({p for p in low if 0 < len(p) <= PIECE} | {bytes([b]) for b in range(256)})


def _lower(p: bytes) -> bytes:
    """Parts of characters stay as they are."""
    try:
        return p.decode().lower().encode()
    except UnicodeDecodeError:
        return p


@dataclass
class Model:
    languages: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]]  # of each length: sorted hashes of its pieces, their rows in p
    p: np.ndarray  # pieces x languages


def _hashes(pieces: list[bytes], size: int) -> np.ndarray:
    x = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, size).astype(np.uint64)
    h = np.zeros(len(x), np.uint64)
    for j in range(size):
        h = h * np.uint64(_B) + x[:, j] + np.uint64(1)
    return h


def tables(pieces: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for size in range(1, max(map(len, pieces), default=0) + 1):
        rows = np.array([i for i, p in enumerate(pieces) if len(p) == size], np.int64)
        h = _hashes([pieces[i] for i in rows], size) if len(rows) else np.zeros(0, np.uint64)
        order = np.argsort(h)
        out.append((h[order], rows[order]))
    return out


@dataclass
class Lattice:
    """All places of pieces in some words. A word of n bytes has n + 1 nodes, and a piece goes from one to another."""

    first: np.ndarray  # node at which each word begins
    last: np.ndarray
    start: np.ndarray  # of each piece: nodes, its row in p, its word
    end: np.ndarray
    row: np.ndarray
    word: np.ndarray
    step: np.ndarray  # how many bytes of the word are before its start


def lattice(words: list[bytes], tabs: list[tuple[np.ndarray, np.ndarray]]) -> Lattice:
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size + 1) - size - 1
    x = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), size)
    step = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    left = size[word] - step
    at, h, found = np.arange(len(x)), np.zeros(len(x), np.uint64), []
    for n in range(1, min(len(tabs), int(size.max(initial=0))) + 1):
        more = left[at] >= n
        at, h = at[more], h[more]
        h = h * np.uint64(_B) + x[at + n - 1]
        place = places(tabs[n - 1][0], h)
        have = place >= 0
        found.append((at[have], np.full(int(have.sum()), n), tabs[n - 1][1][place[have]]))
    own, n, row = (np.concatenate(c) for c in zip(*found, strict=True)) if found else np.zeros((3, 0), np.int64)
    start = first[word[own]] + step[own]
    return Lattice(first, first + size, start, start + n, row, word[own], step[own])


def _sums(t: Lattice, logs: np.ndarray, back: bool = False) -> np.ndarray:
    """Of each node the log of the sum over all ways from the begin of its word (back: to its end), for each column of logs."""
    out = np.zeros((int(t.last[-1]) + 1, logs.shape[1]))
    source, to, step = (t.end, t.start, -t.step) if back else (t.start, t.end, t.step + t.end - t.start)
    order = np.lexsort((to, step))
    source, to, row, step = source[order], to[order], t.row[order], step[order]
    new = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))  # each node has a piece of one byte
    edges = np.flatnonzero(np.concatenate(([True], step[new][1:] != step[new][:-1], [True])))
    for a, b in zip(edges, edges[1:], strict=False):
        lo, hi = new[a], new[b] if b < len(new) else len(to)
        x, group = out[source[lo:hi]] + logs[row[lo:hi]], new[a:b] - lo
        top = np.maximum.reduceat(x, group)
        x -= np.repeat(top, np.diff(np.append(group, hi - lo)), axis=0)
        out[to[new[a:b]]] = top + np.log(np.add.reduceat(np.exp(x), group))
    return out


def _logs(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-300))


def batches(words: list[bytes], width: int) -> list[np.ndarray]:
    """Places of words of about one length, whose nodes times width are at most TABLE numbers (or that of one word)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(np.cumsum(size[order] + 1) * width // TABLE)) + 1) if len(words) else []


def word_scores(words: list[bytes], m: Model) -> np.ndarray:
    """Log probability of each word (not empty) in each language."""
    n = len(m.languages)
    out, logs = np.zeros((len(words), n)), _logs(m.p)
    for at in batches(words, n):
        t = lattice([words[k] for k in at], m.tables)
        wide = max(1, TABLE // int(t.last[-1] + 1))
        for g in range(0, n, wide):
            out[at, g : g + wide] = _sums(t, logs[:, g : g + wide])[t.last]
    return out


def fit(counts: dict[str, Counter], pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """Probabilities from word counts of each language. Pieces that occur in no word are left out, but for bytes."""
    languages = sorted(counts)
    words = sorted(set().union(*counts.values())) if counts else []
    have, all_ = np.array([len(p) == 1 for p in pieces], bool), tables(pieces)
    for at in batches(words, 8):
        have[lattice([words[k] for k in at], all_).row] = True
    pieces = [p for p, h in zip(pieces, have, strict=True) if h]
    m = Model(languages, tables(pieces), np.ones((len(pieces), len(languages))))
    sizes = np.array([len(p) for p in pieces], float)
    m.p *= (0.02 ** sizes)[:, None]  # to begin with, a segmentation costs the same for each byte
    for g, language in enumerate(languages):
        own = sorted(counts[language])
        n = np.fromiter((counts[language][w] for w in own), float, len(own))
        for _ in range(rounds if own else 0):
            logs, seen = _logs(m.p[:, g : g + 1]), np.zeros(len(pieces))
            for at in batches(own, 8):
                t = lattice([own[k] for k in at], m.tables)
                f, b = _sums(t, logs)[:, 0], _sums(t, logs, back=True)[:, 0]
                part = np.exp(f[t.start] + logs[t.row, 0] + b[t.end] - f[t.last][t.word]) * n[at][t.word]
                seen += np.bincount(t.row, part, len(pieces))
            new = np.maximum(seen / np.maximum(seen.sum(), 1e-300), LEAST)
            m.p[:, g] = new / new.sum()
    return m


def parts(text: str) -> list[bytes]:
    """Lower-case runs of letters with their marks in UTF-8."""
    return [w.encode() for w in LETTERS.findall(text.lower())]


class Scorer:
    """Scores texts; keeps the scores of at most CACHED words, CACHED_BYTES bytes of words and of scores."""

    def __init__(self, m: Model, cached: int = CACHED):
        self.m, self.cached = m, cached
        self.row: dict[bytes, int] = {}
        self.bytes = 0
        self.known = np.zeros((0, len(m.languages)))

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        said = [parts(t) for t in texts]
        if len(self.row) > min(self.cached, CACHED_BYTES // (8 * max(1, len(self.m.languages)))) or self.bytes > CACHED_BYTES:
            self.row, self.known, self.bytes = {}, self.known[:0], 0
        row, new = self.row, []
        for words in said:
            for w in words:
                if w not in row:
                    row[w] = len(row)
                    new.append(w)
                    self.bytes += len(w)
        if new:
            self.known = np.vstack((self.known, word_scores(new, self.m)))
        best, score = [], []
        for words in said:
            if not words or not self.m.languages:
                best.append("und")
                score.append(0.0)
                continue
            total = self.known[np.fromiter(map(row.__getitem__, words), np.int64, len(words))].sum(0)
            k = int(total.argmax())
            best.append(self.m.languages[k])
            score.append(float(1 / np.exp(np.minimum(total - total[k], 0)).sum()))
        return best, score


def train(docs: DataFrame, path: str, text: str = "text", lang: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Fits to at most sample texts of every language: those with the least hash of the text.

    Rows without a language or a letter don't count. Repeated texts are one. The driver's memory grows with the
    number of languages, of which it holds the word counts of the sample and the probabilities.
    """
    own = docs.select(column(lang).cast("string").alias("g"), column(text).alias("t")).filter(F.col("g").isNotNull() & F.col("t").rlike(r"\p{L}"))
    # the sample is chosen by hashes alone, each once; only then are its texts read
    hashed = own.select("g", F.xxhash64("t").alias("h")).distinct().withColumn("b", F.shiftright("h", 56))
    # of each language only the lowest of 256 ranges of the hash that hold the sample are ordered
    before = F.sum("n").over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    low = hashed.groupBy("g", "b").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < sample)
    low = low.groupBy("g").agg(F.max("b").alias("top"))
    first = hashed.join(F.broadcast(low), "g").filter("b <= top").withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("h"))).filter(F.col("n") <= sample)
    least = first.groupBy("g").agg(F.max("h").alias("h"))
    texts = own.join(F.broadcast(least), "g").filter(F.xxhash64("t") <= F.col("h")).select("g", "t").distinct()
    # words are counted by tasks; the driver sees each word of a language once
    said = map_texts(texts, ["t"], ["g"], [StructField("w", ArrayType(StringType()))], lambda: lambda t: [[[w.decode() for w in parts(x)] for x in t.to_pylist()]])
    counts: dict[str, Counter] = {}
    said = said.select("g", F.explode("w").alias("w")).groupBy("g", "w").agg(F.count("*").alias("n"))
    for g, w, n in said.coalesce(WORD_TASKS).toLocalIterator():  # a job for each partition
        counts.setdefault(g, Counter())[w.encode()] = n
    if not counts:
        return Model([], tables([]), np.zeros((0, 0)))
    return fit({g: c for g, c in counts.items() if c}, vocabulary(path), rounds)


def held_out(key: str):
    return F.coalesce(F.crc32(column(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns carry of every row, lang_pred (und without a letter or a learned language) and score, the posterior under equal priors.

    Null and empty texts are und with score 0; very long ones are read whole; ties go to the first language by name;
    repeated rows stay, and equal texts have equal results; an empty table gives an empty result; an input column named
    as a new one gives way to it, and others are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables, model.p))

    def make():
        score = Scorer(Model(*sent.value))
        return lambda texts: score(texts.fill_null("").to_pylist())

    return map_texts(docs, [text], carry, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], make, slice_bytes=1 << 20)


def language(docs: DataFrame, path: str, text: str = "text", lang: str = "lang", key: str = "doc_id", carry: tuple[str, ...] | None = None, sample: int = SAMPLE) -> DataFrame:
    """Learns from the rows that are not held out (crc32 of the key modulo 5 is not 0) and predicts all: doc_id, held_out, lang_pred, score."""
    model = train(docs.filter(~held_out(key)), path, text, lang, sample)
    own = docs.select(column(key).alias("doc_id"), column(text).alias("_text"), held_out(key).alias("held_out"))
    if carry is None:
        return identify(own, model, "_text", ("doc_id", "held_out"))
    return identify(docs, model, text, carry)
