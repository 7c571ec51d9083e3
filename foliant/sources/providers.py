"""Model services behind interfaces. A provider answers a batch of texts; how often it is tried again, and how its answers
meet the rows, is the same for all. The shipped ones need no network: recorded answers, and vectors of hashed words
that stand in for a model and are no reproduction of one."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import packing

TRIES, WAIT_S = 5, 3.0
BATCH_ROWS, BATCH_CHARS = 16, 20_000


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Chat(Protocol):
    def complete(self, kind: str, prompts: Sequence[str]) -> list[str]: ...


class Layout(Protocol):
    def extract(self, name: str, content: bytes) -> str:
        """The layout of a PDF as JSON text."""


def with_retries(call: Callable, tries: int = TRIES, wait: float = WAIT_S, sleep: Callable[[float], None] = time.sleep):
    """What call() returns; after a failure it is tried again, each time after a longer wait."""
    for n in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if n == tries:
                raise
            sleep(wait * n)
    raise ValueError("tries must be 1 or more")


class HashedWords:
    """Unit vectors of signed word hashes."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for w in text.lower().split():
                h = int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "big")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def batches(sizes: Sequence[int], rows: int = BATCH_ROWS, chars: int = BATCH_CHARS) -> Iterator[range]:
    """Runs of rows: a new one where the last is full or would exceed the characters. A larger text is alone."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and (i - first >= rows or total + n > chars):
            yield range(first, i)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield range(first, len(sizes))


def embed(rows: DataFrame, provider: Embedder, text: str = "text", tries: int = TRIES, wait: float = WAIT_S, chars: int = BATCH_CHARS) -> DataFrame:
    """rows whose text is not blank, with vector; a provider that returns another number of vectors, or an empty one, fails."""
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", vector array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = frame[text].tolist()
            vectors: list = []
            for part in batches([len(x) for x in said], chars=chars):
                own = with_retries(lambda part=part: provider.embed([said[i] for i in part]), tries, wait)
                if len(own) != len(part) or not all(len(v) for v in own):
                    raise ValueError(f"{len(own)} vectors for {len(part)} texts")
                vectors += own
            yield frame[names].assign(vector=pd.Series(vectors, index=frame.index, dtype=object))

    return rows.filter(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "") != "").mapInPandas(run, schema)


def asker(provider: Chat, key: str = "question_id", prompt: str = "prompt", question: str = "question", tries: int = TRIES, wait: float = WAIT_S):
    """ask(df, kind): df with response, by the provider; df's prompt if it has one, else its question. An empty answer fails."""

    def ask(df: DataFrame, kind: str) -> DataFrame:
        said = prompt if prompt in df.columns else question
        names = df.columns
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", response string"

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                own = with_retries(lambda frame=frame: provider.complete(kind, frame[said].tolist()), tries, wait) if len(frame) else []
                if len(own) != len(frame) or not all(own):
                    raise ValueError("a response is missing or empty")
                yield frame[names].assign(response=own)

        return df.mapInPandas(run, schema)

    return ask


def recorded(responses: DataFrame, key: str = "question_id"):
    """ask(df, kind) from a table (key, kind, response); a question without a record fails when it is read."""

    def ask(df: DataFrame, kind: str) -> DataFrame:
        own = responses.filter(F.col("kind") == kind).select(key, F.col("response").alias("_r"))
        return df.join(own, key, "left").withColumn("response", F.coalesce("_r", F.raise_error(F.lit(f"no recorded response of kind {kind}")))).drop("_r")

    return ask


def batch_ids(rows: DataFrame, document: str, order: str, text: str = "text", most_rows: int = BATCH_ROWS, chars: int = BATCH_CHARS, ranges: int | None = None) -> DataFrame:
    """rows with batch_id: within a document, in order, a new batch where the last is full or would exceed the characters.

    Every row stays as it is: null is a document of its own, a null order comes first, and rows of one place are in order of
    their lengths and hashes. A null text has no characters. Columns of rows pass through; a batch_id among them gives way. A document may have
    any number of rows (packing.greedy).
    """
    made = packing.greedy(rows, document, [F.col(order), F.col("_size"), F.xxhash64(F.col(text))], F.length(text), most_rows, chars, ranges=ranges)
    return made.withColumn("batch_id", F.col("batch_id").cast("int"))


def fixed_batches(rows: DataFrame, order: str, size: int = 64, by: str | None = None) -> DataFrame:
    """rows with batch_id of size rows each, in order."""
    w = Window.partitionBy(*([by] if by else [])).orderBy(order)
    return rows.withColumn("batch_id", F.floor((F.row_number().over(w) - 1) / size))
