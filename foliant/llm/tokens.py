"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes: rows are cut to slices of about SLICE_BYTES, a slice's texts go to the
tokenizer ordered by length in calls of about CALL_BYTES, and a long text is first cut where the
tokenizer's own splitter always begins a new piece, so that the lengths of the parts add up exactly.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField

from foliant.llm.common import map_texts

CALL_BYTES = 1 << 18
PART_CHARS = 1 << 15
#: A single space between an ASCII letter and an ASCII letter: " ?\p{L}+" begins a new piece at it.
SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once a worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _loaded[path] = Tokenizer.from_file(path)
            _loaded[path].no_truncation()
            _loaded[path].no_padding()
    return _loaded[path]


def safe_parts(text: str, part_chars: int = PART_CHARS) -> list[str]:
    """Cuts a text into parts of at least part_chars at safe boundaries; joined, they are the text."""
    parts, at = [], 0
    while len(text) - at > part_chars:
        m = SAFE.search(text, at + part_chars)
        if not m:
            break
        parts.append(text[at : m.start()])
        at = m.start()
    parts.append(text[at:])
    return parts


def lengths(texts: list[str], path: str, part_chars: int = PART_CHARS) -> np.ndarray:
    """Tokens of each text. Only byte-level .json vocabularies have their long texts cut."""
    t = tokenizer(path)
    if path.endswith(".model"):
        return np.array([len(x) for x in t.encode(texts, num_threads=1)], np.int64) if texts else np.zeros(0, np.int64)
    byte_level = "ByteLevel" in str(t.pre_tokenizer) and t.normalizer is None
    parts, of = [], []
    for i, x in enumerate(texts):
        new = safe_parts(x, part_chars) if byte_level else [x]
        parts += new
        of += [i] * len(new)
    n, order, call, size = np.zeros(len(texts), np.int64), sorted(range(len(parts)), key=lambda k: len(parts[k])), [], 0

    def encode() -> None:
        for k, e in zip(call, t.encode_batch_fast([parts[k] for k in call], add_special_tokens=False), strict=True):
            n[of[k]] += len(e)

    for k in order:
        call.append(k)
        size += len(parts[k])
        if size >= CALL_BYTES:
            encode()
            call, size = [], 0
    if call:
        encode()
    return n


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", carry: tuple[str, ...] = ("doc_id",), part_chars: int = PART_CHARS) -> DataFrame:
    """Columns carry of every row, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and tokens; very long ones are cut where no token can cross. Repeated rows stay, with
    equal counts; an empty table gives an empty result; an input column named as a new one gives way to it, and others
    are not read. path must be readable on every machine.
    """

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"

        def work(texts: pa.Array):
            said = texts.fill_null("").to_pylist()
            n = lengths(said, path, part_chars)
            return [len(x.encode()) for x in said], n, n > limit

        return work

    return map_texts(docs, [text], carry, [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())], make)
