"""Texts of PDF pages without a layout service: the show operators of the content streams, in order.

Reads classic and compressed objects, FlateDecode streams, and fonts with a ToUnicode map or a one-byte encoding. Encrypted
files and scanned pages give empty texts. It stands in for a layout engine where only words are compared.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_SHOW = re.compile(rb"/(?P<font>[^\s/]+)\s+[-\d.]+\s+Tf|(?P<array>\[(?:[^\]\\()]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\])\s*TJ|(?P<text>\((?:[^()\\]|\\.|\([^()]*\))*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|(?P<line>T\*|\bTd\b|\bTD\b|\bTm\b|\bET\b)", re.S)
_PIECE = re.compile(rb"\((?:[^()\\]|\\.|\([^()]*\))*\)|<[0-9A-Fa-f\s]*>|-?\d+(?:\.\d+)?", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            inside, first = _stream(body), re.search(rb"/First\s+(\d+)", body)
            if first:
                head = list(map(int, inside[: int(first[1])].split()))
                ends = [*head[3::2], len(inside) - int(first[1])]
                for number, a, b in zip(head[::2], head[1::2], ends, strict=False):
                    found.setdefault(number, inside[int(first[1]) + a : int(first[1]) + b])
    return found


def _stream(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"FlateDecode" not in body[: m.start()]:
        return m[1]
    try:
        return zlib.decompressobj().decompress(m[1])
    except zlib.error:
        return b""


def _string(x: bytes) -> bytes:
    if x[:1] == b"<":
        digits = re.sub(rb"\s", b"", x[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    body = re.sub(rb"\\\r?\n", b"", x[1:-1])
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] in b"01234567" else _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def _unicode_map(cmap: bytes) -> dict[bytes, str]:
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(a.decode())] = bytes.fromhex(b.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for k in range(min(int(b, 16) - int(a, 16) + 1, 65536)):
                out[(int(a, 16) + k).to_bytes(len(a) // 2, "big")] = chr(int(c, 16) + k)
    return out


def _said(x: bytes, known: dict[bytes, str]) -> str:
    if not known:
        return x.decode("cp1252", "replace")
    n = len(next(iter(known)))
    return "".join(known.get(x[i : i + n], "") for i in range(0, len(x), n))


def pages(data: bytes) -> list[str]:
    """The text of each page in order, a line a text position."""
    objects = _objects(data)

    def get(body: bytes, name: bytes) -> bytes:
        """The value of a name in a dictionary: of a reference what it refers to."""
        m = re.search(rb"/" + name + rb"\s*(\d+\s+\d+\s+R|\[[^\]]*\]|<<.*|[^\s/>]+)", body, re.S)
        if not m:
            return b""
        ref = re.fullmatch(_REF, m[1])
        return objects.get(int(ref[1]), b"") if ref else m[1]

    def walk(body: bytes, seen: tuple[int, ...], fonts: bytes) -> Iterator[tuple[bytes, bytes]]:
        fonts = get(body, b"Resources") or fonts
        if re.search(rb"/Type\s*/Pages\b", body):
            for k in _REF.findall(get(body, b"Kids")):
                if int(k) not in seen:
                    yield from walk(objects.get(int(k), b""), (*seen, int(k)), fonts)
        else:
            yield body, fonts

    roots = [b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)]
    listed = list(walk(get(roots[-1], b"Pages"), (), b"")) if roots else [(b, b"") for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]
    out = []
    for body, resources in listed:
        maps = {}
        for name, ref in re.findall(rb"/([^\s/]+)\s+(\d+)\s+\d+\s+R", get(resources, b"Font") if b"/Font" in resources else b""):
            maps[name] = _unicode_map(_stream(get(objects.get(int(ref), b""), b"ToUnicode")))
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        content = b"\n".join(_stream(objects.get(int(k), b"")) for k in _REF.findall(m[1])) if m else b""
        lines, now, known = [], "", {}
        for x in _SHOW.finditer(content):
            if x["font"]:
                known = maps.get(x["font"], {})
            elif x["line"]:
                lines.append(now)
                now = ""
            elif x["array"]:
                for piece in _PIECE.findall(x["array"]):
                    now += _said(_string(piece), known) if piece[:1] in (b"(", b"<") else " " if float(piece) < -200 else ""
            else:
                now += _said(_string(x["text"]), known)
        out.append("\n".join(t for x in (*lines, now) if (t := " ".join(x.split()))))
    return out


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """source_file, page_number (from 1), text of the PDF files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                said = pages(bytes(content))
                yield pd.DataFrame({"source_file": [name] * len(said), "page_number": range(1, len(said) + 1), "text": said})

    return files.mapInPandas(run, "source_file string, page_number int, text string")
