"""Model services over HTTP, as the interfaces of foliant.sources.providers: embeddings, chat and layout extraction.

They hold an endpoint and a key only, so they can be sent to the tasks that call them; retries are the callers' (with_retries).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.sources import layout
from foliant.sources.providers import TRIES, WAIT_S, Layout, with_retries
from foliant.sources.settings import endpoint as plain


def call(url: str, key: str, body: bytes | None = None, kind: str = "application/json", timeout: float = 60.0) -> tuple[dict, dict]:
    """The JSON that a service returns and its headers in lower case. An answer other than 2xx raises OSError with what it says."""
    headers = {"api-key": key, "Authorization": f"Bearer {key}", **({"Content-Type": kind} if body is not None else {})}
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as got:  # noqa: S310
            said = got.read()
            return json.loads(said) if said.strip() else {}, {k.lower(): v for k, v in got.headers.items()}
    except urllib.error.HTTPError as e:
        raise OSError(f"{e.code}: {e.read()[:500].decode(errors='replace')}") from e


@dataclass
class HttpEmbedder:
    """Vectors of a batch of texts, in the order of the texts whatever that of the response."""

    endpoint: str
    key: str
    model: str

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        said, _ = call(f"{plain(self.endpoint)}/openai/v1/embeddings", self.key, json.dumps({"model": self.model, "input": list(texts)}).encode())
        data = sorted(said.get("data", []), key=lambda x: x["index"])
        if [x["index"] for x in data] != list(range(len(texts))):
            raise ValueError(f"{len(data)} vectors for {len(texts)} texts")
        return [x["embedding"] for x in data]

    def one(self, text: str) -> list[float]:
        """The vector of a question."""
        (vector,) = self.embed([text])
        if not vector:
            raise ValueError("the vector is empty")
        return vector


@dataclass
class HttpChat:
    """Completions, one request a prompt, under the system text of its kind."""

    endpoint: str
    key: str
    model: str
    system: dict[str, str] = field(default_factory=dict)
    temperature: float = 0.0

    def complete(self, kind: str, prompts: Sequence[str]) -> list[str]:
        return [self._one(kind, p) for p in prompts]

    def _one(self, kind: str, prompt: str) -> str:
        messages = [*([{"role": "system", "content": self.system[kind]}] if kind in self.system else []), {"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": messages, "temperature": self.temperature}
        said, _ = call(f"{plain(self.endpoint)}/openai/v1/chat/completions", self.key, json.dumps(body).encode())
        text = ((said.get("choices") or [{}])[0].get("message") or {}).get("content") or ""
        if not text.strip():
            raise ValueError("the completion is empty")
        return text.strip()


@dataclass
class HttpLayout:
    """The layout of a PDF: the service takes the file, names where its result will be, and is asked until it is there."""

    url: str
    key: str
    model: str = "prebuilt-layout"
    every_s: float = 2.0
    most_s: float = 600.0

    def extract(self, name: str, content: bytes) -> str:
        _, headers = call(self.url, self.key, content, "application/pdf")
        where, until = headers["operation-location"], time.monotonic() + self.most_s
        while True:
            said, _ = call(where, self.key)
            status = str(said.get("status", "")).lower()
            if status == "succeeded":
                return json.dumps({"source_file": name, "model_id": self.model, "result": without_private(said["analyzeResult"])}, ensure_ascii=False)
            if status == "failed" or time.monotonic() > until:
                raise OSError(f"{name}: {said.get('error') or status}")
            time.sleep(self.every_s)


def without_private(x):
    """JSON without the members whose names begin with _."""
    if isinstance(x, dict):
        return {k: without_private(v) for k, v in x.items() if not k.startswith("_")}
    return [without_private(v) for v in x] if isinstance(x, list) else x


def extract_layouts(files: DataFrame, provider: Layout, tries: int = TRIES, wait: float = WAIT_S) -> DataFrame:
    """Raw layout documents (foliant.sources.layout.RAW) of PDF files (name, content), one call a file. Those that are done are left out before (not_done)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [with_retries(lambda n=n, c=c: provider.extract(n, bytes(c)), tries, wait) for n, c in zip(frame["name"], frame["content"], strict=True)]
            yield pd.DataFrame({"file": frame["name"], "json": made})

    said = files.select("name", "content").mapInPandas(run, "file string, json string")
    return said.select("file", F.from_json("json", layout.RAW).alias("x")).select("x.*", "file")
