"""Settings: a JSON file first, then the environment, then the default. A placeholder counts as missing."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any


def is_placeholder(value: Any) -> bool:
    s = str(value or "").strip().lower()
    return not s or s.startswith(("<", "your_", "your-", "replace", "changeme"))


@dataclass(frozen=True)
class Settings:
    retrieval_limit: int = 12
    minimum_top_score: float = 0.45
    max_context_characters: int = 24_000
    max_chunk_characters: int = 2_500
    batch_size: int = 16
    max_batch_characters: int = 20_000
    upsert_batch_size: int = 64
    vector_dimension: int = 3_072
    embedding_endpoint: str = ""
    chat_endpoint: str = ""
    store_url: str = ""


def load(path: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "FOLIANT_") -> Settings:
    """Raises ValueError for a value that is not of its setting's type or not positive where it must be."""
    env = os.environ if env is None else env
    given: dict[str, Any] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    out: dict[str, Any] = {}
    for f in fields(Settings):
        value = next((v for v in (given.get(f.name), env.get(prefix + f.name.upper())) if v is not None and not is_placeholder(v)), f.default)
        try:
            out[f.name] = type(f.default)(value)
        except (TypeError, ValueError) as e:
            raise ValueError(f"{f.name}: {value!r} is no {type(f.default).__name__}") from e
        if isinstance(f.default, int) and out[f.name] <= 0:
            raise ValueError(f"{f.name} must be positive")
    return Settings(**out)


def endpoint(value: str) -> str:
    """An endpoint without a path of its own kind and without slashes at the end."""
    v = value.strip().rstrip("/")
    return v[: -len("/openai/v1")] if v.endswith("/openai/v1") else v
