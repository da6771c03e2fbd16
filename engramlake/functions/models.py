"""Language models behind plain interfaces: text to vector, text to JSON.  Offline stand-ins are deterministic."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH = 100


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float] | None]: ...


class HashEmbedder:
    """Unit vectors from hashed words; no model, but equal texts are equal and shared words bring them closer."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for text in texts:
            v = np.zeros(self.dimensions)
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1 if h >> 63 else -1
            size = np.linalg.norm(v)
            out.append((v / size).tolist() if size else None)
        return out


class HttpError(Exception):
    """An answer with a status that isn't 200."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"status {status}: {message}")
        self.status = status


def may_pass(error: Exception) -> bool:
    """Whether a call may succeed when it is made again: lost connections, too many requests, server errors."""
    return isinstance(error, ConnectionError) or isinstance(error, HttpError) and (error.status == 429 or error.status >= 500)


def with_retry(call: Callable[[], object], retries: int = 5, sleep: Callable[[float], None] = time.sleep):
    """Runs a call again after 1, 2, 4 ... seconds while it fails in a way that may pass."""
    for attempt in range(retries + 1):
        try:
            return call()
        except (ConnectionError, HttpError) as e:
            if attempt == retries or not may_pass(e):
                raise
            sleep(2.0**attempt)


def embed(rows: DataFrame, text: str, embedder: Embedder, target: str = "embedding") -> DataFrame:
    """``rows`` with a vector of a text column, 100 texts a call; a failed call gives nulls."""
    kept = [f for f in rows.schema.fields if f.name != target]
    schema = T.StructType([*kept, T.StructField(target, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH].copy()
                texts = part[text].fillna("").tolist()
                try:
                    part[target] = pd.Series(with_retry(lambda texts=texts: embedder(texts)), index=part.index, dtype=object)
                except Exception:
                    part[target] = None
                yield part[schema.names]

    return rows.select(*[f.name for f in kept]).mapInPandas(run, schema)


def stub_extractor(prompt: str) -> str:
    """An observation that repeats what the prompt says."""
    fields = dict(line.split(": ", 1) for line in prompt.split("\n")[:3] if ": " in line)
    if not fields.get("Tool"):
        return json.dumps({"skip": True})
    return json.dumps({"type": "discovery", "title": f"Used {fields['Tool']}", "narrative": prompt[:200], "facts": [], "concepts": [], "files_read": [], "files_modified": []})


def extract(rows: DataFrame, prompt: str, extractor: Callable[[str], str], target: str = "response") -> DataFrame:
    """``rows`` with a model's answer to a prompt column; a failed call gives null."""
    schema = T.StructType([*rows.schema.fields, T.StructField(target, T.StringType())])

    def one(p: str) -> str | None:
        try:
            return with_retry(lambda: extractor(p or ""))
        except Exception:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{target: batch[prompt].map(one)})

    return rows.mapInPandas(run, schema)
