"""Connectors to language and embedding models, as plain functions over a batch of texts.

No client library is needed: ``chat`` takes any ``send(prompt) -> text`` and
adds retries with growing waits; ``hashing_embedder`` is the offline default.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType


def chat(send: Callable[[str], str], max_retries: int = 3, wait: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[str]]:
    """A batch function for ``operators.reports.map_model``."""

    def one(prompt: str) -> str:
        for attempt in range(max_retries):
            try:
                return send(prompt)
            except Exception:
                if attempt + 1 == max_retries:
                    raise
                wait(2.0**attempt)
        return ""

    return lambda prompts: [one(p) for p in prompts]


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[np.ndarray]]:
    """Signed hashed words, unit length; where the signs of all words cancel out, unsigned ones. A text without words is 0."""

    def embed(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 16 & 1 else -1
            if not v.any():
                for w in t.lower().split():
                    v[zlib.crc32(w.encode()) % dim] += 1
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return out

    return embed


class Extractor(Protocol):
    """Finds entities and relations in texts: a list of ``(head, relation, tail)`` for each."""

    def __call__(self, texts: list[str]) -> list[list[tuple[str, str, str]]]: ...


def extract(chunks: DataFrame, extractor: Extractor, text_col: str = "chunk") -> DataFrame:
    """``chunks`` without its text, with ``triples array<struct<h, r, t>>`` by any extractor, in Arrow batches."""
    kept = [f for f in chunks.schema.fields if f.name != text_col]
    schema = StructType([*kept, StructField("triples", ArrayType(StructType([StructField(c, StringType()) for c in "hrt"])))])

    def run(frames):
        for pdf in frames:
            found = extractor(pdf[text_col].fillna("").tolist())
            yield pdf.drop(columns=text_col).assign(triples=[[{"h": h, "r": r, "t": t} for h, r, t in ts] for ts in found])

    return chunks.mapInPandas(run, schema)


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[np.ndarray]], text_col: str = "text", out_col: str = "vector", batch: int = 100) -> DataFrame:
    """``rows`` with ``out_col array<double>``; the embedder sees ``batch`` texts at a time."""
    schema = StructType([*rows.schema.fields, StructField(out_col, ArrayType(DoubleType()))])

    def run(frames):
        for pdf in frames:
            texts = pdf[text_col].fillna("").tolist()
            vectors = [v for at in range(0, len(texts), batch) for v in embedder(texts[at : at + batch])]
            yield pdf.assign(**{out_col: [np.asarray(v, dtype=float).tolist() for v in vectors]})

    return rows.mapInPandas(run, schema)
