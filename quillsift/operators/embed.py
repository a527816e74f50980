"""Embeddings in Arrow batches: hashed words and character n-grams, or a sentence model where its library is installed."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS, NGRAM, NGRAM_WEIGHT = 384, 4, 0.35
TOKEN = re.compile("[a-z0-9+#.]+")


@lru_cache(200_000)
def _gram(name: str, dimensions: int) -> tuple[int, bool]:
    """Bucket and sign of a feature."""
    h = hashlib.blake2b(name.encode(), digest_size=8).digest()
    return int.from_bytes(h[:4], "big") % dimensions, bool(h[4] & 1)


class Features(dict):
    """Token -> (buckets, signed weights) of its word and n-grams; tokens that were met are kept, up to a bound.

    A feature's bucket is its hash's first four bytes, its sign a bit of the fifth.
    """

    def __init__(self, dimensions: int = DIMENSIONS, n: int = NGRAM) -> None:
        self.dimensions, self.n = dimensions, n
        self.lists: dict[str, tuple[list[int], list[float]]] = {}

    def listed(self, token: str) -> tuple[list[int], list[float]]:
        """A token's buckets and weights as lists, of which vectors() makes one array for many texts."""
        if found := self.lists.get(token):
            return found
        names = [f"w:{token}"]
        if len(token) > self.n:
            edged = f"^{token}$"
            names += [f"c:{edged[i : i + self.n]}" for i in range(len(edged) - self.n + 1)]
        hashes = [_gram(name, self.dimensions) for name in names]
        found = [b for b, _ in hashes], [(w if plus else -w) for w, (_, plus) in zip([1.0] + [NGRAM_WEIGHT] * (len(names) - 1), hashes, strict=True)]
        if len(self.lists) < 100_000:
            self.lists[token] = found
        return found

    def __missing__(self, token: str) -> tuple[np.ndarray, np.ndarray]:
        features = [(f"w:{token}", 1.0)]
        if len(token) > self.n:
            edged = f"^{token}$"
            features += [(f"c:{edged[i : i + self.n]}", NGRAM_WEIGHT) for i in range(len(edged) - self.n + 1)]
        hashes = [hashlib.blake2b(name.encode(), digest_size=8).digest() for name, _ in features]
        found = np.array([int.from_bytes(h[:4], "big") % self.dimensions for h in hashes]), np.array([w if h[4] & 1 else -w for h, (_, w) in zip(hashes, features, strict=True)])
        if len(self) < 100_000:
            self[token] = found
        return found


def vector(text: str | None, features: Features | None = None) -> np.ndarray:
    """Length 1, or all zeros without tokens."""
    features = Features() if features is None else features
    found = [features[token] for token in TOKEN.findall((text or "").lower())]
    if not found:
        return np.zeros(features.dimensions)
    out = np.bincount(np.concatenate([b for b, _ in found]), np.concatenate([w for _, w in found]), features.dimensions)
    norm = np.sqrt((out**2).sum())
    return out / norm if norm else out


def vectors(tokens: Sequence[Sequence[str]], features: Features) -> np.ndarray:
    """vector() of texts of which the tokens are given, a row each."""
    width, buckets, weights, sizes = features.dimensions, [], [], []
    for own in tokens:
        before = len(buckets)
        for token in own:
            b, w = features.listed(token)
            buckets += b
            weights += w
        sizes.append(len(buckets) - before)
    cells = np.repeat(np.arange(len(tokens)) * width, np.array(sizes, np.int64)) + np.array(buckets, np.int64)
    out = np.bincount(cells, np.array(weights, float), len(tokens) * width).reshape(-1, width)
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1.0)


def hashing(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, embedding) of (id, text)."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(dimensions)
        for batch in batches:
            found = [vector(t.as_py(), features) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["id", "embedding"])

    return rows.select("id", F.col("text").cast("string")).mapInArrow(run, f"id {kind}, embedding array<double>")


def sentence_model(rows: DataFrame, name: str) -> DataFrame:
    """(id, embedding) by a sentence-transformers model, loaded once per worker; by hashing where that isn't installed."""
    import importlib.util

    if importlib.util.find_spec("sentence_transformers") is None:
        return hashing(rows)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name)
        for batch in batches:
            found = model.encode([t.as_py() or "" for t in batch.column(1)], batch_size=32, normalize_embeddings=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([*found.astype(float)], pa.list_(pa.float64()))], ["id", "embedding"])

    return rows.select("id", F.col("text").cast("string")).mapInArrow(run, f"id {kind}, embedding array<double>")
