"""Places where a model plugs in: embedders, token counters and span detectors as Arrow-batched functions.

Each hook takes a factory that runs once per Python worker (loading the model) and returns a function over a list of
texts. The defaults are deterministic and need no model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[Sequence[str]], np.ndarray]
_WORD = re.compile(r"\w+")


class _Places(dict):
    """Where a word counts: its place among the `dims` added ones, or behind them among the taken ones. Words met are kept, up to a limit."""

    def __init__(self, dims: int, limit: int = 500_000):
        super().__init__()
        self.dims, self.limit = dims, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = zlib.crc32(word.encode())
        self[word] = at = h % self.dims + (0 if h >> 31 else self.dims)
        return at


def hashed_words(dims: int = 64) -> Embedder:
    """Signed counts of hashed words."""
    places = _Places(dims)

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, text in enumerate(texts):
            words = _WORD.findall(text.lower())
            counts = np.bincount(np.fromiter(map(places.__getitem__, words), np.int64, len(words)), minlength=2 * dims)
            out[i] = counts[:dims] - counts[dims:]
        return out

    return embed


def embedding_udf(factory: Callable[[], Embedder] = hashed_words, batch: int = 256, prefix: str = ""):
    """Unit vectors of texts, `batch` at a time; null stays null, a vector without direction stays zero."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            known = texts.dropna()
            parts = [model([prefix + s for s in known.iloc[i : i + batch]]) for i in range(0, len(known), batch)]
            vectors = np.vstack(parts) if parts else np.zeros((0, 1), np.float32)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = vectors / np.where(norms > 0, norms, 1)
            yield pd.Series(dict(zip(known.index, unit.tolist())), dtype=object).reindex(texts.index).where(texts.notna(), None)

    return embed


def masked_mean(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of token states (batch, tokens, dims) over the tokens that count."""
    weights = mask[..., None].astype(np.float32)
    return (states * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1e-9)


def token_count_udf(factory: Callable[[], Callable[[str], int]] | None = None, specials: int = 0):
    """Tokens of each text plus the special ones; null and empty texts have none."""

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = factory() if factory else (lambda s: len(_WORD.findall(s)))
        for texts in batches:
            yield texts.map(lambda s: counter(s) + specials if s else 0)

    return count
