"""The seam for text encoders: a function from a list of texts to a matrix, as a column function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Encode = Callable[[list[str]], np.ndarray]


def encoder(load: Callable[[], Encode], dimension: int) -> Callable[[Column], Column]:
    """Column function of an encoder that each worker loads once. Blank text is the zero vector; an
    encoder that gives another dimension than it declares fails."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in parts:
            texts = [t or "" for t in texts]
            full = [i for i, t in enumerate(texts) if t.strip()]
            out = np.zeros((len(texts), dimension))
            if full:
                found = np.asarray(encode([texts[i] for i in full]), dtype=np.float64)
                if found.shape != (len(full), dimension):
                    raise ValueError(f"the encoder gave {found.shape}, not {(len(full), dimension)}")
                out[full] = found
            yield pd.Series(list(out))

    return run


def hash_encoder(dimension: int = 64, seed: int = 0) -> Callable[[Column], Column]:
    """A deterministic stand-in for a model: the mean of hash-seeded vectors of the words."""

    def load() -> Encode:
        known: dict[str, np.ndarray] = {}

        def vector(word: str) -> np.ndarray:
            if word not in known:
                digest = hashlib.sha256(f"{seed}:{word}".encode()).digest()
                known[word] = np.random.default_rng(int.from_bytes(digest[:8], "little")).normal(size=dimension)
            return known[word]

        return lambda texts: np.stack([np.mean([vector(w) for w in t.lower().split()], axis=0) for t in texts])

    return encoder(load, dimension)
