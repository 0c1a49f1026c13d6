"""Text to vector: a deterministic hash vector by default, any batch function by choice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 64-bit FNV-1a and the linear congruential step behind the hash vector.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
LCG_MUL, LCG_ADD = 6364136223846793005, 1442695040888963407


def _seeds(texts: list[str]) -> np.ndarray:
    """Hash of the bytes of each text; the n-th bytes of all texts that have one are taken
    together, longest text first, so no padding is held."""
    data = [t.encode("utf-8") for t in texts]
    size = np.array([len(d) for d in data], np.int64)
    order = np.argsort(-size, kind="stable")
    flat, begin = np.frombuffer(b"".join(data), np.uint8), (np.cumsum(size) - size)[order]
    left = len(data) - np.searchsorted(size[order][::-1], np.arange(size.max(initial=0)), "right")
    h = np.full(len(data), FNV_OFFSET, np.uint64)
    for at, n in enumerate(left.tolist()):
        h[:n] = (h[:n] ^ flat[begin[:n] + at]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def hash_vectors(texts: list[str], dim: int) -> np.ndarray:
    """Unit vectors from a congruential sequence, all rows advanced together."""
    state = _seeds(texts)
    out = np.empty((len(texts), dim))
    with np.errstate(over="ignore"):
        for i in range(dim):
            state = state * np.uint64(LCG_MUL) + np.uint64(LCG_ADD)
            out[:, i] = (state >> np.uint64(33)).astype(np.float64) / float(1 << 31) * 2 - 1
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def embed_column(dim: int, model: Callable[[list[str]], np.ndarray] | None = None):
    """Iterator pandas UDF; a model is loaded once per worker by its closure."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model or (lambda texts: hash_vectors(texts, dim))
        for s in batches:
            vecs = np.asarray(run([x or "" for x in s]), dtype=np.float32)
            yield pd.Series(list(vecs))

    return embed


def reembed(mem: DataFrame, dim: int, model=None, out: str = "emb") -> DataFrame:
    """New vectors for every row with text; a wrong width fails the job."""
    vec = embed_column(dim, model)(F.col("content"))
    rows = mem.where(F.coalesce(F.col("content"), F.lit("")) != "").withColumn(out, vec)
    checked = F.when(F.size(out) == dim, F.col(out)).otherwise(F.raise_error(F.lit("embedding width differs")))
    return rows.withColumn(out, checked)
