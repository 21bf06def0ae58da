"""Embedding: the deterministic keyword embedding, and the seam for others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIM, SPAN, GROUP_WEIGHT, WAVE, WAVE_STEP = 384, 30, 0.8, 0.2, 0.1
HASH_CHARS, HASH_MOD, HASH_DIVISOR, FILL_STEP, FILL_WEIGHT = 100, 1000, 10_000.0, 0.001, 0.1

# The keyword groups, each with its first dimension.
KEYWORDS = {
    0: ["embedding", "embed", "vector", "dimension", "similarity"],
    30: ["vector_store", "vectorstore", "collection", "search", "insert"],
    60: ["handler", "handle", "request", "response", "route"],
    90: ["cache", "moka", "redis", "ttl", "expire"],
    120: ["container", "dependency", "inject", "di", "bootstrap"],
    150: ["error", "result", "anyhow", "thiserror", "fail"],
    180: ["chunk", "split", "parse", "ast", "tree_sitter"],
    210: ["provider", "trait", "impl", "async_trait"],
    240: ["config", "configuration", "setting", "environment"],
    270: ["test", "mock", "assert", "expect", "verify"],
}


def keyword_embedding(text: Column) -> Column:
    """array<double> of DIM components at length 1.

    Each group of words found lifts its 30 dimensions along a sine; what is then
    still 0 gets a small value from the first characters' code points.
    """
    points = F.transform(F.split(F.substring(text, 1, HASH_CHARS), ""), F.ascii)
    total = F.aggregate(points, F.lit(0).cast("long"), lambda a, x: a + x)
    base = F.pmod(total, F.lit(HASH_MOD)) / F.lit(HASH_DIVISOR)

    return _expanded(F.lower(text), base)


@F.arrow_udf(ArrayType(DoubleType()))  # no text: a session need not be there yet
def _expanded(low: pa.Array, base: pa.Array) -> pa.Array:
    """The vectors of lower-cased texts and their base values: a batch's dimensions are made at once."""
    at = np.arange(DIM)
    wave, fill = WAVE * np.sin(WAVE_STEP * (at % SPAN)), FILL_WEIGHT * np.abs(np.sin(FILL_STEP * at))
    b = base.to_numpy(zero_copy_only=False).astype(np.float64)
    group = np.zeros((len(b), -(-DIM // SPAN)))
    for i, t in enumerate(low.to_pylist()):
        group[i, : len(KEYWORDS)] = [GROUP_WEIGHT * sum(w in t for w in ws) / len(ws) for ws in KEYWORDS.values()] if t else 0
    a = group[:, at // SPAN]
    lifted = np.clip(a + wave, 0.0, 1.0)
    x = np.where((a > 0) & (lifted != 0), lifted, b[:, None] + fill)
    # summed in the order of the dimensions
    size = np.sqrt(np.cumsum(x * x, axis=1)[:, -1:])
    x = np.divide(x, size, out=x, where=size > 0)
    offsets = pa.array(np.arange(len(b) + 1, dtype=np.int32) * DIM)
    return pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), mask=np.repeat(np.isnan(b), DIM)))


def embed_with(df: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "content") -> DataFrame:
    """``df`` and ``embedding`` from any model, called once a batch in the executors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model(b.fillna("").tolist()))

    return df.withColumn("embedding", run(F.col(text)))
