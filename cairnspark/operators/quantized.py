"""Exact nearest-neighbour search over scalar codes.

A vector is stored beside itself as one byte a dimension, between its least and
its greatest value, with the length of what the code leaves out.  A query first
meets the codes alone: the score of a code, give or take the query's length times
that error, bounds the true score from both sides.  Only vectors whose upper
bound reaches the kth best lower bound are read in full and scored, so the
answer is that of a full scan, from about a quarter of the bytes (floats) or an
eighth (doubles).

Metrics are ``dot``, ``l2`` (as 1 / (1 + distance)) and ``cosine``; scores are
rounded to six digits before they are ordered, ties go by id.  A null vector has
no values, a shorter one counts as filled up with zeros, null ids are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from ..sources.tables import spread
from .vector_index import matrix

CODES = "vec_id long, code binary, low double, step double, error double, norm double"
METRICS = ("dot", "l2", "cosine")
#: Half of the last digit of a score, and what sums in another order may change.
SLACK = 1e-6
#: Queries and vectors that meet at once: a task holds a few arrays of the one by the other.
QUERY_BLOCK, AT_ONCE = 512, 1_024


def encoded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, least values, steps, and lengths of what they leave out, of rows."""
    low, high = x.min(1), x.max(1)
    step = np.where(high > low, (high - low) / 255, 0)
    code = np.where(step[:, None] > 0, np.rint((x - low[:, None]) / np.where(step > 0, step, 1)[:, None]), 0).astype(np.uint8)
    return code, low, step, np.linalg.norm(x - decoded(code, low, step), axis=1)


def decoded(code: np.ndarray, low: np.ndarray, step: np.ndarray) -> np.ndarray:
    return low[:, None] + code * step[:, None]


def store(vectors: DataFrame, path: str) -> None:
    """Codes and full vectors (vec_id, embedding), each sorted by id in files of id ranges."""
    known = vectors.where("vec_id is not null").select("vec_id", "embedding")
    width = known.agg(F.greatest(F.coalesce(F.max(F.size("embedding")), F.lit(1)), F.lit(1)).alias("n")).first().n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("embedding"), width)
            code, *parts = encoded(x)
            cols = [pa.array([r.tobytes() for r in code], pa.binary()), *map(pa.array, parts), pa.array(np.linalg.norm(x, axis=1))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), *cols], ["vec_id", "code", "low", "step", "error", "norm"])

    rows = materialize(known.repartitionByRange("vec_id").sortWithinPartitions("vec_id"))
    rows.mapInArrow(run, CODES).write.parquet(f"{path}/codes")
    rows.write.parquet(f"{path}/vectors")


def _bounds(q: np.ndarray, codes: np.ndarray, error: np.ndarray, norm: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of every score; queries by rows."""
    size = np.linalg.norm(q, axis=1)[:, None]
    if metric == "l2":
        far = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (codes * codes).sum(1) - 2 * (q @ codes.T), 0))
        return 1 / (1 + far + error + SLACK), 1 / (1 + np.maximum(far - error - SLACK, 0))
    about, off = q @ codes.T, size * error
    if metric == "dot":
        return about - off, about + off
    both = size * norm
    safe = np.where(both > 0, both, 1)
    return np.where(both > 0, (about - off) / safe, 0), np.where(both > 0, (about + off) / safe, 0)


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """True scores of pairs of rows."""
    if metric == "l2":
        return 1 / (1 + np.sqrt(((q - x) ** 2).sum(1)))
    dot = (q * x).sum(1)
    if metric == "dot":
        return dot
    both = np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1)
    return np.where(both > 0, dot / np.where(both > 0, both, 1), 0)


def candidates(spark: SparkSession, queries: np.ndarray, ids: np.ndarray, path: str, k: int, metric: str) -> DataFrame:
    """query_id, vec_id of what the bounds leave: a scan of the codes alone."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}, not {metric}")
    shared = spark.sparkContext.broadcast((queries, ids))
    kind = "query_id long, vec_id long, low_bound double, high_bound double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, names = shared.value
        # the kth best lower bound that the task has seen: nothing below it can be an answer
        best = np.full((len(every), k), -np.inf)
        for whole in batches:
            for at_once in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(at_once, AT_ONCE)
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                low, step, error, norm = (b.column(c).to_numpy() for c in ("low", "step", "error", "norm"))
                x = decoded(code, low, step)
                for first in range(0, len(every), QUERY_BLOCK):
                    block = slice(first, first + QUERY_BLOCK)
                    q = np.zeros((len(every[block]), x.shape[1]))
                    q[:, : min(q.shape[1], every.shape[1])] = every[block, : q.shape[1]]
                    lo, hi = _bounds(q, x, error, norm, metric)
                    best[block] = -np.sort(-np.concatenate([best[block], lo], axis=1), axis=1)[:, :k]
                    row, at = np.nonzero(hi >= best[block, -1:] - 2 * SLACK)
                    yield pa.RecordBatch.from_arrays([pa.array(names[block][row]), b.column("vec_id").take(pa.array(at)), pa.array(lo[row, at]), pa.array(hi[row, at])], ["query_id", "vec_id", "low_bound", "high_bound"])

    # codes are small and each meets every query: they are dealt to all cores
    found = materialize(spread(spark.read.schema(CODES).parquet(f"{path}/codes")).mapInArrow(run, kind))
    w = W.partitionBy("query_id").orderBy(F.desc("low_bound"))
    kth = found.withColumn("n", F.row_number().over(w)).where(F.col("n") == k).select("query_id", F.col("low_bound").alias("kth"))
    return found.join(F.broadcast(kth), "query_id", "left").where(f"kth is null or high_bound >= kth - {2 * SLACK}").select("query_id", "vec_id")


#: Queries that are broadcast at once: so many floats.
MOST = 4_000_000


def search(queries: DataFrame, path: str, k: int, metric: str = "cosine") -> DataFrame:
    """query_id, vec_id, score, rank of every row of ``queries`` (query_id, embedding).

    A stated set of queries: it is broadcast, and more than ``MOST`` numbers raise.
    """
    spark = queries.sparkSession
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("w")).first()
    if size.n * size.w > MOST:
        raise ValueError(f"{size.n} queries are too many for one scan; search in parts or by vector_index")
    asked = queries.select("query_id", "embedding").toArrow()
    q, ids = matrix(asked.column("embedding"), max(size.w, 1)), asked.column("query_id").to_numpy()
    left = materialize(candidates(spark, q, ids, path, max(k, 1), metric))
    shared = spark.sparkContext.broadcast((q, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, names = shared.value
        at = {n: i for i, n in enumerate(names.tolist())}
        for b in batches:
            x = matrix(b.column("embedding"))
            width = max(x.shape[1], every.shape[1])
            x, mine = np.pad(x, ((0, 0), (0, width - x.shape[1]))), np.pad(every[[at[n] for n in b.column("query_id").to_pylist()]], ((0, 0), (0, width - every.shape[1])))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec_id"), pa.array(_scores(mine, x, metric).round(6))], ["query_id", "vec_id", "score"])

    full = spark.read.parquet(f"{path}/vectors").join(left, "vec_id").select("query_id", "vec_id", "embedding")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = full.mapInArrow(run, "query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(w).cast("long"))
    return out.where(F.col("rank") <= k)


def bytes_read(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of the codes and of the full vectors in the store, as arrays: what the first pass reads and what it spares."""
    codes = spark.read.schema(CODES).parquet(f"{path}/codes").agg(F.coalesce(F.sum(F.octet_length("code") + 40), F.lit(0)).alias("n")).first().n
    full = spark.read.parquet(f"{path}/vectors")
    width = 8 if full.schema["embedding"].dataType.elementType.simpleString() == "double" else 4
    return {"codes": codes, "vectors": full.agg(F.coalesce(F.sum(F.size("embedding") * width + 8), F.lit(0)).alias("n")).first().n}
