"""Vector collections: exact nearest-neighbour search, lookup, removal, listing.

Every order is total (score descending, id ascending), scores are rounded to six
digits before they are ordered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from .vector_index import best_of

#: Score of a vector against a query, by metric; higher is better.
METRICS = {
    "cosine01": lambda x, q: F.when(V.norm(x) * V.norm(q) > 0, (V.cosine(x, q) + 1) / 2).otherwise(F.lit(0.0)),
    "cosine": V.cosine,
    "l2": lambda x, q: 1 / (1 + V.l2(x, q)),
    "dot": V.dot,
}


def top_k(vectors: DataFrame, query: DataFrame | list[float], k: int, metric: str = "cosine01", where: Column | None = None) -> DataFrame:
    """The k best rows of (vec_id, embedding, ...) for one query vector, with ``score``.

    ``query`` is a list or a one-row frame (embedding); a frame of another size
    raises as soon as there is a vector to score.  Sorting is a bounded top-k in
    each task.
    """
    if isinstance(query, DataFrame):
        # one row by construction: the aggregate has no keys
        kind = query.schema["embedding"].dataType
        one = query.select(F.first("embedding").alias("__v"), F.count(F.lit(1)).alias("__n"))
        refused = F.raise_error(F.concat(F.lit("top_k takes one query, not "), F.col("__n").cast("string"))).cast(kind)
        with_query = vectors.join(F.broadcast(one), F.lit(True)).withColumn("__q", F.when(F.col("__n") == 1, F.col("__v")).otherwise(refused)).drop("__v", "__n")
        q = F.col("__q")
    else:
        with_query, q = vectors, F.array(*[F.lit(float(x)) for x in query])
    kept = with_query if where is None else with_query.where(where)
    scored = kept.withColumn("score", F.round(METRICS[metric](F.col("embedding"), q), 6)).drop("__q")
    return scored.orderBy(F.desc("score"), "vec_id").limit(max(k, 0))


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = 262_144, query_rows: int = 16_384) -> DataFrame:
    """query_id, vec_id, score (cosine01), rank for every row of ``queries``.

    Blocks of queries meet shards of vectors; each pair is one matrix product,
    and the shards' exact answers are merged by a bounded window.
    """
    shards = max(8, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "embedding", every(shards).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    right = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block")).withColumn("block", F.col("block").cast("long"))

    def matrix(col: pd.Series, width: int) -> np.ndarray:
        out = np.zeros((len(col), width))
        for i, v in enumerate(col):
            out[i, : len(v)] = v
        return out

    def answer(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})]
        if len(q) and len(c) and k > 0:
            c = c.sort_values("vec_id")
            width = max(max(map(len, q.embedding)), max(map(len, c.embedding)))
            x, ids = matrix(c.embedding, width), c.vec_id.to_numpy()
            size = np.linalg.norm(x, axis=1)
            for i in range(0, len(q), 256):
                y = matrix(q.embedding[i : i + 256], width)
                both = np.linalg.norm(y, axis=1)[:, None] * size
                score = np.where(both > 0, (y @ x.T / np.where(both > 0, both, 1) + 1) / 2, 0).round(6)
                for qid, row in zip(q.vec_id[i : i + 256], score, strict=True):
                    best = best_of(row, ids, k)
                    out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[best], "score": row[best]}))
        return pd.concat(out[1:] or out)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(answer, "query_id long, vec_id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def approximate_top_k(vectors: DataFrame, query: list[float], k: int, bucket: float = 0.5, tables: int = 8, seed: int = 1) -> DataFrame:
    """Approximate L2 neighbours by random projections; columns of ``vectors`` and ``distance``."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.withColumn("features", array_to_vector("embedding"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense(query), k, distCol="distance")
    return near.drop("features", "hashes")


def by_ids(vectors: DataFrame, ids: list[int]) -> DataFrame:
    """Rows with the given ids, score 1."""
    return vectors.where(F.col("vec_id").isin(ids)).withColumn("score", F.lit(1.0))


def without_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids, "vec_id", "left_anti")


def listed(vectors: DataFrame, limit: int) -> DataFrame:
    return vectors.orderBy("vec_id").limit(limit).withColumn("score", F.lit(1.0))
