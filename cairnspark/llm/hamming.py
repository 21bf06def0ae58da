"""Exact top-k search over binary codes by incremental multi-index hashing.

The codes are dealt into shards of bounded size by a hash of their id; a shard
keeps one table for each of ``segments`` substrings of the code.  A query is
answered in each shard by growing the search radius of the segments one at a
time: after segments 0..j were searched at radius r (and the rest at r-1), every
code within Hamming distance segments*r + j is among the verified candidates, so
the search stops once the kth verified distance is no larger.  The shards' exact
answers are merged by a bounded top-k.  Queries and shards meet in blocks, a
large block of queries with one shard at a time: a shard's index is built once for
the whole block, so codes are shuffled once for each ``QUERY_ROWS`` queries.  Equal
codes are one entry of a shard's tables, so a code that a third of all rows share
costs one verification.

Ties go to the smaller id; column names may differ in case, extra columns do no harm.  Null ids or codes are neither found nor asked for.
Repeated (id, code) rows count once.  A table with fewer than k codes gives all
of them.  k < 1 or an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick

MOST_PARTS = 8192
K, SEGMENTS, SHARD_ROWS, QUERY_ROWS, LEAST_SHARDS = 10, 4, 262_144, 262_144, 8


def sign_code(vector: Column) -> Column:
    """64-bit code of a vector's signs, first component highest.

    A vector of more than 64 components folds: the code is rotated and xored.
    """

    def step(acc: Column, x: Column) -> Column:
        turned = F.shiftleft(acc, 1).bitwiseOR(F.shiftrightunsigned(acc, 63))
        return turned.bitwiseXOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))

    return F.when(F.size(vector) > 0, F.aggregate(vector, F.lit(0).cast("long"), step))


@lru_cache(maxsize=64)
def flips(width: int, radius: int) -> np.ndarray:
    """All ``width``-bit masks with ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.uint64)


class SegmentIndex:
    """Tables of one shard: distinct codes by each segment's value."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, segments: int = SEGMENTS, bits: int = 64):
        order = np.lexsort((ids, codes))
        ids, codes = ids[order], codes[order]
        fresh = np.ones(len(codes), bool)
        fresh[1:] = (codes[1:] != codes[:-1]) | (ids[1:] != ids[:-1])
        self.ids, codes = ids[fresh], codes[fresh]
        self.codes, first = np.unique(codes, return_index=True)
        self.first = np.append(first, len(codes))
        self.width = [bits * (i + 1) // segments - bits * i // segments for i in range(segments)]
        self.shift = np.cumsum([0, *self.width])[:-1]
        self.rows, self.keys = [], []
        for w, s in zip(self.width, self.shift, strict=True):
            key = (self.codes >> np.uint64(s)) & np.uint64((1 << w) - 1)
            by = np.argsort(key, kind="stable")
            self.rows.append(by)
            self.keys.append(key[by])

    def search(self, query: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest ids and their distances, by (distance, id)."""
        query = np.uint64(query)
        seen = np.zeros(len(self.codes), bool)
        rows = np.empty(0, np.int64)
        dist = np.empty(0, np.int64)
        m = len(self.width)
        for r in range(max(self.width) + 1):
            for j in range(m):
                w, s = self.width[j], self.shift[j]
                if r <= w:
                    probe = ((query >> np.uint64(s)) & np.uint64((1 << w) - 1)) ^ flips(w, r)
                    lo, hi = np.searchsorted(self.keys[j], probe), np.searchsorted(self.keys[j], probe, "right")
                    lo, n = lo[hi > lo], (hi - lo)[hi > lo]
                    at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                    new = self.rows[j][at]
                    new = new[~seen[new]]
                    seen[new] = True
                    rows = np.append(rows, new)
                    dist = np.append(dist, np.bitwise_count(self.codes[new] ^ query).astype(np.int64))
                # every code within m*r + j is verified by now
                have = (self.first[rows + 1] - self.first[rows])[dist <= m * r + j].sum()
                if have >= k or len(rows) == len(self.codes):
                    return self._best(rows, dist, k)
        return self._best(rows, dist, k)

    def _best(self, rows: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.minimum(self.first[rows + 1] - self.first[rows], k)  # ids of one code are sorted: its first k do
        at = np.repeat(self.first[rows] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        ids, dist = self.ids[at], np.repeat(dist, n)
        by = np.lexsort((ids, dist))[:k]
        return ids[by], dist[by]


def topk_hamming(
    codes: DataFrame, queries: DataFrame, k: int = K, segments: int = SEGMENTS, bits: int = 64,
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, vec_id, distance, rank of the k codes nearest to each query.

    ``codes`` and ``queries``: vec_id long, code long.
    """
    codes = pick(codes, vec_id="long", code="long").where("vec_id is not null and code is not null")
    queries = pick(queries, vec_id="long", code="long").where("vec_id is not null and code is not null").distinct()
    shards = max(LEAST_SHARDS, -(-codes.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "code", every(shards).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    right = codes.select("vec_id", "code", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))

    def answer(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(q) and len(c) and k > 0:
            index = SegmentIndex(c.vec_id.to_numpy(np.int64), c.code.to_numpy(np.int64).view(np.uint64), segments, bits)
            for qid, code in zip(q.vec_id, q.code.to_numpy(np.int64).view(np.uint64), strict=True):
                ids, dist = index.search(code, k)
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids, "distance": dist}))
        return pd.concat(out) if out else pd.DataFrame({x: pd.Series([], dtype="int64") for x in ("query_id", "vec_id", "distance")})

    # few rows, much work: a fixed number of partitions, which are not put together again
    parts = min(4 * shards * blocks, MOST_PARTS)
    found = (
        left.repartition(parts, "shard", "block").groupBy("shard", "block")
        .cogroup(right.repartition(parts, "shard", "block").groupBy("shard", "block"))
        .applyInPandas(answer, "query_id long, vec_id long, distance long")
    )
    w = W.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
