"""A stored vector index: an inverted file of cells around centroids.

Centroids are fitted on a bounded sample; every vector is stored in the folder
of its nearest centroid's cell with its distance ``r`` to it, and each batch adds
a row per cell (how many vectors, how far the farthest lies).  A query of
distance d to a centroid is at least |d - r| from a vector with that r, so it
takes cells in order of the least distance they can have, a few more each
round, until the next cell cannot hold anything nearer than its kth vector: the
answer is exact.  With ``rounds=1`` it is approximate.  Queries come in batches
and meet cells in a join on the cell; only the probed cells' folders are read.

A large cell is cut into shards that tasks scan apart, so a vector that a third
of all rows repeat costs nothing but its own scan.  New batches are added with
the same centroids; deletions are a table of ids, which hold for earlier batches.

Distances are Euclidean.  With metric ``cosine01`` vectors are scaled to length 1
first; a vector of norm 0 scores 0, as if opposite to every query.  Scores are
rounded to six digits before they are ordered (score, then id).  A null vector is
one of norm 0, a shorter one is filled up with zeros, null ids are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Rows on which centroids are fitted, at most; cells, at most; rows of a shard.
SAMPLE, MOST_CELLS, SHARD = 100_000, 4_096, 65_536
#: Queries that meet a shard at once.
QUERY_BLOCK = 16_384
_CELLS = "cell int, n long, radius double, shards int, batch int"
#: Scores are equal when their first six digits are.
STEP = 2e-6


def matrix(lists: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """A list column as rows of doubles, filled up with zeros to ``width``."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    width = max(int(n.max(initial=0)), 1) if width is None else width
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    out[row[at < width], at[at < width]] = np.nan_to_num(flat[at < width])
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of norm 0 stay."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean, row by row of both."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k best are, by score and then id."""
    if len(score) > k:
        near = np.flatnonzero(score >= -np.partition(-score, k - 1)[k - 1])
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))


@dataclass(frozen=True)
class Cells:
    """What a task needs to place a vector: centroids by number, and the metric."""

    centroids: np.ndarray
    cosine: bool

    def placed(self, lists: pa.Array) -> np.ndarray:
        x = matrix(lists, self.centroids.shape[1])
        return unit(x) if self.cosine else x


def build(vectors: DataFrame, path: str, metric: str = "cosine01", cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> None:
    """Fit centroids and store all of ``vectors`` (vec_id, embedding, and any other columns) below ``path``.

    By default there are as many cells as the root of the number of vectors.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if metric not in ("cosine01", "l2"):
        raise ValueError(f"metric cosine01 or l2, not {metric}")
    spark = vectors.sparkSession
    known = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    shape = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("width")).first()
    cells = max(1, min(cells or round(shape.n**0.5), MOST_CELLS, shape.n))
    # by hash of the id: the same rows at every run; only hashes are ordered, vectors stay where they are
    h = F.xxhash64("vec_id")
    last = known.select(h.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0] if shape.n > sample else None
    some = known if last is None else known.where(h <= last)
    place = Cells(np.zeros((1, shape.width)), metric == "cosine01")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = place.placed(b.column("embedding"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists], ["x"])

    # by arrays: as a column, a norm inside a lambda is made once a dimension
    rows = some.select("embedding").mapInArrow(filled, "x array<double>")
    centres = [np.zeros(shape.width)]
    if cells > 1:
        fitted = KMeans(k=cells, seed=seed, maxIter=10, initMode="random", featuresCol="f").fit(materialize(rows).select(array_to_vector("x").alias("f")))
        centres = fitted.clusterCenters()
    spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields) + ", r double, batch int, cell int, shard int"
    spark.createDataFrame([(metric, kept)], "metric string, columns string").coalesce(1).write.parquet(f"{path}/about")
    _store(vectors, path, 0)


def _placement(spark: SparkSession, path: str) -> Cells:
    """Centroids reach the driver: their number and length bound them."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    metric = spark.read.parquet(f"{path}/about").first().metric
    return Cells(np.array([r.centroid for r in rows]), metric == "cosine01")


def _store(vectors: DataFrame, path: str, batch: int) -> None:
    spark = vectors.sparkSession
    place = spark.sparkContext.broadcast(_placement(spark, path))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = place.value.centroids
        for b in batches:
            x = place.value.placed(b.column("embedding"))
            cell, r = np.zeros(len(x), np.int32), np.zeros(len(x))
            for i in range(0, len(x), 1024):
                some = x[i : i + 1024]
                cell[i : i + 1024] = near = distances(some, c).argmin(1)
                r[i : i + 1024] = np.linalg.norm(some - c[near], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(r)], [*b.schema.names, "cell", "r"])

    rows = vectors.where("vec_id is not null")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = materialize(rows.mapInArrow(assign, f"{fields}, cell int, r double").withColumn("batch", F.lit(batch)))
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("radius"))
    stats = materialize(stats.withColumn("shards", F.ceil(F.col("n") / SHARD).cast("int")).withColumn("batch", F.lit(batch)))
    # one row a cell, and cells are bounded; a large cell is dealt to several tasks, each sorted by r
    dealt = placed.join(F.broadcast(stats.select("cell", "shards")), "cell").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards").cast("long")).cast("int"))
    dealt.drop("shards").repartition("cell", "shard").sortWithinPartitions("cell", "shard", "r").write.mode("append").partitionBy("cell", "shard").parquet(f"{path}/vectors")
    stats.coalesce(1).write.mode("append").parquet(f"{path}/cells")


def _batches(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/cells").agg(F.coalesce(F.max("batch"), F.lit(0)) + 1).first()[0]


def insert(vectors: DataFrame, path: str) -> None:
    """Add rows; ids that are there already must be deleted first."""
    _store(vectors, path, _batches(vectors.sparkSession, path))


def delete(ids: DataFrame, path: str) -> None:
    """``vec_id`` of rows to forget; the same ids can be inserted again."""
    after = _batches(ids.sparkSession, path)
    ids.select("vec_id").where("vec_id is not null").distinct().withColumn("before", F.lit(after)).write.mode("append").parquet(f"{path}/deleted")
    # a row of no cell, so that the next batch has a higher number
    mark = ids.sparkSession.createDataFrame([(-1, 0, 0.0, 0, after)], _CELLS)
    mark.coalesce(1).write.mode("append").parquet(f"{path}/cells")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows, with cell, shard, r and batch, but deleted ones."""
    from pyspark.errors import AnalysisException

    rows = spark.read.schema(spark.read.parquet(f"{path}/about").first().columns).parquet(f"{path}/vectors")
    try:
        gone = spark.read.parquet(f"{path}/deleted")
    except AnalysisException:  # nothing was deleted yet
        return rows
    gone = gone.groupBy(F.col("vec_id").alias("gone")).agg(F.max("before").alias("before"))
    return rows.join(gone, (F.col("vec_id") == F.col("gone")) & (F.col("batch") < F.col("before")), "left_anti")


def _reach(t: np.ndarray, cosine: bool) -> np.ndarray:
    """Beyond this distance no score can equal that of distance ``t`` in six digits."""
    return np.sqrt(t * t + 4 * STEP) if cosine else t + STEP * (1 + t) ** 2


def probes(queries: DataFrame, place: Cells, radius: np.ndarray, step: int) -> DataFrame:
    """query_id, embedding, t, done, cell, d: the next ``step`` cells of each query that may hold one of its k nearest.

    ``queries`` holds query_id, embedding, t (the kth distance so far, or
    infinity) and done (cells that it has probed).  Cells are ordered by the least
    distance that they can have, then by their centroid's.
    """
    shared = queries.sparkSession.sparkContext.broadcast((place, radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, far = shared.value
        used = np.flatnonzero(far >= 0)
        for b in batches:
            q = cells.placed(b.column("embedding"))
            t, done = b.column("t").to_numpy(), b.column("done").to_numpy()
            for lo in range(0, len(q), 256):
                part = slice(lo, lo + 256)
                d = distances(q[part], cells.centroids[used])
                least = np.maximum(d - far[used], 0)
                if cells.cosine:  # of norm 0: as far as can be from everything
                    least[~q[part].any(1)] = 0
                order = np.lexsort((d, least), axis=1)
                row, cell, gap = [], [], []
                for i, by in enumerate(order):
                    some = by[done[lo + i] : done[lo + i] + step]
                    some = some[least[i, some] <= _reach(t[lo + i], cells.cosine)]
                    row.append(np.full(len(some), lo + i))
                    cell.append(used[some])
                    gap.append(d[i, some])
                if not row:
                    continue
                at = pa.array(np.concatenate(row))
                cols = [b.column(c).take(at) for c in ("query_id", "embedding", "t", "done")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(gap))], ["query_id", "embedding", "t", "done", "cell", "d"])

    kind = queries.schema["embedding"].dataType.simpleString()
    return queries.select("query_id", "embedding", "t", "done").mapInArrow(run, f"query_id long, embedding {kind}, t double, done int, cell int, d double")


def scanned(asked: DataFrame, rows: DataFrame, shards: DataFrame, place: Cells, k: int, blocks: int) -> DataFrame:
    """query_id, vec_id, score, distance: each probe's k best; ``shards`` has cell and shards."""
    shared = asked.sparkSession.sparkContext.broadcast(place)

    def answer(q: pa.Table, c: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("distance", pa.float64())])
        out = [kind.empty_table()]
        if q.num_rows and c.num_rows:
            cells = shared.value
            y, ids, r = cells.placed(c.column("embedding")), c.column("vec_id").to_numpy(), c.column("r").to_numpy()
            zero = ~y.any(1)
            x, qid, t, d = cells.placed(q.column("embedding")), q.column("query_id").to_numpy(), q.column("t").to_numpy(), q.column("d").to_numpy()
            for lo in range(0, len(x), 256):
                part = slice(lo, lo + 256)
                # only vectors that the bound leaves for one of these queries
                near = (np.abs(d[part][:, None] - r) <= _reach(t[part], cells.cosine)[:, None] + 1e-9) | ((zero | ~x[part].any(1)[:, None]) & cells.cosine)
                some = np.flatnonzero(near.any(0))
                if not len(some):
                    continue
                if cells.cosine:
                    ok = x[part].any(1)[:, None] & ~zero[some]
                    score = np.where(ok, (np.clip(x[part] @ y[some].T, -1, 1) + 1) / 2, 0)
                    far = np.sqrt(np.maximum(4 * (1 - score), 0))
                else:
                    # term by term: near 0 the short form loses half of its digits
                    far = np.sqrt(np.stack([((y[some] - v) ** 2).sum(1) for v in x[part]]))
                    score = 1 / (1 + far)
                score = score.round(6)
                for i in range(len(score)):
                    best = best_of(score[i], ids[some], k)
                    out.append(pa.table([np.full(len(best), qid[lo + i]), ids[some][best], score[i][best], far[i][best]], schema=kind))
        return pa.concat_tables(out)

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    # one row a cell
    left = asked.join(F.broadcast(shards), "cell").select("query_id", "embedding", "t", "d", "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), block.alias("block"))
    right = rows.select("vec_id", "embedding", "r", "cell", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    key = ("cell", "shard", "block")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(answer, "query_id long, vec_id long, score double, distance double")


def search(queries: DataFrame, path: str, k: int, first: int = 8, rounds: int | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest of every row of ``queries`` (query_id, embedding).

    The first round probes ``first`` cells for a query, each further one twice as
    many as the last.  Without ``rounds`` it goes on until no cell that is left
    can hold a nearer vector; ``rounds=1`` is the usual approximate search.
    """
    spark = queries.sparkSession
    place = _placement(spark, path)
    stats = spark.read.parquet(f"{path}/cells").where("cell >= 0").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("shards").alias("shards"))
    stats = materialize(stats)
    radius = np.full(len(place.centroids), -1.0)
    for r in stats.select("cell", "radius").collect():  # one row a cell
        radius[r.cell] = r.radius
    rows, kept = stored(spark, path), materialize(queries.select("query_id", "embedding"))
    blocks = max(1, -(-kept.count() // QUERY_BLOCK))
    state = kept.select("query_id", "embedding", F.lit(float("inf")).alias("t"), F.lit(0).alias("done"))
    best, step, w = None, first, W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for n in range(rounds or 10**6):
        asked = materialize(probes(state, place, radius, step))
        wanted = [r.cell for r in asked.select("cell").distinct().collect()]  # cells are bounded
        if not wanted and best is not None:
            break
        # a filter on the folders' column: other cells are not listed, let alone read
        found = scanned(asked, rows.where(F.col("cell").isin(wanted)), stats.select("cell", "shards"), place, k, blocks)
        found = found if best is None else found.unionByName(best)
        best = materialize(found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n"))
        if rounds and n + 1 == rounds:
            break
        kth = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).otherwise(float("inf")).alias("t"))
        done = asked.groupBy("query_id").agg((F.max("done") + F.lit(step)).cast("int").alias("done"))
        # a query without further cells is finished
        state = kept.join(done, "query_id").join(kth, "query_id", "left").select("query_id", "embedding", F.coalesce("t", F.lit(float("inf"))).alias("t"), "done")
        step *= 2
    return best.select("query_id", "vec_id", "score", F.row_number().over(w).cast("long").alias("rank"))
