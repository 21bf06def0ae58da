"""The stored vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.operators import vector_index as vi


def clustered(n, dims=12, centres=20, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims)) * 4
    return (c[rng.integers(0, centres, n)] + rng.normal(size=(n, dims))).astype(np.float32)


def frame(spark, x, ids=None):
    rows = [(int(i), None if v is None else [float(a) for a in v]) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def by_hand(x, queries, k, metric, ids=None):
    ids = np.arange(len(x)) if ids is None else np.array(ids)
    x = np.array([np.zeros(12) if v is None else v for v in x], float)
    out = {}
    for i, q in queries.items():
        q = np.array(q, float)
        if metric == "l2":
            score = 1 / (1 + np.linalg.norm(x - q, axis=1))
        else:
            both = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
            score = np.where(both > 0, (x @ q / np.where(both > 0, both, 1) + 1) / 2, 0)
        score = score.round(6)
        out[i] = [(int(ids[j]), score[j]) for j in np.lexsort((ids, -score))[:k]]
    return out


def searched(queries, path, k, **kw):
    out = {}
    for r in vi.search(queries.withColumnRenamed("vec_id", "query_id"), path, k, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def same(got, want):
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert [s for q in sorted(got) for _, s in got[q]] == pytest.approx([s for q in sorted(want) for _, s in want[q]], abs=2e-6)


@pytest.mark.parametrize("metric", ["cosine01", "l2"])
def test_exact_to_the_bound(spark, tmp_path, metric):
    """A third of all vectors are one; others have norm 0, are null, or lie at equal distances."""
    x = clustered(600)
    rows = [*x, *[x[0]] * 300, np.zeros(12), None, -x[0], *[x[5] + np.eye(12)[i] for i in range(12)]]
    data = frame(spark, rows)
    path = str(tmp_path / "index")
    vi.build(data, path, metric, cells=17)
    asked = {i: rows[i] for i in (0, 7, 300, 600)} | {5000: np.zeros(12), 5001: -x[9], 5002: x[5]}
    queries = frame(spark, list(asked.values()), list(asked))
    want = by_hand(rows, asked, 9, metric)
    same(searched(queries, path, 9, first=1), want)


def test_few_probes_find_most(spark, tmp_path):
    """Recall at 10 with 8 of 50 cells, the documented default, and 1 when run to the bound."""
    x = clustered(2500, centres=60, seed=4)
    path = str(tmp_path / "index")
    vi.build(frame(spark, x), path, "l2")
    asked = {i: x[i] + 0.1 for i in range(0, 2500, 50)}
    queries = frame(spark, list(asked.values()), list(asked))
    want = by_hand(x, asked, 10, "l2")
    hit = lambda got: sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) / (10 * len(want))
    assert hit(searched(queries, path, 10, rounds=1)) >= 0.9
    assert hit(searched(queries, path, 10)) == 1


def test_only_probed_folders_are_read(spark, tmp_path):
    x = clustered(2500, centres=60, seed=4)
    path = str(tmp_path / "index")
    vi.build(frame(spark, x), path, "l2")
    place, cells = vi._placement(spark, path), spark.read.parquet(f"{path}/cells")
    radius = np.full(len(place.centroids), -1.0)
    for r in cells.collect():
        radius[r.cell] = r.radius
    one = frame(spark, [x[3]], [3]).select(F.col("vec_id").alias("query_id"), "embedding", F.lit(float("inf")).alias("t"), F.lit(0).alias("done"))
    asked = vi.probes(one, place, radius, 4)
    wanted = [r.cell for r in asked.collect()]
    assert len(wanted) == 4
    found = vi.scanned(asked, vi.stored(spark, path).where(F.col("cell").isin(wanted)), cells.select("cell", "shards"), place, 5, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan


def test_batches_and_deletions(spark, tmp_path):
    x = clustered(400)
    path = str(tmp_path / "index")
    vi.build(frame(spark, x[:200]), path)
    vi.insert(frame(spark, x[200:300], range(200, 300)), path)
    vi.delete(spark.createDataFrame([(i,) for i in [*range(0, 100), 9999, None]], "vec_id long"), path)
    vi.insert(frame(spark, x[300:350], range(0, 50)), path)  # ids of deleted rows, with other vectors
    rows = [*x[100:300], *x[300:350]]
    ids = [*range(100, 300), *range(50)]
    asked = {i: x[i] for i in (0, 150, 310, 399)}
    want = by_hand(rows, asked, 6, "cosine01", ids)
    same(searched(frame(spark, list(asked.values()), list(asked)), path, 6, first=2), want)


def test_empty_and_small_indexes(spark, tmp_path):
    one = frame(spark, [np.ones(12)], [1])
    for name, data, n in (("none", one.limit(0), 0), ("one", one, 1)):
        path = str(tmp_path / name)
        vi.build(data, path)
        assert len(searched(one, path, 5).get(1, [])) == n
        assert searched(one.limit(0), path, 5) == {}
    vi.insert(frame(spark, [np.ones(12)], [2]), str(tmp_path / "none"))
    assert [i for i, _ in searched(one, str(tmp_path / "none"), 5)[1]] == [2]
    with pytest.raises(ValueError):
        vi.build(one, str(tmp_path / "bad"), "dot")


def test_large_cells_are_cut_into_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "SHARD", 50)
    x = clustered(300, centres=2)
    path = str(tmp_path / "index")
    vi.build(frame(spark, x), path, "l2", cells=2)
    load = vi.stored(spark, path).groupBy("cell", "shard").count().collect()
    assert len(load) >= 6 and max(r["count"] for r in load) < 90
    asked = {i: x[i] for i in (0, 9)}
    same(searched(frame(spark, list(asked.values()), list(asked)), path, 60), by_hand(x, asked, 60, "l2"))
