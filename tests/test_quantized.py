"""Search over scalar codes equals a full scan."""

import numpy as np
import pytest

from cairnspark.operators import quantized as qz


def frame(spark, rows, name="vec_id"):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in rows], f"{name} long, embedding array<float>")


def by_hand(rows, q, k, metric):
    ids = np.array([i for i, _ in rows])
    x = np.zeros((len(rows), 24))
    for j, (_, v) in enumerate(rows):
        if v is not None:
            x[j, : len(v)] = np.float32(v)
    q = np.float32(q).astype(float)
    if metric == "l2":
        s = 1 / (1 + np.linalg.norm(x - q, axis=1))
    else:
        s = x @ q
        if metric == "cosine":
            both = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
            s = np.where(both > 0, s / np.where(both > 0, both, 1), 0)
    s = s.round(6)
    return [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k]]


@pytest.mark.parametrize("metric", qz.METRICS)
def test_equals_a_full_scan(spark, tmp_path, metric):
    """Equal, short, null and zero vectors, ties, and queries of every kind."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24)) * rng.choice([0.01, 1, 30], size=(400, 1))
    rows = [*enumerate(x), *[(1000 + i, x[7]) for i in range(20)], (2000, np.zeros(24)), (2001, None), (2002, x[3][:5]), (2003, np.full(24, 2.0)), (2004, [])]
    asked = [(0, x[0]), (1, x[7]), (2, -x[9] * 5), (3, np.zeros(24)), (4, np.full(24, 2.0))]
    path = str(tmp_path / "codes")
    qz.store(frame(spark, rows), path)
    got = {}
    for r in qz.search(frame(spark, asked, "query_id"), path, 9, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for i, q in asked:
        want = by_hand(rows, q, 9, metric)
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in want], abs=2e-6)
        assert len({j for j, _ in got[i]} ^ {j for j, _ in want}) <= 2  # where sixth digits differ by the order of sums


def test_few_are_read_in_full(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    path = str(tmp_path / "codes")
    qz.store(frame(spark, enumerate(x)), path)
    left = qz.candidates(spark, x[:3], np.arange(3), path, 5, "cosine").count()
    assert 15 <= left < 3 * 3000 / 50
    size = qz.bytes_read(spark, path)
    assert size["codes"] < 0.7 * size["vectors"]  # 24 numbers are few: 64 bytes against 104


def test_codes_and_their_error():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 24))
    code, low, step, error = qz.encoded(x)
    gap = np.abs(qz.decoded(code, low, step) - x)
    assert (gap <= step[:, None] / 2 + 1e-12).all() and np.allclose(np.linalg.norm(gap, axis=1), error)
    assert qz.encoded(np.ones((2, 3)))[3].tolist() == [0, 0]


def test_empty_stores_and_bad_arguments(spark, tmp_path, monkeypatch):
    one = frame(spark, [(1, np.ones(24))])
    path = str(tmp_path / "codes")
    qz.store(one.limit(0), path)
    asked = frame(spark, [(1, np.ones(24))], "query_id")
    assert qz.search(asked, path, 3).collect() == []
    with pytest.raises(ValueError):
        qz.search(asked, path, 3, "manhattan")
    monkeypatch.setattr(qz, "MOST", 3)
    with pytest.raises(ValueError):
        qz.search(asked, path, 3)
