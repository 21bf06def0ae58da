"""What near clones store."""

import random

from cairnspark.operators import near_clones as nc


def test_only_linked_files_are_stored(spark, monkeypatch):
    """All files were stored as tokens; now those with a link, and the join comes before the tokens are made."""
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(100))
    rows = [(1, text), (2, "before " + text)] + [(i, " ".join(f"x{i}y{j}" for j in range(100))) for i in range(3, 20)]
    seen, keep = [], nc.materialize
    monkeypatch.setattr(nc, "materialize", lambda df: seen.append(df) or keep(df))
    out = nc.near_clones(nc.word_tokens(spark.createDataFrame(rows, "doc_id long, text string")), nc.Limits(min_lines=1)).collect()
    assert [(r.file1, r.file2, r.start1, r.start2, r.n_tokens) for r in out] == [(1, 2, 0, 1, 100)]
    [stored] = [df for df in seen if "raw" in df.columns]
    assert stored.count() == 2
    plan = stored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("xxhash64") < plan.index("LeftSemi")
