"""Snapshots compared from the root down against a comparison of all files."""

import random

import pytest
from pyspark.sql import functions as F

from cairnspark.operators import snapshots as sn


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, hash string").repartition(3)


def by_hand(old, new):
    return sorted((p, "added" if p not in old else "removed" if p not in new else "modified") for p in {*old, *new} if old.get(p, 0) != new.get(p, 0))


def diff(spark, old, new, opened=None):
    return sorted(tuple(r) for r in sn.changes(sn.tree(frame(spark, old)), sn.tree(frame(spark, new)), opened).collect())


@pytest.mark.parametrize("seed", range(3))
def test_changes_by_hand(spark, seed):
    rng = random.Random(seed)
    old = {"/".join([f"d{rng.randrange(3)}" for _ in range(rng.randrange(4))] + [f"f{rng.randrange(9)}.rs"]): str(rng.randrange(5)) for _ in range(60)}
    new = {p: str(rng.randrange(5)) if rng.random() < 0.1 else h for p, h in old.items() if rng.random() > 0.1}
    new |= {f"d0/new/{i}.rs": "1" for i in range(3)}
    assert diff(spark, old, new) == by_hand(old, new)


def test_only_differing_directories_are_opened(spark):
    old = {f"d{a}/e{b}/f{c}.rs": "x" for a in range(8) for b in range(8) for c in range(8)}
    opened = []
    assert diff(spark, old, {**old, "d3/e4/f5.rs": "y"}, opened) == [("d3/e4/f5.rs", "modified")]
    assert opened == [8, 8, 8]
    opened = []
    assert diff(spark, old, dict(old), opened) == [] and opened == []


def test_odd_trees(spark):
    for old, new in (
        ({}, {}), ({}, {"a.rs": "1"}), ({"a/b.rs": "1"}, {}), ({"a": "1"}, {"a/b": "1"}), ({"a/b": "1"}, {"a": "1"}),
        ({"a/b": None, "c": "2"}, {"a/b": "1", "c": "2"}), ({"a/x": "1", "b/x": "2"}, {"a/x": "2", "b/x": "1"}),
    ):
        assert diff(spark, old, new) == by_hand(old, new), (old, new)
    assert diff(spark, {"/src/a": "1"}, {"/src/a": "2"}) == [("src/a", "modified")]


def test_derived_rows_are_made_for_changed_files_alone(spark):
    text = lambda files: spark.createDataFrame(list(files.items()), "path string, content string")
    old = {"a.rs": "x y", "b/c.rs": "z", "b/d.rs": "gone"}
    new = {"a.rs": "x y", "b/c.rs": "z z z", "e.rs": "n"}
    made = []

    def words(files):
        made.extend(r.path for r in files.collect())
        return files.select("path", F.explode(F.split("content", " ")).alias("word"))

    hashed = lambda files: sn.tree(text(files).withColumn("hash", F.md5("content")))
    before = words(text(old))
    made.clear()
    after = sn.carried_over(before, sn.changes(hashed(old), hashed(new)), text(new), words)
    assert sorted(map(tuple, after.collect())) == sorted((p, w) for p, t in new.items() for w in t.split())
    assert sorted(made) == ["b/c.rs", "e.rs"]
