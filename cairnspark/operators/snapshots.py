"""Snapshots of a source tree that are compared from the root down.

A file's digest is that of its content, a directory's that of its children's
names and digests (as sums of hashes, so children may come in any order and be
added up by any number of tasks).  Two snapshots are compared level by level:
only directories whose digests differ are opened, so a second run over a tree in
which little has changed looks at little of it.  What was derived from files
(chunks, postings, embeddings) is then made anew for the changed ones alone.

Paths use ``/`` and have no empty parts but a leading one; a path is a file or a
directory, not both.  Null paths are left out; a null digest is one of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def tree(files: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """parent, name, depth, is_file, digest of all files and directories; the root's is ``''`` in ``''`` at depth 0."""
    parts = F.split(F.col("p"), "/")
    rows = files.where(f"`{path}` is not null").select(F.regexp_replace(path, "^/+", "").alias("p"), F.coalesce(F.col(digest).cast("string"), F.lit("null")).alias("digest"))
    rows = rows.select(
        F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("parent"), F.element_at(parts, -1).alias("name"),
        F.size(parts).alias("depth"), F.lit(True).alias("is_file"), "digest",
    )
    rows = materialize(rows)
    depth = rows.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first().d
    level, found = rows.where(F.col("depth") == depth), rows
    # from the deepest level up: as many steps as a path has parts
    for d in range(depth, 0, -1):
        child = lambda seed: F.sum(F.xxhash64("name", "is_file", "digest", F.lit(seed)).cast("decimal(38,0)")).cast("string")
        above = level.groupBy("parent").agg(F.md5(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), child(1), child(2)).cast("binary")).alias("digest"))
        up = F.split("parent", "/")
        above = above.select(
            F.array_join(F.slice(up, F.lit(1), F.size(up) - 1), "/").alias("parent"), F.element_at(up, -1).alias("name"),
            F.lit(d - 1).alias("depth"), F.lit(False).alias("is_file"), "digest",
        )
        above = materialize(above)
        found = found.unionByName(above)
        level = above.unionByName(rows.where(F.col("depth") == d - 1))
    return materialize(found.select("parent", "name", "depth", "is_file", "digest"))


def changes(old: DataFrame, new: DataFrame, opened: list[int] | None = None) -> DataFrame:
    """path, change (added, removed, modified) of the files that differ between two trees.

    ``opened``, if given, gets the number of nodes that were compared at each level.
    """
    frontier = materialize(old.sparkSession.createDataFrame([("",)], "dir string"))
    found, depth = None, 0
    roots = [t.where("depth = 0 and not is_file").select("digest") for t in (old, new)]
    same = roots[0].intersect(roots[1])
    if not same.isEmpty():
        return old.sparkSession.createDataFrame([], "path string, change string")
    while not frontier.isEmpty():
        depth += 1
        side = lambda t, n: t.where(F.col("depth") == depth).join(frontier, F.col("parent") == F.col("dir"), "left_semi").select("parent", "name", F.struct("is_file", "digest").alias(n))  # noqa: B023, E731
        both = materialize(side(old, "o").join(side(new, "n"), ["parent", "name"], "full_outer"))
        if opened is not None:
            opened.append(both.count())
        differ = both.where("not (o <=> n)").withColumn("path", F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat_ws("/", "parent", "name")))
        was, is_ = F.coalesce(F.col("o.is_file"), F.lit(False)), F.coalesce(F.col("n.is_file"), F.lit(False))
        step = differ.where(was | is_).select("path", F.when(was & is_, "modified").when(is_, "added").otherwise("removed").alias("change"))
        found = step if found is None else found.unionByName(step)
        frontier = materialize(differ.where((F.col("o").isNotNull() & ~F.col("o.is_file")) | (F.col("n").isNotNull() & ~F.col("n.is_file"))).select(F.col("path").alias("dir")))
    return found


def carried_over(derived: DataFrame, diff: DataFrame, files: DataFrame, make: Callable[[DataFrame], DataFrame], path: str = "path") -> DataFrame:
    """``derived`` (rows by path) brought up to date: rows of unchanged files stay, those of
    changed and removed ones go, and ``make`` derives the added and modified files' rows from ``files``."""
    where = F.regexp_replace(path, "^/+", "")
    kept = derived.join(diff.select(F.col("path").alias("__p")), where == F.col("__p"), "left_anti")
    fresh = files.join(diff.where("change != 'removed'").select(F.col("path").alias("__p")), where == F.col("__p"), "left_semi")
    return kept.unionByName(make(fresh).select(*derived.columns))
