"""Dependency graphs: cycles, mutual edges, forbidden edges, nearest owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def cycles(edges: DataFrame) -> DataFrame:
    """Simple cycles of (src, dst), however long, as ``path`` from the smallest node.

    Paths grow by one equi-join a round from their smallest node, so each cycle
    is found once; the frontier holds only nodes that can lie on a cycle.  A
    round is written before the next reads it twice.
    """
    e = core(edges)
    paths = e.where("src < dst").select(F.col("src").alias("root"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"))
    found = e.where("src = dst").select(F.array("src").alias("path"))
    while True:
        step = materialize(paths.join(e, F.col("at") == F.col("src")).where("dst >= root and (dst = root or not array_contains(path, dst))"))
        if step.isEmpty():
            break
        found = found.unionByName(step.where("dst = root").select("path"))
        paths = step.where("dst > root").select("root", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
    return found.select("path", F.size("path").cast("long").alias("length"))


def core(edges: DataFrame) -> DataFrame:
    """Edges that stay after stripping, again and again, nodes without an edge in or out."""
    e = materialize(edges.select("src", "dst").distinct())
    n = e.count()
    while True:
        e = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        e = materialize(e.select("src", "dst"))
        n, before = e.count(), n
        if n == before:
            return e


def components(edges: DataFrame) -> DataFrame:
    """node, component of the nodes that lie on a cycle: strongly connected
    components, named after their smallest node; no path is enumerated.

    Nodes without an edge in or out are trimmed.  Every other node takes the
    smallest node that reaches it; those that have the same one and reach it back
    inside that set are its component, which leaves, and the rest goes on.  A
    round is a join and an aggregate over the edges that are left, written.
    """
    left = core(edges)
    found = None
    while not left.isEmpty():
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        label = _spread(left, materialize(nodes.select("node", F.col("node").alias("label"))))
        inner = left.join(label.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
        inner = materialize(inner.where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("a").alias("label")))
        seen = frontier = materialize(label.where("node = label"))
        while not frontier.isEmpty():
            step = inner.join(frontier.select(F.col("node").alias("src"), "label"), ["src", "label"]).select(F.col("dst").alias("node"), "label").distinct()
            frontier = materialize(step.join(seen, ["node", "label"], "left_anti"))
            seen = seen.unionByName(frontier)
        seen = materialize(seen.select("node", F.col("label").alias("component")))
        found = seen if found is None else found.unionByName(seen)
        for end in ("src", "dst"):
            left = left.join(seen.select(F.col("node").alias(end)), end, "left_anti")
        left = core(left)
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    # a node that reaches nothing but itself is a component only with an edge to itself
    n = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    loops = edges.where("src = dst").select(F.col("src").alias("component"), F.lit(True).alias("loop")).distinct()
    return materialize(found.join(n, "component").join(loops, "component", "left").where("n > 1 or loop").select("node", "component"))


def _spread(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Each node's least label of all nodes that reach it: labels move along edges as long as one gets smaller."""
    changed = label
    while True:
        moved = edges.join(changed.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        both = materialize(label.join(moved, "node", "left").select("node", F.least("label", "new").alias("label"), F.coalesce(F.col("new") < F.col("label"), F.lit(False)).alias("moved")))
        label, changed = both.select("node", "label"), both.where("moved").select("node", "label")
        if changed.isEmpty():
            return label


def shortest_cycles(edges: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """component, path, length: for each strongly connected component a shortest cycle through its smallest node.

    A search in breadth from that node inside its component; of several ways the
    one over the smallest nodes from the end.
    """
    comps = components(edges) if comps is None else comps
    e = edges.select("src", "dst").distinct().join(comps.select(F.col("node").alias("src"), "component"), "src")
    e = materialize(e.join(comps.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").where("c = component").select("component", "src", "dst"))
    # the root is reached again as the end of its cycle
    frontier = materialize(e.where("src = component").groupBy("component", "dst").agg(F.min("src").alias("before")).select("component", F.col("dst").alias("node"), "before", F.lit(1).alias("depth")))
    seen = frontier
    while not frontier.isEmpty():
        done = seen.where("node = component").select("component")
        step = e.join(frontier.select("component", F.col("node").alias("src"), "depth"), ["component", "src"]).groupBy("component", F.col("dst").alias("node")).agg(F.min("src").alias("before"), (F.min("depth") + 1).alias("depth"))
        frontier = materialize(step.join(done, "component", "left_anti").join(seen.select("component", "node"), ["component", "node"], "left_anti").select("component", "node", "before", "depth"))
        seen = seen.unionByName(frontier)
    paths = materialize(seen.where("node = component").select("component", F.col("before").alias("at"), F.array("before").alias("path")))
    closed = paths.where("at = component")
    while True:
        back = seen.select("component", F.col("node").alias("at"), "before")
        paths = materialize(paths.where("at != component").join(back, ["component", "at"]).select("component", F.col("before").alias("at"), F.concat(F.array("before"), "path").alias("path")))
        if paths.isEmpty():
            break
        closed = closed.unionByName(paths.where("at = component"))
    return closed.select("component", "path", F.size("path").cast("long").alias("length"))


def mutual(edges: DataFrame) -> DataFrame:
    """a, b with edges both ways, a < b."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_semi").where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def forbidden(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges that are not allowed."""
    return edges.join(allowed, ["src", "dst"], "left_anti")


def reverse(edges: DataFrame) -> DataFrame:
    """dst, dependents (sorted), n.

    The result's own form: a row holds all that depend on one node.  Duplicates
    go before it is put together; ``dependents`` gives the same as rows.
    """
    return edges.select("src", "dst").distinct().groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("dependents"), F.count("src").alias("n"))


def dependents(edges: DataFrame) -> DataFrame:
    """dst, src, one row each, with ``n``, how many depend on dst: no node is one row, whatever depends on it."""
    e = materialize(edges.select("src", "dst").distinct())
    return e.join(e.groupBy("dst").agg(F.count("src").alias("n")), "dst")


def nearest_ancestor(paths: DataFrame, owners: DataFrame, path: str = "path", owner: str = "owner") -> DataFrame:
    """``paths`` with the longest ``owner`` directory that holds the path, null if none does.

    Each path's own ancestors are joined by equality, not by prefix comparison.
    """
    parts = F.split(F.col(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = paths.select(path, F.explode(up).alias("__a"))
    hit = each.join(owners.select(F.col(owner).alias("__a")).distinct(), "__a").groupBy(path).agg(F.max_by("__a", F.length("__a")).alias(owner))
    return paths.join(hit, path, "left")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """key, change: added, removed or modified."""
    o, n = old.select(key, F.col(digest).alias("__o")), new.select(key, F.col(digest).alias("__n"))
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(F.col("__o") != F.col("__n"), "modified")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).where("change is not null")
