"""Prefix trie of conversations: which of them begin with the same turns, and
what sharing those beginnings saves.

Each different sequence of a conversation's first turns (role, text) is a node,
the empty one is the root.  A node's name is a digest of its turns, chained from
turn to turn, so two conversations share a prefix exactly where their names
agree; texts stay behind once they are digested (128 bits of SHA-256).

How it runs.  A conversation is one row: the names of its prefixes.  Equal
conversations are one row with a count.  Rows are dealt by the digest of their
first turn, and a task builds the tries of its first turns with dictionaries of
children, adding up in postorder.  A first turn with more turns below it than a
task's share is taken apart before: it is counted by aggregates, and its rows
are dealt by the turn after the prefix that all of them share; again and again,
until nothing is oversized.  What was taken apart is a small table of nodes, to
which the totals of the tries below them are added by their common ancestors.

Edge cases.  A null role or text is an empty one; turns are ordered by number,
null first, equal numbers by digest; repeated rows are turns of their own.  Rows
without conv_id belong to no conversation and are left out.  A rebuilt
conversation without turns is a member of the root.  A table without
conversations has no nodes.  Other columns, whatever their names, are not read.
Very long texts do not travel.  A conversation (some 30 bytes a turn) has to fit
a task, as a text has to elsewhere; a node's members need not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, join_few, materialize, pick

#: Bytes of a name; the root's is empty.
NAME = 16
#: Turns of a part that one task takes at most, and the least worth taking apart.
MOST_TURNS, LEAST_TURNS = 100_000, 1_000
#: Ids of one piece of a member list.
PIECE = 50_000
#: Shared beginnings have at most so many turns, less one.
HEADS = 6

ROOT = "cast('' AS binary)"
NODE = "node binary, depth long, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: digests and code points of a conversation's turns in order."""
    t = pick(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null")
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, NAME)
    t = t.select("conv_id", F.struct("turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars")).alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars")))
    return t.groupBy("conv_id").agg(ordered.alias("turns"))


def rebuilt(turns: DataFrame, every: int = 100) -> DataFrame:
    """Conversations that begin with the first turns of another one: of the one with the next lower id divisible by ``every``,
    as many as the crc32 of the own id says (0 to 5), in place of the own ones."""
    heads = turns.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    t = turns.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")).join(heads, "base", "left")
    kind = turns.schema["turns"].dataType
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return t.select("conv_id", F.concat(F.slice(F.coalesce("head", F.array().cast(kind)), F.lit(1), F.col("h")), own).alias("turns"))


def named(turns: DataFrame) -> DataFrame:
    """conv_id, names (of all prefixes, one after the other), chars (code points of each turn)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("turns")
            flat = lists.flatten()
            digests, at = flat.field("digest").to_pylist(), lists.value_lengths().to_pylist()
            names, i = [], 0
            for n in at:
                name, chain = b"", []
                for x in digests[i : i + n]:
                    name = hashlib.sha256(name + x).digest()[:NAME]
                    chain.append(name)
                names.append(b"".join(chain))
                i += n
            offsets = pa.array([0, *pd.Series(at, dtype="int64").cumsum()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(names, pa.binary()), pa.ListArray.from_arrays(offsets, flat.field("chars"))], ["conv_id", "names", "chars"])

    return turns.mapInArrow(run, "conv_id long, names binary, chars array<long>")


def size_of(names: str | Column) -> Column:
    return (F.octet_length(names) / NAME).cast("int")


def name_at(names: str, depth: Column) -> Column:
    """The name of the prefix of so many turns."""
    return F.when(depth == 0, F.expr(ROOT)).otherwise(F.substring(names, ((depth - 1) * NAME + 1).cast("int"), F.lit(NAME)))


#: How many turns the least and the greatest row of a part share, and so all rows between them.
_SHARED = f"""aggregate(if(octet_length(lo) = 0 OR octet_length(hi) = 0, cast(array() AS array<int>), sequence(1, cast(least(octet_length(lo), octet_length(hi)) / {NAME} AS int))),
    0, (n, k) -> if(n = k - 1 AND substring(lo, n * {NAME} + 1, {NAME}) = substring(hi, n * {NAME} + 1, {NAME}), k, n))"""


def parts(paths: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Parts of at most ``most`` turns, and the nodes above them.

    ``paths`` holds names, chars, n (conversations), first (the least of their
    ids).  Parts are its rows with ``part`` (the name at their top), ``depth``
    (of that top) and ``above`` (the least id at the node above).  A round takes
    all oversized parts to their first branching; the first part is the root's.
    """
    rows = paths.select("names", "chars", "n", "first", F.expr(ROOT).alias("part"), F.lit(0).alias("depth"))
    done, spine = [], []
    while True:
        top = F.min_by("chars", "names")
        parted = materialize(
            rows.groupBy("part", "depth").agg(F.min("names").alias("lo"), F.max("names").alias("hi"), top.alias("chars"), F.sum("n").alias("n"), F.min("first").alias("above"))
            .select("*", F.expr(_SHARED).alias("shared"))
        )
        below = join_few(rows, parted.select("part", "shared", "above"), "part").where(size_of("names") > F.col("shared"))
        below = below.select("names", "chars", "n", "first", F.col("part").alias("over"), "shared", "above", name_at("names", F.col("shared") + 1).alias("part"))
        children = materialize(below.groupBy("over", "part").agg(F.sum(size_of("names") - F.col("shared")).alias("turns")))
        kids = children.groupBy(F.col("over").alias("part")).agg(F.count(F.lit(1)).alias("kids"))
        chain = parted.join(kids, "part", "left").select("lo", "chars", "n", "above", "shared", F.coalesce("kids", F.lit(0)).alias("kids"), F.explode(F.sequence("depth", "shared")).alias("depth"))
        spine.append(
            chain.select(
                name_at("lo", F.col("depth")).alias("node"), "depth", F.substring("lo", F.lit(1), F.col("depth") * NAME).alias("names"),
                F.coalesce(F.get("chars", F.col("depth") - 1), F.lit(0)).alias("chars"),
                F.col("n").alias("n_convs"), F.col("above").alias("conv_id"), F.when(F.col("depth") < F.col("shared"), 1).otherwise(F.col("kids")).cast("long").alias("n_children"),
            )
        )
        below = below.select("names", "chars", "n", "first", "part", (F.col("shared") + 1).alias("depth"), "above")
        big = materialize(children.where(F.col("turns") > most).select("part"))
        if big.isEmpty():
            done.append(below)
            break
        # at most one for every ``most`` turns, counted all the same
        done.append(below.join(F.broadcast(big) if big.count() <= FEW_ROWS else big, "part", "left_anti"))
        rows = materialize(join_few(below, big, "part").select("names", "chars", "n", "first", "part", "depth"))
    return _union(done), _union(spine)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of some parts."""
    tops: dict[bytes, int] = {}
    children: list[dict[bytes, int] | None] = []
    name, depth, up, chars, convs, first, parent, parent_conv = ([] for _ in range(8))
    for names, lengths, n, least, top, above in zip(rows.names, rows.chars, rows.n, rows["first"], rows.depth, rows.above, strict=True):
        at, before = tops, -1
        for k in range(top - 1, len(names) // NAME):
            x = names[k * NAME : (k + 1) * NAME]
            i = at.get(x)
            if i is None:
                i = at[x] = len(name)
                children.append(None)
                name.append(x)
                depth.append(k + 1)
                up.append(before)
                chars.append(int(lengths[k]))
                convs.append(0)
                first.append(least)
                parent.append(names[(k - 1) * NAME : k * NAME] if k else b"")
                parent_conv.append(above)
            convs[i] += n
            first[i] = min(first[i], least)
            if k + 1 < len(names) // NAME:
                if children[i] is None:
                    children[i] = {}
                at = children[i]
            before = i
    leaves, saved = [0] * len(name), [(n - 1) * c for n, c in zip(convs, chars, strict=True)]
    for root in tops.values():
        stack = [(root, False)]
        while stack:
            i, ready = stack.pop()
            if not ready and children[i]:
                stack.append((i, True))
                stack.extend((j, False) for j in children[i].values())
                continue
            leaves[i] += not children[i]
            if up[i] >= 0:
                leaves[up[i]] += leaves[i]
                saved[up[i]] += saved[i]
                parent_conv[i] = first[up[i]]
    return pd.DataFrame({
        "node": name, "depth": depth, "parent": parent, "conv_id": first, "parent_conv_id": parent_conv, "n_convs": convs,
        "n_children": [len(c or ()) for c in children], "n_leaves": leaves, "saved_tokens": saved, "top": [i < 0 for i in up],
    })


def prefix_nodes(named_turns: DataFrame, most: int | None = None) -> DataFrame:
    """One row a node, with the columns of ``NODE``; ``named_turns`` comes from ``named`` and is best a written table.

    ``conv_id`` is a node's least member: that conversation's first ``depth`` turns are the node's.
    """
    spark = named_turns.sparkSession
    paths = materialize(named_turns.groupBy("names").agg(F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")))
    total = paths.agg(F.coalesce(F.sum(size_of("names")), F.lit(0)).alias("n")).first().n
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = most or max(LEAST_TURNS, min(MOST_TURNS, total // (2 * shuffles)))
    rows, spine = parts(paths, most)
    buckets = max(shuffles, total // most + 1)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets)))
    low = materialize(rows.groupBy("bucket").applyInPandas(tries, f"{NODE}, top boolean"))
    # what lies below a node of the spine is added to all nodes above it: their names are part of its own
    tops = low.where("top").groupBy(F.col("parent").alias("node")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    spine = materialize(spine)
    own = spine.join(tops, "node", "left").select(
        "names", "depth", (F.coalesce("leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    over = own.select("names", "leaves", "saved", F.explode(F.sequence(F.lit(0), "depth")).alias("k")).select(name_at("names", F.col("k")).alias("node"), "leaves", "saved")
    over = over.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parent = F.when(F.col("depth") > 0, name_at("names", F.col("depth") - 1))
    high = spine.withColumn("parent", parent).join(over, "node")
    high = high.join(spine.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    names = [x.split()[0] for x in NODE.split(", ")]
    return high.select(*[F.col(c).cast("long") if c not in ("node", "parent") else c for c in names]).unionByName(low.select(*names))


def members(named_turns: DataFrame) -> DataFrame:
    """node, conv_id: the node at which each conversation ends."""
    return named_turns.select(name_at("names", size_of("names")).alias("node"), "conv_id")


def member_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: of the members' ids in order, joined by commas.

    Ids are sorted over all tasks, joined in pieces, and a node's pieces are
    hashed as they stream by: SHA-256 goes through them in order.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column("node").dictionary_encode().indices.to_numpy()
            ids = b.column("conv_id").to_pylist()
            out, i = [], 0
            while i < len(ids):
                j = min(i + PIECE, len(ids))
                same = (runs[i:j] == runs[i]).argmin() if runs[j - 1] != runs[i] else j - i
                out.append((i, ids[i], ",".join(map(str, ids[i : i + same]))))
                i += int(same)
            at, least, text = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(at, pa.int64())), pa.array(least, pa.int64()), pa.array(text, pa.string())], ["node", "least", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for b in batches:
            out = []
            for x, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if x == node:
                    h.update(b",")
                else:
                    if h:
                        out.append((node, h.hexdigest()))
                    node, h = x, hashlib.sha256()
                h.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["node", "ends_sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], ["node", "ends_sha256"])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, "node binary, least long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "least").mapInArrow(digests, "node binary, ends_sha256 string")


#: DuckDB has no crc32: byte by byte, then eight shifts.
_CRC = """(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(conv_id::VARCHAR, '')])),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384::BIGINT * (acc & 1)) END))"""
SQL = f"""WITH t AS (
  SELECT conv_id, len(coalesce(text, '')) AS chars, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
 n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS pos FROM t),
 c AS (SELECT conv_id AS c, xor({_CRC}, 4294967295) % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM t)),
 r AS (SELECT c, 0 AS part, pos, x, chars FROM c JOIN n ON n.conv_id = base AND pos <= h UNION ALL SELECT c, 1, pos, x, chars FROM c JOIN n ON n.conv_id = c AND pos > h),
 d AS (SELECT c, x, chars, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM r),
 p AS (SELECT c, 0 AS depth, 0 AS chars, '' AS node FROM c
       UNION ALL SELECT c, depth, chars, sha256(string_agg(x, '') OVER (PARTITION BY c ORDER BY depth)) FROM d),
 nodes AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved FROM p GROUP BY 1, 2),
 up AS (SELECT nodes.node, p.node AS parent FROM nodes JOIN p ON p.c = nodes.conv_id AND p.depth = nodes.depth - 1),
 kids AS (SELECT parent AS node, count(*) AS n_children FROM up GROUP BY 1),
 full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
 below AS (SELECT p.node, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
           FROM full_nodes f JOIN p ON p.c = f.conv_id AND p.depth <= f.depth GROUP BY 1),
 ends AS (SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS e FROM p WHERE depth = (SELECT max(q.depth) FROM p q WHERE q.c = p.c) GROUP BY 1)
SELECT f.conv_id, f.depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM full_nodes f JOIN below USING (node) LEFT JOIN up USING (node) LEFT JOIN nodes o ON o.node = up.parent LEFT JOIN ends ON ends.node = f.node"""
