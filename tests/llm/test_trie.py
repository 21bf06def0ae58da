"""The trie of conversations against brute force."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cairnspark.llm import prefix_trie as trie
from cairnspark.llm.common import materialize

SCHEMA = "conv_id long, turn long, role string, text string"


def nodes_by_hand(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(t, key=lambda x: x[0])] for c, t in own.items()}
    nodes = collections.defaultdict(list)
    full = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(full[c]) + 1):
            nodes[full[c][:d]].append(c)
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(c for c in m if full[c] == k))).encode()).hexdigest())
        for k, m in nodes.items()
    )


def nodes_of(conversations, most=None):
    named = materialize(trie.named(trie.rebuilt(trie.turns_of(conversations))))
    out = trie.prefix_nodes(named, most).join(trie.member_digests(trie.members(named)), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    rows = out.collect()
    assert len({bytes(r.node) for r in rows}) == len(rows)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256 or none) for r in rows)


def chats(seed=1):
    """A hot first turn, long shared beginnings, equal conversations, one that is long, nulls, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(260):
        shared = ["system"] + [f"p{k}" for k in range(rng.choice([0, 0, 3, 7]))] if c % 3 else [f"own {c}"]
        texts = shared + [rng.choice("abc") * rng.randrange(4) for _ in range(rng.randrange(6))]
        rows += [(c * 7 % 1000, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)]
    for c in range(2000, 2040):
        rows += [(c, i, "user", f"same {i}") for i in range(4)]
    rows += [(3000, i, "user", f"long {i}") for i in range(120)] + [(3001, i, "user", f"long {i}") for i in range(90)]
    rows += [(-5, 0, "user", "x"), (-100, 0, None, "é😀"), (None, 1, "user", "x"), (50000, None, None, None), (50000, 2, "b", "u"), (50000, 2, "a", "v"), (50000, 1, "user", "x"), (50000, 1, "user", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [None, 5, 30, 200])
def test_nodes_by_hand(spark, most):
    rows = chats()
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("CONV_ID"), F.lit(1).alias("node"), F.lit(2).alias("names")).repartition(3)
    assert nodes_of(df, most) == nodes_by_hand(rows)


def test_no_and_few_conversations(spark):
    assert nodes_of(spark.createDataFrame([], SCHEMA)) == []
    for rows in ([(7, 0, "user", "x" * 1_000_000)], [(None, 0, "user", "x")], [(0, 0, "a", "b"), (1, 0, "a", "b"), (2, 0, "ab", "")]):
        assert nodes_of(spark.createDataFrame(rows, SCHEMA)) == nodes_by_hand(rows)


def test_conversations_without_turns_end_at_the_root(spark):
    """With 3 turns and a base of 2 that gives all 5, nothing is left of the own turns."""
    short = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 3)
    rows = [(short, 0, "user", "gone"), (short, 1, "user", "too")]  # its base does not exist
    got = nodes_of(spark.createDataFrame(rows, SCHEMA))
    assert got == nodes_by_hand(rows) == [(short, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_members_of_a_hot_node(spark, monkeypatch):
    """Ids in several pieces over several tasks are hashed in order."""
    monkeypatch.setattr(trie, "PIECE", 7)
    ends = spark.range(500).select(F.when(F.col("id") % 5 == 0, F.lit(b"b")).otherwise(F.lit(b"a")).alias("node"), F.col("id").alias("conv_id"))
    want = {b: hashlib.sha256(",".join(str(i) for i in range(500) if (i % 5 == 0) == (b == b"b")).encode()).hexdigest() for b in (b"a", b"b")}
    assert {bytes(r.node): r.ends_sha256 for r in trie.member_digests(ends).collect()} == want


def test_oversized_parts_are_taken_apart(spark):
    named = materialize(trie.named(trie.rebuilt(trie.turns_of(spark.createDataFrame(chats(), SCHEMA)))))
    paths = named.groupBy("names").agg(F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    rows, _ = trie.parts(materialize(paths), 30)
    load = rows.groupBy("part").agg(F.sum(trie.size_of("names") - F.col("depth") + 1).alias("turns"), F.max("depth").alias("depth")).collect()
    assert max(r.turns for r in load) <= 30 and max(r.depth for r in load) > 3
