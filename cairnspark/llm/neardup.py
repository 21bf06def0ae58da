"""MinHash near-dedup with min-max hashing.

A document's set holds its distinct five-word shingles.  Under each of ``PERMS``
permutations both the minimum and the maximum enter the signature, so half the
hash evaluations give a signature of 2 * PERMS values; ``ROWS`` of them make a
band.  With 48 permutations and 4 rows there are 24 bands: a pair at Jaccard
0.75 shares a band with probability 0.9999.

Equal sets are one class, named after its smallest doc_id, before anything is
banded; so copies cost one row each however many there are.  Classes meet in
band buckets.  A bucket's most central member is its pivot and is compared with
the others on full sets (no pairs within the bucket); those it does not reach
take up to two pivots among themselves.  A member still apart from the first
pivot is compared with those others that it can be similar to at all: they share
a shingle that the pivot lacks, or their sizes and their overlaps with the pivot
leave room (_beyond_pivots).  So no link that a bucket offers is lost, and a
large group of near copies never becomes all its pairs.  Components come from
graph.py.

Edge cases.  A text without words, or null, has an empty set and links with
nothing.  One with fewer than five words has one shingle, all its words.  A null
doc_id links with nothing: component_id is null and the row is kept.  Rows of one
doc_id are one document: with several texts it is linked through each of them.
near_duplicates gives each row, without_duplicates one row a kept document.
Column names may differ in case; extra columns do no harm.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_few, materialize, pick, place_of
from .graph import connected_components

SHINGLE, SIMILARITY = 5, 75
PERMS, ROWS, SEED, PIVOTS, COMMON = 48, 4, 77, 3, 16
SLICE = 32_768

_rng = np.random.default_rng(SEED)
_odd = lambda n: _rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
PLACE, MULT, BAND = _odd(SHINGLE), _odd(PERMS), _odd(ROWS)
FLIP = _rng.integers(0, 1 << 63, PERMS, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random value for each byte (none for white space), and the powers of an odd multiplier by place.
BYTE = _odd(256)
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
BYTE[SPACE] = 0
TEXT_SLICE, LONG_WORD = 4_000_000, 65_536
POWER = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(LONG_WORD - 1, _odd(1)[0])]))


def _slice_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased bytes (the sum of BYTE * POWER over a word), and where they start."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[raw], [True]])))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    own = raw[start[0] :]
    place = np.arange(len(own)) - np.repeat(start - start[0], np.diff(np.append(start, len(raw))))
    out = np.add.reduceat(BYTE[own] * POWER[np.minimum(place, LONG_WORD - 1)], start - start[0])
    for i in np.flatnonzero(end - start > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes())
    return mixed(out), start


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased (A-Z) words; long texts are taken in slices that end at white space."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        end = at + TEXT_SLICE
        while end < len(raw) and not SPACE[raw[end]]:
            gap = np.flatnonzero(SPACE[raw[end : end + TEXT_SLICE]])
            end += int(gap[0]) if len(gap) else TEXT_SLICE
        out.append(_slice_hashes(raw[at:end])[0])
        at = end
    return np.concatenate(out)


def words_of_texts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The hashes of the words of runs of texts: the run's first text, the hashes,
    and where each text's begin, with the end."""
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        if t is not None and len(t) > TEXT_SLICE // 4:
            if held:
                yield i - len(held), *_joined_hashes(held)
                held, size = [], 0
            own = word_hashes(t)
            yield i, own, np.array([0, len(own)])
            continue
        held.append((t or "").encode("utf-8", "surrogatepass").lower())
        size += len(held[-1])
        if size >= TEXT_SLICE // 4:
            yield i + 1 - len(held), *_joined_hashes(held)
            held, size = [], 0
    if held:
        yield len(texts) - len(held), *_joined_hashes(held)


def _joined_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    own, start = _slice_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return own, np.searchsorted(start, begin)


def shingles(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all windows of ``width`` words; of all words, if they are fewer."""
    n = min(len(words), width)
    if n == 0:
        return words
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out += words[i : len(words) - n + 1 + i] * PLACE[i]
    return mixed(out)


def min_max(own: np.ndarray) -> np.ndarray:
    """Minima and maxima of a non-empty set under each permutation."""
    low, high = np.full(PERMS, ~np.uint64(0)), np.zeros(PERMS, np.uint64)
    for i in range(0, len(own), SLICE):
        x = (own[i : i + SLICE, None] ^ FLIP) * MULT
        low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(-1, ROWS)
    return mixed((rows * BAND).sum(1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    long = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))
    for b in batches:
        size, one, two, bands = [], [], [], []
        runs = words_of_texts(b.column("text").to_pylist())
        for words in (x[e[k] : e[k + 1]] for _, x, e in runs for k in range(len(e) - 1)):
            own = np.unique(shingles(words))
            size.append(len(own))
            one.append(mixed(own).sum(dtype=np.uint64))
            two.append(mixed(own ^ PLACE[0]).sum(dtype=np.uint64))
            bands.append(band_keys(min_max(own)).view(np.int64) if len(own) else None)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(size, pa.int64()), long(one), long(two), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "one", "two", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, items of (node, one, text), where the text is the one that the sketch saw."""
    for b in batches:
        nodes, items = [], []
        runs = words_of_texts(b.column("text").to_pylist())
        texts = (x[e[k] : e[k + 1]] for _, x, e in runs for k in range(len(e) - 1))
        for node, one, words in zip(b.column("node").to_pylist(), b.column("one").to_pylist(), texts, strict=True):
            own = np.unique(shingles(words))
            if int(mixed(own).sum(dtype=np.uint64, keepdims=True).view(np.int64)[0]) == one:
                nodes.append(node)
                items.append(own.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["node", "items"])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with a_items, a_n, b_items, b_n."""
    s = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"{x}_items"), F.col("n").alias(f"{x}_n"))
    return pairs.join(s("b"), "b").join(s("a"), "a")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """Those of the pairs (a, b) whose full sets (node, items, n) are similar."""
    x = F.size(F.array_intersect("a_items", "b_items"))
    both = _with_sets(pairs, sets).select("a", "b", x.alias("x"), (F.col("a_n") + F.col("b_n")).alias("n"))
    return both.where((100 * F.col("x")) >= percent * (F.col("n") - F.col("x"))).select("a", "b")


def _named(df: DataFrame, parts: DataFrame, node: str, name: str) -> DataFrame:
    """``df`` with the component of a node, itself if it has no link."""
    return df.join(parts.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def _beyond_pivots(near: DataFrame, sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in a group that may be similar.

    ``near``: pivot, node; a group is what shares the pivot.  Let a reference
    hold the pivot's shingles and those that ``COMMON`` or more others of the
    group have, and a node's core be its part of it.  Two nodes either share a
    shingle outside the reference, which fewer than ``COMMON`` nodes have: these
    pairs are met by equality of such shingles.  Or all they share lies in both
    cores, so that cores and sizes decide: nodes of one core and size are one
    class, classes are compared, and a class that is similar to another (or to
    itself) ties all its nodes to that one's first.  Classes meet by equality of
    size, for the few sizes that (100 + percent) * core >= percent * (nx + ny)
    leaves.
    """
    rel = _with_sets(near.select(F.col("pivot").alias("a"), F.col("node").alias("b")), sets).select(
        F.col("a").alias("pivot"), F.col("b").alias("node"), F.col("b_n").alias("n"), F.col("b_items").alias("items"), F.array_except("b_items", "a_items").alias("own")
    )
    rel = _named(_named(rel, parts, "node", "part"), parts, "pivot", "main").withColumn("apart", F.col("part") != F.col("main")).drop("main")
    rel = materialize(rel)
    tok = rel.select("pivot", "node", "part", "apart", F.explode("own").alias("token"))
    held = tok.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("df"), F.min("part").alias("lo"), F.max("part").alias("hi")).where(F.col("df") < COMMON)
    rare = tok.join(held.select("pivot", "token"), ["pivot", "token"]).groupBy("pivot", "node").agg(F.collect_list("token").alias("rare"))
    few = materialize(held.where("lo != hi").select("pivot", "token"))
    tok = materialize(tok.join(few, ["pivot", "token"]))
    y = tok.select("pivot", "token", F.col("node").alias("other"), F.col("part").alias("op"))
    by_token = tok.where("apart").join(y, ["pivot", "token"]).where("node != other and part != op")

    core = F.array_sort(F.array_except("items", F.coalesce("rare", F.array().cast("array<bigint>"))))
    rel = rel.join(rare, ["pivot", "node"], "left").select("pivot", "node", "n", "part", "apart", core.alias("core"))
    rel = materialize(rel.withColumn("kind", F.xxhash64("n", "core")))
    kinds = rel.groupBy("pivot", "kind").agg(
        F.first("n").alias("n"), F.first("core").alias("core"), F.min("node").alias("rep"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.max("apart").alias("apart")
    )
    kinds = materialize(kinds.withColumn("c", F.size("core").cast("long")))
    sizes = kinds.groupBy("pivot").agg(F.collect_set("n").alias("sizes"))
    room = (100 + percent) * F.col("c") - percent * F.col("n")
    fits = lambda s: (percent * s <= room) & (100 * s >= percent * F.col("n")) & (100 * F.col("n") >= percent * s)
    x = kinds.where("apart").join(sizes, "pivot").withColumn("size", F.explode(F.filter("sizes", fits))).drop("sizes")
    y = kinds.select("pivot", F.col("n").alias("size"), *[F.col(k).alias(f"y_{k}") for k in ("kind", "core", "rep", "lo", "hi", "c")])
    met = x.join(y, ["pivot", "size"]).where("lo != hi or y_lo != y_hi or lo != y_lo")
    met = met.where((100 + percent) * F.col("y_c") >= percent * (F.col("n") + F.col("size")))
    met = met.where((100 + percent) * F.size(F.array_intersect("core", "y_core")) >= percent * (F.col("n") + F.col("size")))
    met = materialize(met.select("pivot", "kind", "rep", "y_kind", "y_rep"))
    partner = met.select("pivot", "kind", F.col("y_rep").alias("to")).unionByName(met.select("pivot", F.col("y_kind").alias("kind"), F.col("rep").alias("to")))
    ties = rel.join(partner.groupBy("pivot", "kind").agg(F.min("to").alias("to")), ["pivot", "kind"])
    pair = lambda df, i, j: df.where(F.col(i) != F.col(j)).select(F.least(i, j).alias("a"), F.greatest(i, j).alias("b"))
    return pair(by_token, "node", "other").unionByName(pair(met, "rep", "y_rep")).unionByName(pair(ties, "node", "to")).distinct()


def link_buckets(members: DataFrame, sets: DataFrame, percent: int = SIMILARITY, pivots: int = PIVOTS) -> DataFrame:
    """(node, component) of the similar members of common buckets.

    ``members``: bucket, node.  ``sets``: node, items, n.
    """
    m = materialize(members.join(sets.select("node", "n"), "node"))
    # a member of large buckets is like many others: the best pivot
    weight = m.join(m.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "bucket").groupBy("node").agg(F.sum("size").alias("weight"))
    m = m.join(weight, "node")
    best = F.max(F.struct("weight", (-F.col("node")).alias("low"), "n")).alias("p")
    first = m.groupBy("bucket").agg(best).select("bucket", (-F.col("p.low")).alias("pivot"), F.col("p.n").alias("pn"), F.col("p.weight").alias("pw"))
    stars = materialize(m.join(first, "bucket").where("node != pivot"))
    similar = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    links = lambda p: p.select(F.col("node").alias("a"), F.col("component").alias("b"))
    parts, pairs = None, stars
    for turn in range(pivots):
        new = confirm(pairs.where(similar).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), sets, percent)
        if parts is None:
            parts = materialize(connected_components(materialize(new)))
        else:
            new = materialize(new)
            if new.isEmpty():
                break
            parts = materialize(connected_components(links(parts).unionByName(new)))
        # members that no path links with their bucket's first pivot
        apart = _named(_named(stars, parts, "node", "part"), parts, "pivot", "main").where("part != main")
        apart = materialize(apart.select("bucket", "node", "n", "weight", "part"))
        if turn == pivots - 1:
            break
        chosen = apart.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("low"), "n", "part")).alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1")
        pairs = apart.join(chosen.select("bucket", (-F.col("p.low")).alias("pivot"), F.col("p.n").alias("pn"), F.col("p.part").alias("main")), "bucket").where("part != main")
    # what stays apart from its first pivot may still be like another member; buckets whose
    # pivots are of one component are one group, and its most central pivot is the group's
    several = stars.join(apart.select("bucket").distinct(), "bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    left = materialize(_named(stars.join(several, "bucket"), parts, "pivot", "main").select("pivot", "pw", "main", "node"))
    if left.isEmpty():
        return parts
    chief = left.groupBy("main").agg(F.max(F.struct("pw", (-F.col("pivot")).alias("low"))).alias("p")).select("main", (-F.col("p.low")).alias("chief"))
    near = materialize(left.join(chief, "main").where("node != chief").select(F.col("chief").alias("pivot"), "node").distinct())
    new = materialize(confirm(_beyond_pivots(near, sets, parts, percent), sets, percent))
    return parts if new.isEmpty() else connected_components(links(parts).unionByName(new))


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return _judged(_sketches(docs), docs, percent)


def _sketches(docs: DataFrame) -> DataFrame:
    sketch = pick(docs, doc_id="long", text="string").mapInArrow(_sketch, "doc_id long, n_shingles long, one long, two long, bands array<long>")
    return materialize(sketch)


KEY = ["one", "two", "n_shingles"]


def _judged(t: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of the sketches ``t``, a row each."""
    docs = pick(docs, doc_id="long", text="string")
    sets = t.where("n_shingles > 0 and doc_id is not null")
    # a class is named after its smallest doc_id; further classes of one doc_id get a name of their own
    names = W.partitionBy("low").orderBy(*KEY)
    classes = sets.groupBy(*KEY).agg(F.min("doc_id").alias("low")).withColumn("nth", F.row_number().over(names))
    classes = materialize(classes.select(*KEY, "low", F.when(F.col("nth") == 1, F.col("low")).otherwise(F.xxhash64(*KEY)).alias("node")))
    first = t.join(classes, KEY).where("doc_id = low").select("node", F.explode("bands").alias("bucket"))
    shared = first.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("bucket")
    members = materialize(first.join(shared, "bucket").select("bucket", "node").distinct())
    nodes = materialize(classes.join(members.select("node").distinct(), "node").select(F.col("low").alias("doc_id"), "node", "one"))
    texts = join_few(docs, nodes, "doc_id").select("node", "one", "text")
    items = materialize(texts.mapInArrow(_sets, "node long, items array<long>").dropDuplicates(["node"]).withColumn("n", F.size("items").cast("long")))
    parts = link_buckets(members, items, percent)
    # several texts of one doc_id are one document: their classes are linked
    key = F.struct(*KEY)
    several = sets.groupBy("doc_id").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x != y").select("doc_id")
    several = materialize(several)
    multiple = not several.isEmpty()
    if multiple:
        own = sets.join(several, "doc_id").join(classes.select(*KEY, "node"), KEY).select("doc_id", "node").distinct()
        own = own.join(own.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")
        parts = connected_components(materialize(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(own)))
    named = classes.join(parts, "node", "left").select(*KEY, "low", "component")
    if multiple:  # else nodes are named after doc_ids, and so are components
        named = materialize(named)
        least = named.where("component is not null").groupBy("component").agg(F.min("low").alias("least"))
        named = named.join(least, "component", "left").select(*KEY, "low", F.col("least").alias("component"))
    named = named.select(*KEY, F.coalesce("component", "low").alias("component"))
    out = t.select("doc_id", *KEY).join(named, KEY, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """One row of each document that its group keeps, all columns kept; of several
    rows of one doc_id the one whose hash is least.  Rows without a doc_id stay."""
    names = docs.columns
    t = _sketches(docs)
    kept = _judged(t, docs, percent).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")).where("kept and doc_id is not null")
    kept = materialize(kept.select(F.col("doc_id").alias("__k"), "rows"))
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    own = F.col(f"__c{place_of(names, 'doc_id')}").cast("long")
    alone = kept.where("rows = 1").select("__k")
    out = plain.join(alone, own == F.col("__k"), "left_semi").unionByName(plain.where(own.isNull()))
    again = kept.where("rows > 1").select("__k")
    if not again.isEmpty():
        text = F.col(f"__c{place_of(names, 'text')}").cast("string")
        order = W.partitionBy(own).orderBy(F.md5(text.cast("binary")), F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in plain.columns]))
        one = plain.join(again, own == F.col("__k"), "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
        out = out.unionByName(one)
    return out.toDF(*names)
