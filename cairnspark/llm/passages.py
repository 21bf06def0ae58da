"""Substring dedup: paragraphs that repeat across documents.

Paragraphs are cut by content: a word starts one where the hash of it and the
next word is the least within ``REACH`` words to either side, so a passage pasted
into the middle of another text is cut as it is elsewhere, whatever its lines.
They have 13 words on average.  A paragraph's set holds its five-word shingles
(lower-cased A-Z).

Paragraphs with one shingle multiset are one class.  Classes are banded with one
value a band (the minimum and maximum under one permutation and the minimum
under another): at Jaccard 0.75 a pair shares a band with probability 0.98, equal
paragraphs always do.  Colliding classes are compared on exact Jaccard
(neardup.link_buckets), and components of classes that reach two documents are
repeats.  Each document's neighbouring repeats form a run.  Its outermost
paragraphs that are also in the component's smallest doc_id (there, the first
such) grow outwards in both documents, up to the document's next run: over equal
words, and over an edit of up to ``EDIT`` words that ``SHINGLE`` equal words follow.
Runs of one home that are at most ``SHINGLE`` words apart are one passage.
Passages of ``MIN_WORDS`` or more are reported, and removed in all but the
smallest doc_id.

Edge cases.  Texts of fewer than five words, null and empty ones, and null
doc_ids take no part.  Rows of one doc_id are one document, which repeats
nothing of itself.  Column names may differ in case; extra columns do no harm.  An
empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_few, materialize, pick
from .neardup import FLIP, MULT, SHINGLE, SIMILARITY, link_buckets, mixed, shingles, words_of_texts

REACH, MIN_WORDS, EDIT = 6, 25, 3
KEYS = ("k0", "k1", "k2")
#: Words by which a passage may grow in the first round; those that do so go on with FASTER times as many.
GROW, FASTER = 48, 16
FAR = (1 << 31) - 1
#: Documents whose passages still grow after the first round: so many are broadcast (some 30 MB with their places).
FEW_ENDS = 50_000
#: Words to skip in both documents at an edit, the fewest first.
SKIPS = sorted(((i, j) for i in range(EDIT + 1) for j in range(EDIT + 1) if i + j), key=lambda x: (max(x), sum(x), x))


def paragraphs(words: np.ndarray, edge: np.ndarray, reach: int = REACH) -> list[np.ndarray]:
    """text, first word, words, class, and the band values of each paragraph of
    five words or more, of texts whose words are words[edge[i]:edge[i+1]]."""
    top, none = ~np.uint64(0), np.uint64(0)
    size = np.diff(edge)
    # texts stand apart by more than the reach
    begin = edge[:-1] + np.arange(len(size)) * (reach + SHINGLE)
    place = np.arange(len(words)) + np.repeat(begin - edge[:-1], size)
    w = np.zeros(len(words) + len(size) * (reach + SHINGLE) + 1, np.uint64)
    w[place] = words
    real = np.zeros(len(w), bool)
    real[place] = True
    g = np.where(real[:-1] & real[1:], mixed(w[:-1] * MULT[0] + w[1:] * MULT[1]), top)
    low = np.concatenate([np.full(reach, top), g, np.full(reach, top)])
    low = functools.reduce(np.minimum, [low[i : len(low) - reach + 1 + i] for i in range(reach)])
    # a paragraph starts at the least hash, the first of equal ones
    cut = (g < low[: len(g)]) & (g <= low[reach + 1 : reach + 1 + len(g)])
    cut[begin[size > 0]] = True
    first = np.flatnonzero(cut)
    text = np.searchsorted(begin, first, "right") - 1
    end = np.minimum(np.append(first[1:], len(w)), (begin + size)[text])
    ok = end - first >= SHINGLE
    first, end, text = first[ok], end[ok], text[ok]
    if not len(first):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 4
    sh = shingles(w)
    mark = np.zeros(len(sh) + 1, np.int8)
    mark[first] += 1
    mark[end - SHINGLE + 1] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8) > 0
    x, y = (sh ^ FLIP[0]) * MULT[2], (sh ^ FLIP[1]) * MULT[3]
    least = np.minimum.reduceat(np.where(inside, x, top), first)
    most = np.maximum.reduceat(np.where(inside, x, none), first)
    other = np.minimum.reduceat(np.where(inside, y, top), first)
    own = np.add.reduceat(np.where(inside, mixed(sh ^ FLIP[2]), none), first)
    return [text, first - begin[text], end - first, mixed(own), least, most ^ FLIP[3], other ^ FLIP[4]]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id").to_numpy()
        for i, words, edge in words_of_texts(b.column("text").to_pylist()):
            text, first, size, *values = paragraphs(words, edge)
            at = np.arange(len(text)) - np.searchsorted(text, text)
            arrays = [pa.array(ids[i + text]), *[pa.array(c.astype(np.int32)) for c in (at, first, size)], *[pa.array(c.view(np.int64)) for c in values]]
            whole = pa.RecordBatch.from_arrays(arrays, ["doc_id", "at", "first", "words", "class", *KEYS])
            for k in range(0, len(text), 50_000):
                yield whole.slice(k, 50_000)


def ragged(start: np.ndarray, size: np.ndarray, step: int | np.ndarray = 1) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and numbers of the runs start, start + step, ... of these sizes."""
    edge = np.append(0, np.cumsum(size))
    return edge, np.repeat(start, size) + step * (np.arange(edge[-1]) - np.repeat(edge[:-1], size))


class Parts:
    """Paragraphs (struct column ``parts``) of a batch's texts: those that are there in the text."""

    def __init__(self, column: pa.Array, lo: int, words: np.ndarray, edge: np.ndarray):
        own = column.slice(lo, len(edge) - 1)
        flat = own.flatten()
        self.words = words
        text = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
        self.f = {flat.type.field(i).name: flat.field(i).to_numpy() for i in range(flat.type.num_fields)}
        # shingles of all texts; those that run over a text's end are never asked for
        self.sh = shingles(np.concatenate([words, np.zeros(SHINGLE, np.uint64)]))
        total = np.append(np.uint64(0), np.cumsum(mixed(self.sh ^ FLIP[2])))
        n = self.f["words"] - SHINGLE + 1
        self.begin, self.end = edge[:-1][text], edge[1:][text]
        at = np.minimum(self.begin + self.f["first"], len(self.sh) - 1)
        last = np.minimum(at + n, len(self.sh))
        there = (self.begin + self.f["first"] + self.f["words"] <= self.end) & (mixed(total[last] - total[at]).view(np.int64) == self.f["class"])
        self.f = {k: v[there] for k, v in self.f.items()}
        self.begin, self.end, self.text = self.begin[there], self.end[there], lo + text[there]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, items of (parts, text): those parts that are there in the text."""
    for b in batches:
        for i, words, edge in words_of_texts(b.column("text").to_pylist()):
            p = Parts(b.column("parts"), i, words, edge)
            size = (p.f["words"] - SHINGLE + 1).astype(np.int64)
            _, at = ragged(p.begin + p.f["first"], size)
            of, items = np.repeat(np.arange(len(size)), size), p.sh[at]
            by = np.lexsort((items, of))
            of, items = of[by], items[by]
            new = np.append(True, (of[1:] != of[:-1]) | (items[1:] != items[:-1]))[: len(of)]
            of, items = of[new], items[new]
            offsets = np.searchsorted(of, np.arange(len(size) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(p.f["class"]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(items.view(np.int64)))], ["node", "items"])


def cut_documents(docs: DataFrame) -> DataFrame:
    """doc_id, at, first, words, class and band values of every paragraph."""
    d = pick(docs, doc_id="long", text="string").where("doc_id is not null and text is not null")
    return d.mapInArrow(_cut, "doc_id long, at int, first int, words int, class long, " + ", ".join(f"{k} long" for k in KEYS))


def meeting(classes: DataFrame) -> DataFrame:
    """bucket, node of ``classes`` (class, band values; a row a class), where another class has the same value.

    The values cross the network once and are sorted by themselves alone: a class has a value once, so rows are counted.
    """
    keys = classes.select(F.explode(F.array_distinct(F.array(*KEYS))).alias("bucket"), F.col("class").alias("node"))
    return keys.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("bucket"))).where("n > 1").drop("n")


def told_apart(hits: DataFrame) -> DataFrame:
    """``hits`` (..., class, k0, component, home), in which a class has one least band value.

    Equal paragraphs agree in both, so classes are told apart by 128 bits.  Where
    one class has several values, which chance hardly ever brings, each is a
    component of its own, and stays if it reaches two documents.
    """
    both = materialize(hits.groupBy("class").agg(F.min("k0").alias("x"), F.max("k0").alias("y")).where("x != y").select("class"))
    if both.isEmpty():
        return hits
    own = hits.join(both, "class").groupBy("class", "k0").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo != hi")
    own = hits.drop("component", "home").join(own, ["class", "k0"]).withColumn("component", F.xxhash64("class", "k0")).withColumn("home", F.col("lo"))
    return materialize(hits.join(both, "class", "left_anti").unionByName(own.select(*hits.columns)))


def repeated_passages(docs: DataFrame, percent: int = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, first_word, n_words, component_id (the doc_id that keeps it), removed."""
    u = materialize(cut_documents(docs))
    # a row a class: the documents it spans, a place in the smallest and the band values; equal paragraphs have as many words
    # not stored: it is nearly as large as the paragraphs, and its two uses need different columns
    classes = u.groupBy("class").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min_by("first", "doc_id").alias("first"), F.min("words").alias("words"), *[F.min(k).alias(k) for k in KEYS])
    members = materialize(meeting(classes))
    # a class of one document that meets no other repeats nothing
    nodes = members.select("node").distinct().withColumn("meets", F.lit(True))
    known = classes.select("class", "lo", "hi", "first", "words").join(nodes, F.col("class") == F.col("node"), "left").where("meets or lo != hi")
    known = materialize(known.drop("node"))
    place = known.where("meets").groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list(F.struct("class", "first", "words")).alias("parts"))
    texts = pick(docs, doc_id="long", text="string").where("doc_id is not null and text is not null")
    sets = texts.join(place, "doc_id").select("parts", "text").mapInArrow(_sets, "node long, items array<long>")
    sets = materialize(sets.dropDuplicates(["node"]).withColumn("n", F.size("items").cast("long")))
    parts = link_buckets(members, sets, percent)
    # a class of one document that links with no other repeats nothing
    named = known.join(parts, F.col("class") == F.col("node"), "left").where("component is not null or lo != hi")
    named = materialize(named.select("class", "lo", "hi", F.coalesce("component", "class").alias("component")))
    home = named.groupBy("component").agg(F.min("lo").alias("home"), F.max("hi").alias("hi")).where("home != hi").select("component", "home")
    again = materialize(named.join(home, "component").select("class", "component", "home"))
    # the repeated classes of a partition are hashed, some tens of bytes each, so that paragraphs are not sorted
    hits = told_apart(materialize(u.select("doc_id", "at", "first", "words", "class", "k0").join(again.hint("shuffle_hash"), "class").distinct())).drop("k0")
    # neighbouring repeats of one home form a run; runs are told within the window's partitions
    w = W.partitionBy("doc_id", "home").orderBy("at")
    p = F.struct("first", "words", "class")
    same = hits.where("doc_id = home").groupBy("class").agg(F.min(p).alias("same"))
    runs = hits.join(same, "class", "left").withColumn("part", F.col("at") - F.row_number().over(w))
    # a run grows from its outermost paragraphs that are also in the home, else from those like the home's
    runs = runs.groupBy("doc_id", "home", "part").agg(
        F.min("first").alias("a"), F.max(F.col("first") + F.col("words")).alias("b"),
        *[F.max_by(F.struct("first", "words", "class", "component", "same"), F.struct(F.col("same").isNotNull(), F.col("at") * side)).alias(name) for name, side in (("left", -1), ("right", 1))],
    )
    runs = materialize(runs)
    # up to the document's next run on either side
    near = W.partitionBy("doc_id").orderBy("a", "b")
    runs = runs.withColumn("before", F.max("b").over(near.rowsBetween(W.unboundedPreceding, -1))).withColumn("after", F.lead("a").over(near))
    room = lambda side: F.coalesce(F.col("a") - F.col("before"), F.lit(FAR)) if side < 0 else F.coalesce(F.col("after") - F.col("b"), F.lit(FAR))
    ends = runs.select("doc_id", "home", F.inline(F.array(*[F.struct(F.lit(side).alias("side"), F.col(name).alias("own"), room(side).alias("room")) for name, side in (("left", -1), ("right", 1))])))
    grown = _grown(ends.where("doc_id != home and room > 0"), hits.where("doc_id = home"), texts)
    span = lambda c, n: (F.when(F.col("side") < 0, F.col(f"{c}.first") - n).otherwise(F.col(f"{c}.first")).alias("a"), (F.col(f"{c}.first") + F.col(f"{c}.words") + F.when(F.col("side") > 0, n).otherwise(0)).alias("b"))
    spans = runs.select("doc_id", "home", "a", "b")
    spans = spans.unionByName(grown.select("doc_id", "home", *span("own", F.col("n")))).unionByName(grown.select(F.col("home").alias("doc_id"), "home", *span("there", F.col("m"))))
    spans = spans.groupBy("doc_id", "home", "a").agg(F.max("b").alias("b"))
    spans = _joined(spans, "doc_id", "home", gap=SHINGLE).groupBy("doc_id", "home", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")
    whole = W.partitionBy("doc_id", "island")
    spans = _joined(spans, "doc_id").withColumn("all", F.max("b").over(whole) - F.min("a").over(whole)).where(F.col("all") >= min_words)
    return spans.select(
        "doc_id", F.col("a").cast("long").alias("first_word"), (F.col("b") - F.col("a")).cast("long").alias("n_words"), F.col("home").alias("component_id"), (F.col("doc_id") != F.col("home")).alias("removed")
    )


def _joined(spans: DataFrame, *keys: str, gap: int = 0) -> DataFrame:
    """``spans`` and ``island``: which of a key's spans, from a to before b, overlap or are at most ``gap`` words apart."""
    w = W.partitionBy(*keys).orderBy("a", "b")
    far = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("opens", F.coalesce((F.col("a") > far + gap).cast("int"), F.lit(1)))
    return spans.withColumn("island", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("opens")


def advance(x: np.ndarray, y: np.ndarray, more_x: bool, more_y: bool) -> tuple[int, int, bool]:
    """How many words of x and of y follow each other in both, over edits, and
    whether it may go on: more of a text follows and decides."""
    i = j = 0
    while True:
        k = min(len(x) - i, len(y) - j)
        apart = np.flatnonzero(x[i : i + k] != y[j : j + k])
        e = int(apart[0]) if len(apart) else k
        i, j = i + e, j + e
        if e == k:
            return i, j, (more_x or i < len(x)) and (more_y or j < len(y))
        # a few words as lists, which compare much faster than short arrays
        u, v = x[i : i + EDIT + SHINGLE].tolist(), y[j : j + EDIT + SHINGLE].tolist()
        for p, q in SKIPS:
            if min(len(u) - p, len(v) - q) >= SHINGLE and u[p : p + SHINGLE] == v[q : q + SHINGLE]:
                i, j = i + p, j + q
                break
        else:
            return i, j, (more_x and len(x) - i < SHINGLE + EDIT) or (more_y and len(y) - j < SHINGLE + EDIT)


PLACE = ("d", "s", "f", "w", "c", "o")


def _grown(ends: DataFrame, homes: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, home, side, own, there, n, m of (doc_id, home, side, own, room): the home's
    paragraph of the same class, or else component, and the words by which both grow to the side."""
    p = F.struct("first", "words", "class")
    like = homes.groupBy("component").agg(F.min(p).alias("like"))
    pairs = ends.select("doc_id", "home", "side", "room", F.struct("own.first", "own.words", "own.class").alias("own"), F.col("own.same").alias("same"), F.col("own.component").alias("component"))
    pairs = pairs.join(like, "component")
    open_ = materialize(pairs.select("doc_id", "home", "side", "room", "own", F.coalesce("same", "like").alias("there"), F.lit(0).alias("n"), F.lit(0).alias("m")))
    done, size = None, GROW
    while done is None or not open_.isEmpty():
        place = lambda doc, c, o, most: [F.col(x).alias(y) for x, y in zip((doc, "side", f"{c}.first", f"{c}.words", f"{c}.class", o), PLACE, strict=True)] + [most.alias("most")]
        asked = open_.select(*place("doc_id", "own", "n", F.col("room") - F.col("n"))).unionByName(open_.select(*place("home", "there", "m", F.lit(size))))
        asked = asked.groupBy(*PLACE).agg(F.max("most").alias("most"))
        asked = asked.groupBy(F.col("d").alias("doc_id")).agg(F.collect_list(F.struct(F.col("s").alias("side"), F.col("f").alias("first"), F.col("w").alias("words"), F.col("c").alias("class"), "o", "most")).alias("parts"))
        near = (texts.join(asked, "doc_id") if size == GROW else join_few(texts, materialize(asked), "doc_id", FEW_ENDS)).select("doc_id", "parts", "text").mapInArrow(_neighbours(size), "d long, s int, f int, w int, c long, o int, near array<long>")
        near = materialize(near.groupBy(*PLACE).agg(F.max("near").alias("near")))
        at = lambda t, *x: functools.reduce(lambda a, b: a & b, [c == t[k] for c, k in zip(x, PLACE, strict=True)])
        of = lambda doc, c, o: [F.col(doc), F.col("side"), F.col(f"{c}.first"), F.col(f"{c}.words"), F.col(f"{c}.class"), F.col(o)]
        names = ["doc_id", "home", "side", "room", "own", "there", "n", "m"]
        mine = open_.join(near, at(near, *of("doc_id", "own", "n"))).select(*names, F.slice("near", 1, F.greatest(F.lit(0), F.col("room") - F.col("n"))).alias("mine"))
        met = mine.join(near, at(near, *of("home", "there", "m"))).select(*names, "mine", "near")
        met = materialize(met.mapInArrow(_advanced(size), open_.select(*names).withColumn("on", F.lit(True)).schema))
        out = met.where("not on").drop("on")
        done = out if done is None else done.unionByName(out)
        open_, size = met.where("on").drop("on"), size * FASTER
    return done


def _advanced(size: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One round of growth of (..., room, ..., n, m, mine, near)."""
        for b in batches:
            side = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (b.column("mine"), b.column("near"))]
            (x, xo), (y, yo) = side
            room, n, m = (b.column(c).to_numpy() for c in ("room", "n", "m"))
            rows = [advance(x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]], xo[i + 1] - xo[i] == size and room[i] - n[i] > size, yo[i + 1] - yo[i] == size) for i in range(b.num_rows)]
            i, j, on = (np.array([r[k] for r in rows], kind) for k, kind in ((0, np.int32), (1, np.int32), (2, bool)))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(n + i), pa.array(m + j), pa.array(on)], [*b.schema.names[:6], "n", "m", "on"])

    return step


def _neighbours(size: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Up to ``size`` words to the side of each part, outwards from the o-th, where the part is there in the text."""
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for i, words, edge in words_of_texts(b.column("text").to_pylist()):
                p = Parts(b.column("parts"), i, words, edge)
                left = p.f["side"] < 0
                first = p.begin + p.f["first"]
                start = np.where(left, first - 1 - p.f["o"], first + p.f["words"] + p.f["o"])
                n = np.clip(np.where(left, start + 1 - p.begin, p.end - start), 0, np.minimum(size, p.f["most"]))
                offsets, at = ragged(start, n, np.repeat(np.where(left, -1, 1), n))
                cols = [pa.array(ids[p.text]), *[pa.array(p.f[k]) for k in ("side", "first", "words", "class", "o")]]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words[at].view(np.int64)))], [*PLACE, "near"])

    return near
