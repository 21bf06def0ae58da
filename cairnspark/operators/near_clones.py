"""Exact, renamed and gapped clones between files.

Tokens are compared in normal form (identifiers and literals alike, or words in
lower case), so that renaming changes nothing.  Each file is winnowed: of every
``window`` neighbouring k-grams the one with the least hash is a fingerprint, so
two files that share ``k + window - 1`` tokens share one.  A fingerprint that
occurs in many places is linked to its first place, so links grow with the
occurrences.  The links of two files are the seeds of their clones: from each
one the match is followed along its diagonal in both directions, over gaps of up
to ``max_gap`` tokens on either side that end in ``anchor`` equal tokens.

A clone without gaps has similarity 1 if its tokens are equal as written, else 1
less a twentieth of the share of renamed ones; one with gaps has the share of
its matched tokens, and less than 0.95.  These are the bounds of the four types.
Of clones of two files that overlap on either side the more similar one stays,
then the longer one.

Tokens are compared by 64-bit hashes.  Null and empty texts have no tokens;
equal keys are not distinguished; a file's tokens fit a task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from ..sources.tables import spread
from .chunking import language_of
from .clones import clone_type, lex
from .filters import loose_glob


@dataclass(frozen=True)
class Limits:
    """Fewest lines and tokens and least similarity of a clone, and how gaps are crossed."""

    min_lines: int = 6
    min_tokens: int = 50
    similarity: float = 0.80
    k: int = 12
    window: int = 8
    max_gap: int = 5
    anchor: int = 5


# Languages whose files are looked at, and paths that are not.
ANALYSED = ("rust", "python", "javascript", "typescript")
EXCLUDED = ("**/target/**", "**/node_modules/**", "**/.git/**", "**/vendor/**")
#: Rule of each type.
RULES = {"exact": "DUP001", "renamed": "DUP002", "gapped": "DUP003", "semantic": "DUP004"}
FIELDS = ("start1", "end1", "start2", "end2", "line1", "last1", "line2", "last2", "n_tokens", "matched", "gap_tokens", "renamed")


def analysed(files: DataFrame, key: str = "path", languages: tuple[str, ...] = ANALYSED, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Files of the given languages that no exclusion finds; an exclusion that is no pattern excludes nothing."""
    kept = files.where(language_of(F.col(key)).isin(*languages))
    for pattern in filter(None, map(loose_glob, exclude)):
        kept = kept.where(~F.col(key).rlike(pattern))
    return kept


def source_tokens(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """key, raw, norm, lines: a file's tokens as hashes, as written and in normal form, and their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lex(x or "") for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array([[t[i] for t in f] for f in found], pa.list_(kind)) for i, kind in ((0, pa.string()), (3, pa.string()), (1, pa.int32()))]], ["key", "texts", "kinds", "lines"])

    kind = files.schema[key].dataType.simpleString()
    t = files.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, texts array<string>, kinds array<string>, lines array<int>")
    norm = F.zip_with("texts", "kinds", lambda x, k: F.xxhash64(F.when(k == "identifier", "$ID").when(k == "literal", "$LIT").otherwise(x)))
    return t.select("key", F.transform("texts", lambda x: F.xxhash64(x)).alias("raw"), norm.alias("norm"), "lines")


def word_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same for prose: words as written and in lower case, line by line."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.transform(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.struct(w.alias("w"), (i + 1).alias("line"))))
    t = docs.select(F.col(key).alias("key"), F.flatten(lines).alias("t"))
    return t.select("key", F.transform("t", lambda x: F.xxhash64(x["w"])).alias("raw"), F.transform("t", lambda x: F.xxhash64(F.lower(x["w"]))).alias("norm"), F.transform("t", lambda x: x["line"].cast("int")).alias("lines"))


def winnowed(norm: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a file's fingerprints."""
    n = len(norm) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(0x100000001B3) + norm[i : i + n].view(np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    width = min(window, n)
    views = np.lib.stride_tricks.sliding_window_view(h, width)
    # the last of equal ones: runs of one k-gram give few fingerprints
    at = np.unique(np.arange(len(views)) + width - 1 - views[:, ::-1].argmin(1))
    return at, h[at].view(np.int64)


def fingerprints(tokens: DataFrame, limits: Limits) -> DataFrame:
    """key, pos, h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                found = [winnowed(norm.values.to_numpy(zero_copy_only=False).astype(np.int64), limits.k, limits.window) for norm in b.column("norm")]
                key = b.column("key").take(pa.array(np.repeat(np.arange(b.num_rows), [len(at) for at, _ in found])))
                yield pa.RecordBatch.from_arrays([key, *[pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)]], ["key", "pos", "h"])

    return tokens.select("key", "norm").mapInArrow(run, f"key {tokens.schema['key'].dataType.simpleString()}, pos long, h long")


def seeds(prints: DataFrame, k: int) -> DataFrame:
    """file1, file2, seeds: places of equal fingerprints, by pair of files; each place is linked with the first of its hash."""
    prints = prints.repartition("h")  # one exchange for the first places and the join
    first = prints.groupBy("h").agg(F.min(F.struct("key", "pos")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    j = prints.join(first.select("h", "f"), "h").where((F.col("key") != F.col("f.key")) | (F.col("pos") >= F.col("f.pos") + k))
    return j.groupBy(F.col("f.key").alias("file1"), F.col("key").alias("file2")).agg(F.sort_array(F.collect_list(F.struct(F.col("f.pos").alias("p"), F.col("pos").alias("q")))).alias("seeds"))


def _gaps(most: int) -> list[tuple[int, int]]:
    """Gaps in the order in which they are tried: the smallest first."""
    return sorted(((a, b) for a in range(most + 1) for b in range(most + 1) if a or b), key=lambda g: (max(g), sum(g), g[0]))


def follow(x: list[int], y: list[int], i: int, j: int, end1: int, end2: int, anchor: int, gaps: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Blocks (i, j, length) of equal tokens from (i, j) on, before the ends."""
    out = []
    while True:
        n = 0
        while i + n < end1 and j + n < end2 and x[i + n] == y[j + n]:
            n += 1
        if n:
            out.append((i, j, n))
        i, j = i + n, j + n
        for a, b in gaps:
            p, q = i + a, j + b
            if p + anchor <= end1 and q + anchor <= end2 and x[p : p + anchor] == y[q : q + anchor]:
                i, j = p, q
                break
        else:
            return out


def clones_of(x: list[int], y: list[int], places: list[tuple[int, int]], same_file: bool, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """The clones of two files in normal form, as lists of blocks; a seed inside one opens no other."""
    gaps, found, covered = _gaps(limits.max_gap), [], {}
    rx, ry = x[::-1], y[::-1]
    n, m = len(x), len(y)
    for p, q in places:
        if any(a <= p < b for a, b in covered.get(q - p, ())):
            continue
        right = follow(x, y, p, q, q if same_file else n, m, limits.anchor, gaps)
        if not right:
            continue
        last = right[-1][0] + right[-1][2]
        left = follow(rx, ry, n - p, m - q, n, m - last if same_file else m, limits.anchor, gaps)
        blocks = [(n - i - k, m - j - k, k) for i, j, k in reversed(left)] + right
        if len(left) and blocks[len(left) - 1][0] + blocks[len(left) - 1][2] == p and blocks[len(left) - 1][1] + blocks[len(left) - 1][2] == q:
            i, j, k = blocks[len(left) - 1]
            blocks[len(left) - 1 : len(left) + 1] = [(i, j, k + right[0][2])]
        for i, j, k in blocks:  # as found: a seed in what is trimmed leads to the same place
            covered.setdefault(j - i, []).append((i, i + k))
        found.append(blocks)
    return found


def trimmed(blocks: list[tuple[int, int, int]], x: list[int], y: list[int]) -> list[tuple[int, int, int]]:
    """What tokens as written say of the ends.

    What lies beyond the first and last of them that are equal is alike by
    chance, as any two names are (where none is equal, nothing is trimmed).  A run
    that is equal as written and nine tenths of a clone without gaps or more is
    the clone, an exact one.
    """
    out = list(blocks)
    if not any(x[i + k] == y[j + k] for i, j, n in blocks for k in range(n)):
        return out
    while out and not (same := [k for k in range(out[0][2]) if x[out[0][0] + k] == y[out[0][1] + k]]):
        out.pop(0)
    if out:
        i, j, n = out[0]
        out[0] = (i + same[0], j + same[0], n - same[0])
    while out and not (same := [k for k in range(out[-1][2]) if x[out[-1][0] + k] == y[out[-1][1] + k]]):
        out.pop()
    if out:
        out[-1] = (*out[-1][:2], same[-1] + 1)
    if len(out) == 1:
        (i, j, n), start, best = out[0], 0, (0, 0)
        for k in range(n + 1):
            if k == n or x[i + k] != y[j + k]:
                best = max(best, (k - start, -start))
                start = k + 1
        if 10 * best[0] >= 9 * n:
            out = [(i - best[1], j - best[1], best[0])]
    return out


def described(blocks: list[tuple[int, int, int]], a: dict, b: dict) -> tuple[float, tuple[int, ...]]:
    """Similarity and FIELDS of a clone between two files' tokens."""
    (s1, s2, _), (i, j, n) = blocks[0], blocks[-1]
    e1, e2 = i + n, j + n
    matched = sum(k for *_, k in blocks)
    renamed = sum(u != v for i, j, k in blocks for u, v in zip(a["raw"][i : i + k], b["raw"][j : j + k], strict=True))
    gap = sum(max(p[0] - o[0] - o[2], p[1] - o[1] - o[2]) for o, p in zip(blocks, blocks[1:], strict=False))
    similarity = min(matched / (matched + gap), 0.949) if gap else 1 - 0.05 * renamed / matched
    return similarity, (s1, e1, s2, e2, a["lines"][s1], a["lines"][e1 - 1], b["lines"][s2], b["lines"][e2 - 1], min(e1 - s1, e2 - s2), matched, gap, renamed)


def without_overlaps(found: list[tuple[float, tuple[int, ...]]]) -> list[tuple[float, tuple[int, ...]]]:
    """The more similar, then longer, then earlier of clones that overlap on a side."""
    kept, sides = [], ([], [])

    def free(side: list[tuple[int, int]], start: int, end: int) -> bool:
        at = bisect_left(side, (start, end))
        return not (at and side[at - 1][1] > start) and not (at < len(side) and side[at][0] < end)

    for s, f in sorted(found, key=lambda c: (-c[0], -c[1][8], c[1])):
        spans = (f[0], f[1]), (f[2], f[3])
        if all(free(side, *span) for side, span in zip(sides, spans, strict=True)):
            for side, span in zip(sides, spans, strict=True):
                side.insert(bisect_left(side, span), span)
            kept.append((s, f))
    return kept


def _digest(*columns: str) -> Column:
    """128 bits over the columns' values."""
    return F.concat_ws("-", F.xxhash64(*columns), F.xxhash64(F.lit(1), *reversed(columns)))


def near_clones(tokens: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """file1, file2, FIELDS, similarity, clone_type, rule_id of the clones in ``tokens`` (key, raw, norm, lines).

    Ends are behind the last token; lines are those of the first and last token.
    Files of equal tokens are one class, and pairs of the same two classes with
    the same seeds one case: matches are followed once a case, not once a pair.
    """
    linked = materialize(seeds(fingerprints(tokens, limits), limits.k))
    # only files with a link are kept as tokens; the join goes below what makes them, so texts cross the network
    keys = linked.select(F.col("file1").alias("key")).unionAll(linked.select(F.col("file2").alias("key"))).distinct()
    t = materialize(tokens.join(keys, "key", "left_semi").withColumn("class", _digest("raw", "norm", "lines")).withColumn("row", F.monotonically_increasing_id()))
    of = lambda n: t.select(F.col("key").alias(f"file{n}"), F.col("class").alias(f"class{n}"))
    pairs = linked.join(of(1), "file1").join(of(2), "file2").withColumn("same", F.col("file1") == F.col("file2"))
    pairs = materialize(pairs.withColumn("case", _digest("class1", "class2", "seeds", "same")))
    cases = pairs.groupBy("case").agg(*[F.first(c).alias(c) for c in ("class1", "class2", "seeds", "same")])
    one = t.join(t.groupBy("class").agg(F.min("row").alias("row")), ["class", "row"])
    side = lambda n: one.select(F.col("class").alias(f"class{n}"), *[F.col(c).alias(f"{c}{n}") for c in ("raw", "norm", "lines")])
    # few cases may be much work
    both = spread(cases.join(side(1), "class1").join(side(2), "class2").drop("class1", "class2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(n)[i].as_py() for n in b.schema.names}
                a, c = ({x: r[f"{x}{n}"] for x in ("raw", "norm", "lines")} for n in (1, 2))
                found = clones_of(a["norm"], c["norm"], [(s["p"], s["q"]) for s in r["seeds"]], r["same"], limits)
                good = []
                for s, f in (described(x, a, c) for x in (trimmed(x, a["raw"], c["raw"]) for x in found) if x):
                    if f[8] >= limits.min_tokens and min(f[5] - f[4], f[7] - f[6]) + 1 >= limits.min_lines and s >= limits.similarity:
                        good.append((s, f))
                good = without_overlaps(good)
                case = pa.array([r["case"]] * len(good), b.schema.field("case").type)
                cols = [pa.array([f[k] for _, f in good], pa.int64()) for k in range(len(FIELDS))]
                yield pa.RecordBatch.from_arrays([case, *cols, pa.array([s for s, _ in good], pa.float64())], ["case", *FIELDS, "similarity"])

    found = both.mapInArrow(run, "case string, " + ", ".join(f"{f} long" for f in FIELDS) + ", similarity double")
    out = pairs.select("file1", "file2", "case").join(found, "case").drop("case")
    out = out.withColumn("similarity", F.round("similarity", 6)).withColumn("clone_type", clone_type(F.col("similarity")))
    return out.withColumn("rule_id", F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])[F.col("clone_type")])
