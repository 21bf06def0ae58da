r"""Line dedup by content-defined chunks of lines.

Native: DataFrame functions only.

A text is split at ``\n``.  A line's hash is 31 bits of its md5; a polynomial
rolling hash over the last ``WINDOW`` line hashes ends a chunk where it is less
than at the line before and no greater than at the next one, so that boundaries
depend on content and survive shifts, and chunks have two lines or more, three on
average.  Within a run of one repeated line, where the hash stands still, every
second line ends a chunk.  A chunk of two or more lines, not all of them blank,
that occurs more than once in the whole table is compared byte by byte, and all
but its first occurrence (by doc_id, then line) are removed, with up to ``REACH``
lines on either side that equal those beside the first occurrence (64-bit hashes
of lines, next to bytes that were compared).  So a shared
passage goes to its ends, and of every removed line an equal one stays earlier.
A last chunk of one line is left alone.

Scale.  Chunks meet by a 64-bit hash with counts pre-aggregated in each task; a
chunk that a third of all documents share is one row of that table.  Only
repeated chunks are looked up in their texts again and compared.  All work on a
text is linear in its lines.

Edge cases.  A null text stays null, an empty one has one blank line.  Documents
are told apart by (doc_id, text): repeated rows are one document and keep the
same lines.  A null doc_id sorts last.  A text that loses all lines becomes the
empty text.  Column names may differ in case; extra columns do no harm.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_few, materialize, pick, place_of

WINDOW, BASE, PRIME, REACH = 2, 1_000_003, 2_147_483_647, 8
#: Documents with repeated chunks: so many are broadcast with their chunks' places (some 20 MB), more are shuffled.
FEW_DOCS = 100_000
#: Where null ids sort: after every other.
LAST = (1 << 63) - 1


def line_hash(line: Column) -> Column:
    """The first 31 bits of md5."""
    return F.shiftright(F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long"), 1)


def once(col: Column, f) -> Column:
    """f(col), with the column bound as a lambda's variable: it is computed once, not once an element."""
    return F.transform(F.array(col), f)[0]


def chunk_spans(lines: Column, window: int = WINDOW) -> Column:
    """Array of (first, last): the chunks' 0-based lines.

    With h the line hashes, g(i) is sum(h[i-j] * BASE^j, j < window) mod PRIME
    (lines before the first count 0).  Line i ends a chunk if g(i-1) > g(i) <=
    g(i+1), or if i is even and g stands still from i-2 to i+1, or if it is the last.
    """

    def rolled(h: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            for j in range(1, window):
                x = x + F.coalesce(F.get(h, i - j), F.lit(0)) * F.lit(pow(BASE, j, PRIME)) % PRIME
            return x % PRIME

        return F.transform(h, at)

    def ends(g: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            before, after = F.get(g, i - 1), F.get(g, i + 1)
            still = (i % 2 == 0) & (F.get(g, i - 2) == x) & (before == x) & (after == x)
            return F.when(after.isNull() | F.coalesce((before > x) & (x <= after), F.lit(False)) | F.coalesce(still, F.lit(False)), i)

        return F.filter(F.transform(g, at), lambda i: i.isNotNull())

    def spans(e: Column) -> Column:
        return F.transform(e, lambda x, k: F.struct(F.coalesce(F.get(e, k - 1) + 1, F.lit(0)).alias("first"), x.alias("last")))

    return once(once(once(F.transform(lines, line_hash), rolled), ends), spans)


def _run(lines: Column, first: Column, last: Column) -> Column:
    return F.slice(lines, first + 1, F.greatest(F.lit(0), last - first + 1))


def _text(lines: Column, s: Column) -> Column:
    return F.array_join(_run(lines, s["first"], s["last"]), "\n")


def line_chunks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, first, last, h) of the chunks of several lines, not all blank, of (doc_id, th, text)."""

    def chunks(lines: Column) -> Column:
        own = F.filter(chunk_spans(lines, window), lambda s: s["last"] > s["first"])
        own = F.filter(own, lambda s: F.exists(_run(lines, s["first"], s["last"]), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
        return F.transform(own, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.xxhash64(_text(lines, s)).alias("h")))

    return docs.where(F.contains("text", F.lit("\n"))).select("doc_id", "th", F.inline(once(F.split("text", "\n"), chunks)))


def _like(a: Column, b: Column) -> Column:
    """How many lines at the start of both arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def dedup_lines(docs: DataFrame, window: int = WINDOW, reach: int = REACH) -> DataFrame:
    """doc_id, th, chunks (how many are removed), removed (sorted array of first and last lines) of the documents that lose lines."""
    d = pick(docs, doc_id="long", text="string").where("text is not null")
    d = d.select("doc_id", F.xxhash64("text").alias("th"), "text")
    chunks = line_chunks(d, window)
    again = chunks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    # repeated by hash: their texts and the hashes of the lines beside them
    parts = chunks.join(again, "h").distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("parts"))
    parts = materialize(parts.select(F.xxhash64("doc_id", "th").alias("k"), F.col("doc_id").alias("i"), F.col("th").alias("t"), "parts"))
    hashed = lambda lines: F.transform(lines, lambda x: F.xxhash64(x))
    beside = lambda lines, s: F.struct(
        s["first"].alias("first"), s["last"].alias("last"), _text(lines, s).alias("chunk"),
        hashed(F.reverse(_run(lines, F.greatest(F.lit(0), s["first"] - reach), s["first"] - 1))).alias("before"), hashed(F.slice(lines, s["last"] + 2, reach)).alias("after"),
    )
    found = join_few(d.withColumn("k", F.xxhash64("doc_id", "th")), parts, "k", FEW_DOCS).where(F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")))
    found = found.select("doc_id", "th", F.inline(once(F.struct(F.split("text", "\n").alias("lines"), "parts"), lambda x: F.transform(x["parts"], lambda s: beside(x["lines"], s)))))
    same = materialize(found.withColumn("h", F.xxhash64("chunk")))
    place = F.struct(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("d"), "th", "first")
    kept = same.groupBy("h", "chunk").agg(F.min(F.struct(place.alias("p"), "before", "after")).alias("k"))
    gone = same.join(kept, ["h", "chunk"]).where(place != F.col("k.p"))
    gone = gone.select("doc_id", "th", "first", (F.col("first") - _like(F.col("before"), F.col("k.before"))).alias("a"), (F.col("last") + _like(F.col("after"), F.col("k.after"))).alias("b")).distinct()
    # runs that touch are one
    w = W.partitionBy("doc_id", "th").orderBy("a", "b")
    far = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    gone = gone.withColumn("opens", F.coalesce((F.col("a") > far + 1).cast("int"), F.lit(1)))
    gone = gone.withColumn("run", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = gone.groupBy("doc_id", "th", "run").agg(F.min("a").alias("first"), F.max("b").alias("last"), F.count(F.lit(1)).alias("n"))
    return runs.groupBy("doc_id", "th").agg(F.sum("n").alias("chunks"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("removed"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the removed runs of lines (sorted, apart): what lies between them, in one pass."""

    def rest(x: Column) -> Column:
        lines, runs = x["lines"], x["runs"]
        between = F.transform(runs, lambda r, k: _run(lines, F.coalesce(F.get(runs, k - 1)["last"] + 1, F.lit(0)), r["first"] - 1))
        tail = _run(lines, F.element_at(runs, -1)["last"] + 1, F.size(lines) - 1)
        return F.array_join(F.flatten(F.concat(between, F.array(tail))), "\n")

    return F.when(removed.isNull(), text).otherwise(once(F.struct(F.split(text, "\n").alias("lines"), removed.alias("runs")), rest))


def strip_repeats(docs: DataFrame, window: int = WINDOW, reach: int = REACH) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``, all columns kept, and
    ``n_removed_lines``, ``n_removed_chunks`` at the end."""
    names = docs.columns
    at = {n: place_of(names, n) for n in ("doc_id", "text")}
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    did, text = F.col(f"__c{at['doc_id']}"), F.col(f"__c{at['text']}")
    gone = dedup_lines(docs, window, reach).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), F.col("removed").alias("__r"), F.col("chunks").alias("__n"))
    out = plain.join(gone, did.cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(text.cast("string")) == F.col("__t")), "left")
    n = lambda f: F.coalesce(f, F.lit(0)).cast("long")
    lost = F.aggregate("__r", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    cols = [(without_lines(text, F.col("__r")) if i == at["text"] else F.col(f"__c{i}")).alias(f"__o{i}") for i in range(len(names))]
    return out.select(*cols, n(lost).alias("__l"), n(F.col("__n")).alias("__m")).toDF(*names, "n_removed_lines", "n_removed_chunks")
