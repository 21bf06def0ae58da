"""Quality rules with adaptive thresholds.

Per document, counts are taken over the whole text.  Three of the metrics are
shares: symbols of symbols and words, repeated lines of lines, repeated words of
words; the fourth is the mean length of words.  They go into mergeable quantile
sketches for each language and source: histograms whose buckets are exact up to
127 and keep 6 leading bits above (a relative error of 1/64), so that merging is
adding counts, any order of partial merges gives the same sketch, and SQL can
repeat it.

A share k of n enters its sketch as (k + e/2) / (n + e), where e is what a single
event adds to k, so that a group of zeros has a spread, given by how much text
its zeros rest on.  Its fence has ``reach`` times the odds of a tail quantile and
therefore always lies below 1.  A document is outside when k - e of n is beyond
the fence: a single symbol, repeated line or repeated window proves nothing.  The fence of the word length lies ``reach`` times
the distance from the median to the tail quantile beyond that quantile, on both
sides.

Quantiles shrink towards those of the language, and these towards those of
everything, by the weight of ``prior`` documents: q = (n q + prior q') / (n +
prior).  The joined filter then rejects a document that lies outside a fence.

Edge cases.  A null text has no words.  A document that fails the base rules, as
one without words does, enters no sketch; in a group without sketches only the
base rules hold.  Null languages and sources are groups of their own.
Repeated rows count each, ties share a bucket.  An empty table gives an empty
result.  Other columns, whatever their names, are not read.  Of a very long text
a task holds the numbers of its words, some 30 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, pick

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
REACH, PRIOR = 3, 100
#: Parts of one in which metrics are counted.
UNIT = 1_000_000
#: share: (k, n, what one event adds to k, tail quantile in thousandths); the least repeat is that of three words found
#: twice, and as the base rules leave at most half of the words repeated, the share is that of this half
SHARES = {"symbol_share": ("n_symbols", "n_symbols + n_words", 1, 800), "dup_line_share": ("n_dup_lines", "n_lines", 1, 995), "repeat_share": ("2 * n_repeat_words", "n_words", 12, 995)}
#: Tail quantiles of the word length lie so far from the ends; its fences lie a tenth of a character or more beyond them.
LENGTH, LENGTH_TAIL, LENGTH_LEAST = "word_length", 900, UNIT // 10
METRICS = (*SHARES, LENGTH)
#: Documents that fail the base rules go anyway, and are not what others are measured by.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found at least twice; words are given by numbers."""
    if len(words) <= width:
        return 0
    base, window = int(words.max()) + 1, words
    for k in range(1, width):
        window = pa.array(window[:-1] * base + words[k:]).dictionary_encode().indices.to_numpy().astype(np.int64)
    twice = np.bincount(window)[window] > 1
    if not twice.any():
        return 0
    inside = np.zeros(len(words), bool)
    for k in range(width):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


def text_counts(texts: pa.Array) -> list[tuple[int, ...]]:
    """COUNTS of whole texts."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = lists.flatten()
    number = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    out = []
    for i, text in enumerate(texts):
        t = text.as_py() or ""
        words = number[ends[i] : ends[i + 1]][full[ends[i] : ends[i + 1]]]
        lines = [x for x in t.encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]  # bytes strip exactly the six ASCII white-space characters
        out.append((
            len(words), len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeated_words(words),
        ))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = list(zip(*text_counts(b.column("text")), strict=True)) or [()] * 6
        keep = [b.column(c) for c in ("doc_id", "lang", "source")]
        yield pa.RecordBatch.from_arrays(keep + [pa.array(c, pa.int64()) for c in cols], ["doc_id", "lang", "source", *COUNTS])


def document_counts(docs: DataFrame) -> DataFrame:
    d = pick(docs, doc_id="long", text="string", lang="string", source="string")
    return d.mapInArrow(_count, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def rates(d: DataFrame) -> DataFrame:
    """``d`` with METRICS in parts of UNIT; null without words."""
    for m, (k, n, *_) in SHARES.items():
        d = d.withColumn(m, F.expr(f"if(n_words > 0, ({UNIT} * {k}) div ({n}), null)"))
    return d.withColumn(LENGTH, F.expr(f"if(n_words > 0, ({UNIT} * word_chars) div n_words, null)"))


def sketch_bucket(v: Column) -> Column:
    """The lower end of the value's bucket: 7 leading bits are kept."""
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(d: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the sketch of every language and source."""
    value = {m: F.expr(f"({UNIT} * (2 * {k} + {one})) div (2 * ({n} + {one}))") for m, (k, n, one, _) in SHARES.items()} | {LENGTH: F.col(LENGTH)}
    long = d.where(f"NOT ({BASE_FAILED})").select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), sketch_bucket(v).alias("bucket")) for m, v in value.items()])).alias("x")
    )
    return long.select("lang", "source", "x.metric", "x.bucket").groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sk: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, docs, low, mid, high) of sketches merged to ``keys``: the median and both tail quantiles."""
    m = sk.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "metric")
    m = m.withColumn("docs", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
    tail = F.coalesce(*[F.when(F.col("metric") == k, F.lit(t)) for k, (*_, t) in SHARES.items()], F.lit(LENGTH_TAIL))
    at = lambda part: F.min(F.when(F.col("upto") * 1000 >= part * F.col("docs"), F.col("bucket")))
    return m.groupBy(*keys, "metric").agg(F.max("docs").alias("docs"), at(1000 - tail).alias("low"), at(F.lit(500)).alias("mid"), at(tail).alias("high"))


def thresholds(sk: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """One row a (lang, source): <metric>_low and <metric>_high."""
    q = ("docs", "low", "mid", "high")
    own = quantiles(sk, "lang", "source")
    lang = quantiles(sk, "lang").select(F.col("lang").alias("l"), F.col("metric").alias("ml"), *[F.col(x).alias(f"l_{x}") for x in q])
    # at most one row for each of the four metrics
    every = F.broadcast(quantiles(sk).select(F.col("metric").alias("me"), *[F.col(x).alias(f"e_{x}") for x in q]))
    t = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("ml"))).join(every, F.col("metric") == F.col("me"))
    for x in q[1:]:
        t = t.withColumn(f"l_{x}", F.expr(f"(l_docs * l_{x} + {prior} * e_{x}) div (l_docs + {prior})"))
        t = t.withColumn(x, F.expr(f"(docs * {x} + {prior} * l_{x}) div (docs + {prior})"))
    at = lambda m, e: F.max(F.when(F.col("metric") == m, F.expr(e)))
    fences = [at(m, f"({reach} * high * {UNIT}) div ({UNIT} - high + {reach} * high)").alias(f"{m}_high") for m in SHARES]
    fences.append(at(LENGTH, f"high + {reach} * greatest(high - mid, {LENGTH_LEAST})").alias(f"{LENGTH}_high"))
    fences.append(at(LENGTH, f"low - {reach} * greatest(mid - low, {LENGTH_LEAST})").alias(f"{LENGTH}_low"))
    return t.groupBy("lang", "source").agg(*fences)


#: What is outside a fence, by metric.
OUTSIDE = {m: f"{UNIT} * ({k} - {one}) > {m}_high * ({n})" for m, (k, n, one, _) in SHARES.items()} | {LENGTH: f"{LENGTH} > {LENGTH}_high OR {LENGTH} < {LENGTH}_low"}


def judge_quality(docs: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept."""
    d = rates(materialize(document_counts(docs)))
    t = thresholds(sketches(d), reach, prior).withColumnsRenamed({"lang": "l", "source": "s"})
    d = d.join(t, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    base = F.expr(BASE_FAILED)
    outside = F.coalesce(F.expr(" OR ".join(f"({x})" for x in OUTSIDE.values())), F.lit(False))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~outside).alias("kept"), *METRICS,
    )
