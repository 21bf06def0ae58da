"""Mixing sources to target weights along a time-varying curriculum.

Native: DataFrame functions only.

Targets.  Sources, by code point with null last, weigh 1, 2, 3, repeating, and
share all words; a target stops at ``max_epochs`` times its source's words and
the excess is shared anew by weight (the water level of a sorted prefix sum).

Selection.  Each source's documents stand in a hashed order that depends on the
document alone.  ``full`` whole passes fit the target.  Of the last pass the
longest run of documents that fit is taken, then, of those left that are no
larger than what is still open, again the longest run, and so on until none is;
so a very long document is passed over, not waited for.  At last one document may
be taken that brings the source nearer to its target.  Documents are taken whole.

Curriculum.  A source's weight over training time t in [0, 1] is piecewise
linear, given at equally spaced knots (``schedules``, by the source's weight).
Integrated and normalised it is the share of the source's words that training
has asked for by t; a copy whose words begin at share f of the source's target
is placed at the t where that integral reaches f.  Sorting by position (a range
partitioning) gives the training order.

Scale.  Prefix sums run within (source, hash bucket) and over bucket totals, so
a source with a third of all rows is spread over many tasks.  The number of
buckets follows the number of rows.

Edge cases.  A null or empty text has size 0: it is taken 0 times and has no
position.  A null source is a source of its own.  Repeated rows are documents
of their own.  Column names may differ in case; extra columns do no harm.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, md5_int, pick, place_of, word_count

MAX_EPOCHS, ROWS_PER_BUCKET, HASH_BITS = 3, 5_000, 48
#: Weight over training time by a source's weight: early, even, late.
SCHEDULES = {1: (1.5, 1.0, 0.5), 2: (1.0, 1.0, 1.0), 3: (0.5, 1.0, 1.5)}


def place(doc_id: str, text: str, source: str) -> Column:
    """A document's place in its source's order: a hash of the document alone."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return md5_int(F.concat_ws("#", part(doc_id), part(source), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))), HASH_BITS // 4)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, u) with u the document's place in its source."""
    d = pick(docs, doc_id="long", text="string", source="string")
    return d.select("doc_id", "source", word_count(F.col("text")).alias("size"), place("doc_id", "text", "source").alias("u"))


def source_targets(totals: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size).

    One row a source: the windows without keys sort that small table only.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    t = totals.select("source", "source_size", ((F.row_number().over(order) - 1) % 3 + 1).cast("long").alias("weight"))
    t = t.withColumn("cap", F.lit(max_epochs).cast("long") * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = W.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    t = (
        t.withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("water", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    # the first level that holds its water; the last always does
    fits = F.when(F.col("water") <= F.col("level"), F.col("water"))
    t = t.withColumn("water", F.first(fits, ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce("water", F.col("level")) * F.col("weight"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def _bucketed(s: DataFrame, rows_per_bucket: int) -> DataFrame:
    """``s`` and ``bucket``: ranges of u with few rows."""
    buckets = max(1, -(-s.count() // rows_per_bucket))
    return s.withColumn("bucket", F.expr(f"u div {(1 << HASH_BITS) // buckets + 1}"))


def _before(s: DataFrame, words: Column, name: str, order: tuple[str, ...]) -> DataFrame:
    """``s`` and, as ``name``, the sum of ``words`` over the source's documents before."""
    s = s.withColumn("__w", words)
    w = W.partitionBy("source", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    b = s.groupBy("source", "bucket").agg(F.sum("__w").alias("all"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    b = b.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("__a"))
    s = s.withColumn("__s", F.sum("__w").over(w) - F.col("__w"))
    s = s.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return s.withColumn(name, F.col("__s") + F.col("__a")).drop("__w", "__s", "__a", "s", "b")


def _with_gap(d: DataFrame) -> DataFrame:
    """``d`` and ``gap``: the words of the last pass that its source still wants."""
    gap = d.groupBy("source").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0))).alias("gap"))
    gap = gap.select(F.col("source").alias("g"), "gap")
    return d.join(gap, F.col("source").eqNullSafe(F.col("g"))).drop("g")


def position(share: Column, weight: Column, schedules: dict[int, tuple[float, ...]] = SCHEDULES) -> Column:
    """The t at which the integral of the weight's schedule reaches ``share`` of its whole."""
    out = None
    for w, knots in schedules.items():
        step = 1 / (len(knots) - 1)
        area = [0.0]
        for a, b in zip(knots, knots[1:], strict=False):
            area.append(area[-1] + step * (a + b) / 2)
        ask, t = share * area[-1], F.lit(1.0)
        for i in reversed(range(len(knots) - 1)):
            a, slope, left = knots[i], (knots[i + 1] - knots[i]) / step, ask - area[i]
            # a x + slope x^2 / 2 = left, in the form that is stable for a slope of 0
            x = 2 * left / (a + F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + 2 * slope * left)))
            t = F.when(ask < area[i + 1], i * step + F.coalesce(x, F.lit(0.0))).otherwise(t)
        out = F.when(weight == w, t) if out is None else out.when(weight == w, t)
    return out


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, u, size, source, source_size, weight, target, start, full, copies, taken and the first copy's position."""
    s = materialize(sized(docs))
    goals = source_targets(s.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs)
    goals = materialize(
        goals.withColumn("goal", F.round("target").cast("long"))
        .withColumn("full", F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs).cast("long"), F.expr("goal div source_size"))).otherwise(F.lit(0).cast("long")))
        .withColumn("rest", F.greatest(F.lit(0).cast("long"), F.when(F.col("full") < max_epochs, F.col("goal") - F.col("full") * F.col("source_size")).otherwise(F.lit(0))))
        .withColumnRenamed("source", "g")
    )
    d = _before(_bucketed(s, rows_per_bucket), F.col("size"), "start", ("u", "doc_id", "size"))
    d = d.join(goals, F.col("source").eqNullSafe(F.col("g"))).drop("g").withColumn("fits", F.lit(False))
    d = materialize(_with_gap(d))
    left = ~F.col("fits") & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
    while not d.where(left).isEmpty():
        d = _before(d, F.when(left, F.col("size")).otherwise(F.lit(0)), "open", ("start", "size"))
        d = d.withColumn("fits", F.col("fits") | (left & (F.col("open") + F.col("size") <= F.col("gap")))).drop("open", "gap")
        d = materialize(_with_gap(d))
    # one further document may come nearer
    off = F.abs(F.col("gap") - F.col("size"))
    near = d.where(~F.col("fits") & (F.col("size") > 0) & (off < F.col("gap"))).groupBy(F.col("source").alias("g")).agg(F.min(F.struct(off.alias("off"), "start")).alias("pick"))
    d = d.join(near.select("g", F.col("pick.start").alias("extra")), F.col("source").eqNullSafe(F.col("g")), "left").drop("g")
    d = d.withColumn("fits", F.col("fits") | F.coalesce((F.col("extra") == F.col("start")) & (F.col("size") > 0), F.lit(False)))
    d = d.withColumn("copies", F.when(F.col("size") > 0, F.col("full") + F.col("fits").cast("long")).otherwise(F.lit(0).cast("long")))
    share = (F.col("start") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0))
    at = F.when(F.col("copies") > 0, position(F.least(F.lit(1.0), share), F.col("weight"), schedules))
    return d.select(
        "doc_id", "u", "size", "source", "source_size", "weight", "target", "start", "full", "copies",
        (F.col("size") * F.col("copies")).alias("taken"), at.alias("position"),
    )


def training_order(mixed: DataFrame, schedules=SCHEDULES, ordered: bool = True) -> DataFrame:
    """One row a copy, (doc_id, u, copy, position), range-sorted by position."""
    c = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    share = (F.col("start") + F.col("copy") * F.col("source_size") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0))
    at = position(F.least(F.lit(1.0), share), F.col("weight"), schedules)
    c = c.select("doc_id", "u", "copy", at.alias("position"))
    return c.orderBy("position", "u", "copy") if ordered else c


def mixed_documents(docs: DataFrame, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """The rows of ``docs`` that training sees, each as often as the mix takes
    it, range-sorted by position.  Rows that agree in doc_id, source and text are
    the same document; of their other columns those of the least hash are kept."""
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    at = {n: f"__c{place_of(names, n)}" for n in ("doc_id", "text", "source")}
    plain = plain.withColumn("__u", place(at["doc_id"], at["text"], at["source"])).withColumn("__d", F.col(at["doc_id"]).cast("long"))
    mixed = materialize(mix(docs, max_epochs, schedules))
    order = training_order(mixed, schedules, ordered=False).select(F.col("doc_id").alias("__e"), F.col("u").alias("__v"), "position", "copy")
    same = lambda d, u: F.col("__d").eqNullSafe(F.col(d)) & (F.col("__u") == F.col(u))
    again = materialize(mixed.groupBy(F.col("doc_id").alias("__x"), F.col("u").alias("__y")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"))
    if not again.isEmpty():  # only repeated rows are brought together
        first = W.partitionBy("__d", "__u").orderBy(F.xxhash64(*[F.to_json(F.struct(c)) for c in plain.columns]))
        one = plain.join(again, same("__x", "__y"), "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        plain = plain.join(again, same("__x", "__y"), "left_anti").unionByName(one)
    out = plain.join(order, same("__e", "__v"))
    return out.orderBy("position", "__u", "copy").select(*[f"__c{i}" for i in range(len(names))]).toDF(*names)
