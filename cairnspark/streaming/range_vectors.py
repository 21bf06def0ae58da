"""Metrics over ranges of time: increases of counters, averages, ratios.

Samples are (labels, ts, value).  They are folded once into buckets of a few
minutes, a small table that can be stored and appended to; a range of any
length is then the difference of two running sums over buckets, so a window of
thirty days costs what one of five minutes does.  A counter's increase goes on
over a reset, at which it begins again at 0; between two samples it belongs to
the later one's bucket.  A series is cut into spans that tasks take apart, each
beginning with the last sample of the one before, so a series with most samples
is many tasks' work.

Times are whole seconds since 1970, ranges end with their bucket and are whole
numbers of buckets.  Null values and times are left out, null labels are labels
like others; equal times of a series are ordered by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .events import seconds

#: How a label is compared; patterns hold for the whole value, and a missing label is the empty one.
MATCHERS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v,
    "=~": lambda c, v: c.rlike(f"^(?:{v})$"), "!~": lambda c, v: ~c.rlike(f"^(?:{v})$"),
}


def matching(samples: DataFrame, **labels: tuple[str, str]) -> DataFrame:
    """Samples whose labels all match: ``matching(s, job=("=~", "api.*"), code=("!=", "200"))``."""
    for name, (how, value) in labels.items():
        samples = samples.where(MATCHERS[how](F.coalesce(F.col(name).cast("string"), F.lit("")), value))
    return samples


def increases(samples: DataFrame, keys: list[str], span: int = 86_400) -> DataFrame:
    """``samples`` (keys, ts, value) with ``at`` (seconds) and ``increase`` since the sample before; 0 at a series' first."""
    rows = samples.where("ts is not null and value is not null").withColumn("at", seconds(F.col("ts"))).withColumn("__span", F.floor(F.col("at") / span).cast("long"))
    order = ("ts", "value")
    last = rows.groupBy(*keys, "__span").agg(F.max(F.struct(*order)).alias("__l"))
    # a row a span
    before = last.withColumn("__before", F.lag("__l").over(W.partitionBy(*keys).orderBy("__span"))).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__span").alias("__s"), F.col("__before.value").alias("__before"))
    on = F.col("__span") == F.col("__s")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    w = W.partitionBy(*keys, "__span").orderBy(*order)
    out = rows.withColumn("__lag", F.lag("value").over(w)).join(before, on)
    prior = F.coalesce("__lag", "__before")
    grown = F.when(prior.isNull(), 0.0).when(F.col("value") >= prior, F.col("value") - prior).otherwise(F.col("value"))
    return out.withColumn("increase", grown).drop("__lag", "__before", "__span", "__s", *[f"__{k}" for k in keys])


def buckets(samples: DataFrame, keys: list[str], width: int = 300, counter: bool = False) -> DataFrame:
    """keys, bucket (its first second), n, total, increase, low, high: what ranges are made of; buckets without samples are not there."""
    rows = increases(samples, keys) if counter else samples.where("ts is not null and value is not null").withColumn("at", seconds(F.col("ts"))).withColumn("increase", F.lit(0.0))
    bucket = (F.floor(F.col("at") / width) * width).cast("long").alias("bucket")
    return rows.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum("increase").alias("increase"), F.min("value").alias("low"), F.max("value").alias("high"))


def over_range(parts: DataFrame, keys: list[str], length: int, width: int = 300) -> DataFrame:
    """keys, until (the end of a bucket with samples), n, total, increase of the ``length`` seconds up to it."""
    if length % width:
        raise ValueError(f"a range of {length} s is no whole number of buckets of {width} s")
    sums = ("n", "total", "increase")
    upto = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    run = parts.select(*keys, "bucket", *[F.sum(c).over(upto).alias(c) for c in sums])
    # the running sums where the range begins: those of the last bucket that has left it
    gone = run.select(*keys, (F.col("bucket") + length).alias("t"), F.lit(0).alias("kind"), F.struct(*sums).alias("left"), F.lit(None).alias("now"))
    here = run.select(*keys, F.col("bucket").alias("t"), F.lit(1).alias("kind"), F.lit(None).alias("left"), F.struct(*sums).alias("now"))
    both = gone.unionByName(here)
    w = W.partitionBy(*keys).orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("left", F.last("left", ignorenulls=True).over(w)).where("kind = 1")
    return out.select(*keys, (F.col("t") + width).alias("until"), *[(F.col(f"now.{c}") - F.coalesce(F.col(f"left.{c}"), F.lit(0))).alias(c) for c in sums])


def rate(parts: DataFrame, keys: list[str], length: int, width: int = 300) -> DataFrame:
    """keys, until, value: a counter's increase a second over the range."""
    return over_range(parts, keys, length, width).select(*keys, "until", (F.col("increase") / length).alias("value"))


def avg_over_time(parts: DataFrame, keys: list[str], length: int, width: int = 300) -> DataFrame:
    """keys, until, value: the mean of the range's samples."""
    return over_range(parts, keys, length, width).select(*keys, "until", (F.col("total") / F.col("n")).alias("value"))


def summed(vector: DataFrame, *by: str) -> DataFrame:
    """by, until, value: the sum of a vector's series that agree on some labels."""
    return vector.groupBy(*by, "until").agg(F.sum("value").alias("value"))


def ratio(above: DataFrame, below: DataFrame, keys: list[str]) -> DataFrame:
    """keys, until, value: one vector by another where both have a value and the second is not 0."""
    a, b = above.select(*keys, "until", F.col("value").alias("__a")), below.select(*keys, "until", F.col("value").alias("__b"))
    return a.join(b, [*keys, "until"]).where("__b != 0").select(*keys, "until", (F.col("__a") / F.col("__b")).alias("value"))


def holding(vector: DataFrame, keys: list[str], above: Column | float, hold: int) -> DataFrame:
    """keys, until, value where the series has been above a threshold, in all its values, for ``hold`` seconds, and for the first of them too."""
    w = W.partitionBy(*keys).orderBy("until")
    high = F.col("value") > above
    streak = vector.withColumn("__high", high).withColumn("__s", F.sum((~high).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    since = F.min(F.when(F.col("__high"), F.col("until"))).over(W.partitionBy(*keys, "__s"))
    return streak.withColumn("__since", since).where(F.col("__high") & (F.col("until") - F.col("__since") >= hold)).drop("__high", "__s", "__since")
