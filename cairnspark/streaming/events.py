"""Event streams: batch and streaming forms of the same operators.

Frames have ts (timestamp), event_type, user_id, value; ``windowed`` and
``sessions`` work on streams as they are (with a watermark).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEGRADED, UNHEALTHY = 2, 5

# The domain's event types.
EVENT_TYPES = (
    "IndexRebuild", "IndexingStarted", "IndexingProgress", "IndexingCompleted", "SyncCompleted", "CacheInvalidate", "SnapshotCreated",
    "FileChangesDetected", "ServiceStateChanged", "ConfigReloaded", "HealthCheckCompleted", "MetricsSnapshot", "SearchExecuted",
)


def micros(ts: Column) -> Column:
    """Microseconds since 1970, of timestamps with or without time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def seconds(ts: Column) -> Column:
    return F.floor(micros(ts) / 1_000_000).cast("long")


def by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def windowed(events: DataFrame, size: str, *keys: str, slide: str | None = None, watermark: str | None = None, **aggs: Column) -> DataFrame:
    """window_start, keys and the aggregates of tumbling or sliding windows."""
    e = events.withWatermark("ts", watermark) if watermark else events
    out = e.groupBy(F.window("ts", size, slide or size), *keys).agg(*[c.alias(n) for n, c in (aggs or {"n": F.count(F.lit(1))}).items()])
    return out.select(F.col("window.start").alias("window_start"), *keys, *(aggs or {"n": None}))


def sessions(events: DataFrame, gap: str, *keys: str, watermark: str | None = None) -> DataFrame:
    """Session windows: keys, session_start, session_end (last event + gap), n."""
    e = events.withWatermark("ts", watermark) if watermark else events
    out = e.groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def debounced(events: DataFrame, quiet: float, key: str, order: str = "event_id") -> DataFrame:
    """Events at which their key is synced: its first one, and then each that comes
    ``quiet`` seconds or more after the last sync.

    An event ``quiet`` seconds after the one before it is always a sync, so a key's
    events fall into bursts that do not depend on each other.  Bursts are dealt to
    tasks, sorted, and folded as they stream by: however long one is, no more of
    it than a batch is held.
    """
    w = W.partitionBy(key).orderBy("ts", order)
    wait, names = int(quiet * 1e6), events.columns
    gap = micros(F.col("ts")) - micros(F.lag("ts").over(w))
    opens = events.withColumn("__us", micros(F.col("ts"))).withColumn("__opens", F.coalesce((gap >= wait).cast("int"), F.lit(1)))
    bursts = opens.withColumn("__burst", F.sum("__opens").over(w.rowsBetween(W.unboundedPreceding, 0)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = None, 0
        for b in batches:
            taken = []
            for burst, us in zip(zip(b.column(key).to_pylist(), b.column("__burst").to_pylist(), strict=True), b.column("__us").to_pylist(), strict=True):
                taken.append(burst != of or us is None or us - last >= wait)
                if taken[-1]:
                    of, last = burst, us or 0
            yield b.filter(pa.array(taken, pa.bool_())).select(names)

    dealt = bursts.drop("__opens").repartition(key, "__burst").sortWithinPartitions(key, "__burst", "ts", order)
    return dealt.mapInArrow(fold, events.schema)


def health(reports: DataFrame, provider: str, ok: str, order: list[str]) -> DataFrame:
    """provider, failures (in a row, at the end), state.

    The last failure streak is what follows the last success: two aggregates, no
    sort of a provider's whole history.
    """
    last = reports.groupBy(provider).agg(F.max(F.when(F.col(ok), F.struct(*order))).alias("last_ok"))
    after = reports.where(~F.col(ok)).join(last, provider).where(F.col("last_ok").isNull() | (F.struct(*order) > F.col("last_ok")))
    n = last.select(provider).join(after.groupBy(provider).agg(F.count(F.lit(1)).alias("failures")), provider, "left")
    n = n.select(provider, F.coalesce("failures", F.lit(0)).alias("failures"))
    return n.withColumn("state", F.when(F.col("failures") >= UNHEALTHY, "unhealthy").when(F.col("failures") >= DEGRADED, "degraded").otherwise("healthy"))


def select_provider(states: DataFrame, provider: str, preferred: list, excluded: list) -> DataFrame:
    """The provider to use, one row, none if all are excluded.

    The first preferred one that is not unhealthy; else the healthiest, in list order.
    """
    rank = F.when(F.col("state") == "healthy", 0).when(F.col("state") == "degraded", 1).otherwise(2)
    wish = F.array_position(F.array(*map(F.lit, preferred)), F.col(provider)) if preferred else F.lit(0)
    first = F.when((wish > 0) & (rank < 2), wish).otherwise(F.lit(1 << 30))
    keep = states.where(~F.col(provider).isin(excluded)) if excluded else states
    return keep.orderBy(first, rank, provider).limit(1)


def cache_fold(ops: DataFrame, key: str, order: list[str], ttl: float, now: Column) -> DataFrame:
    """key, value of the live entries: last write wins, entries older than ``ttl`` seconds are gone.

    ``ops``: key, kind ("set" or "delete"), value, ts.
    """
    last = ops.groupBy(key).agg(F.max_by(F.struct("kind", "value", "ts"), F.struct(*order)).alias("r")).select(key, "r.*")
    return last.where((F.col("kind") == "set") & (micros(now) - micros(F.col("ts")) <= int(ttl * 1e6))).select(key, "value")


def held(samples: DataFrame, value: str, threshold: float, hold: int, key: str, span: int = 3600) -> DataFrame:
    """Samples whose key stood above ``threshold`` for the last ``hold`` seconds.

    A key's time is cut into spans; a sample also stands in the next span if one
    there can look back to it, so that a key with most samples is many tasks' work.
    """
    span = max(span, hold)
    at = seconds(F.col("ts"))
    own = F.floor(at / span).cast("long")
    late = F.when(F.pmod(at, F.lit(span)) >= span - hold, F.array(F.struct((own + 1).alias("span"), F.lit(False).alias("own")))).otherwise(F.array().cast("array<struct<span:bigint,own:boolean>>"))
    each = samples.withColumn("__s", F.explode(F.concat(F.array(F.struct(own.alias("span"), F.lit(True).alias("own"))), late)))
    w = W.partitionBy(key, "__s.span").orderBy(at).rangeBetween(-hold, 0)
    return each.withColumn("low", F.min(value).over(w)).where(F.col("__s.own") & (F.col("low") > threshold)).drop("low", "__s")


def exact_quantile(samples: DataFrame, value: str, p: float, key: str, width: float = 1.0) -> DataFrame:
    """key, quantile: the interpolated quantile of each key's values, exactly.

    Counts of buckets of ``width`` say in which bucket the two ranks lie; only
    those buckets' values are ranked.
    """
    s = samples.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"), F.floor(F.col(value) / width).cast("long").alias("b"))
    w = W.partitionBy(key).orderBy("b")
    b = s.groupBy(key, "b").agg(F.count(F.lit(1)).alias("n"))
    b = b.withColumn("upto", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("pos", p * (F.sum("n").over(W.partitionBy(key)) - 1))
    b = b.select(key, "b", (F.col("upto") - F.col("n")).alias("before"), "upto", "pos", F.floor("pos").alias("lo"), F.ceil("pos").alias("hi"))
    b = b.where("before <= hi and upto > lo")
    ranked = s.join(b, [key, "b"]).withColumn("rank", F.row_number().over(W.partitionBy(key, "b").orderBy("v")) - 1 + F.col("before"))
    x = lambda r: F.max(F.when(F.col("rank") == F.col(r), F.col("v")))
    out = ranked.where("rank = lo or rank = hi").groupBy(key).agg(x("lo").alias("x"), x("hi").alias("y"), F.first(F.col("pos") - F.col("lo")).alias("f"))
    return out.select(key, (F.col("x") + (F.col("y") - F.col("x")) * F.col("f")).alias("quantile"))


def predict_linear(samples: DataFrame, value: str, ahead: float, *keys: str, now: Column | None = None) -> DataFrame:
    """keys, slope, predicted value ``ahead`` seconds after the last sample (or ``now``)."""
    x = seconds(F.col("ts")).cast("double") - 1_704_067_200
    at = F.max(x) if now is None else now
    out = samples.groupBy(*keys).agg(F.regr_slope(F.col(value), x).alias("slope"), F.regr_intercept(F.col(value), x).alias("icept"), at.alias("at"))
    return out.select(*keys, "slope", (F.col("icept") + F.col("slope") * (F.col("at") + ahead)).alias("predicted"))


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of parquet files; what backpressure there is, is the files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def decode(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON payloads as columns; undecodable ones are dropped."""
    return raw.select(F.from_json(column, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("e")).where("e is not null and e._bad is null").select("e.*").drop("_bad")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into parquet; the result as a table."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def upsert_counts(path: str, key: str = "event_type"):
    """foreachBatch sink: counts by key merged into a table, one version a batch."""

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        if number:
            old = batch.sparkSession.read.schema(new.schema).parquet(f"{path}/{number - 1}")
            new = old.unionByName(new).groupBy(key).agg(F.sum("n").alias("n"))
        new.write.mode("overwrite").parquet(f"{path}/{number}")

    return merge


def stream_debounced(events: DataFrame, seconds: float, key: str) -> DataFrame:
    """Streaming debounce: key, ts, of the events ``seconds`` or more after the key's last sync."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for b in batches:
            out = []
            for t in sorted(b["ts"]):
                us = int(t.value // 1000)
                if last is None or us - last >= seconds * 1e6:
                    out.append(t)
                    last = us
            yield pd.DataFrame({key: [k[0]] * len(out), "ts": out})
        state.update((last,))

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp", "last long", "append", "NoTimeout")


def stream_health(reports: DataFrame, provider: str, ok: str) -> DataFrame:
    """Streaming health: provider, failures, state after each batch.

    Within a batch reports are taken by ts.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for b in batches:
            for good in b.sort_values("ts")[ok]:
                n = 0 if good else n + 1
        state.update((n,))
        yield pd.DataFrame({provider: [k[0]], "failures": [n], "state": ["unhealthy" if n >= UNHEALTHY else "degraded" if n >= DEGRADED else "healthy"]})

    kind = reports.schema[provider].dataType.simpleString()
    return reports.groupBy(provider).applyInPandasWithState(step, f"{provider} {kind}, failures long, state string", "n long", "update", "NoTimeout")
