"""Streams whose answers come with time, not with an event.

Rows of a key wait in its state until the watermark has passed them and are then
taken in order of time, so the order in which they arrive does not matter, and a
row later than the watermark is left out.  A timer in event time wakes a key
when its next waiting row, or what it has announced, is due: an alert fires
although nothing new came.  Sessions that end by themselves need none of this
(``events.sessions``).  The state store has to be RocksDB (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALERTS = "since timestamp, fires_at timestamp, peak double"
SILENCES = "last_seen timestamp, silent_at timestamp, n long"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


#: A waiting row, and rows that are packed into one value of the state or taken at once.
ROW, PACK = np.dtype([("at", np.int64), ("value", np.float64)]), 65_536


class InOrder(StatefulProcessor):
    """Takes a key's rows (ts in milliseconds, value) in order of time, once the watermark has passed them.

    Waiting rows are packed, 16 bytes each; Python objects are made of ``PACK`` rows at a time.
    """

    key: str

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.now = handle.getValueState("now", "a long, b long, c double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for b in rows:
            new.append(np.empty(len(b), ROW))
            new[-1]["at"] = b["ts"].to_numpy("datetime64[ns]").astype(np.int64) // 1_000_000
            new[-1]["value"] = b["value"].to_numpy(float)
        yield from self.advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, [], timerValues.getCurrentWatermarkInMs())

    def advance(self, key: tuple, new: list[np.ndarray], upto: int) -> Iterator[pd.DataFrame]:
        held = np.concatenate([np.empty(0, ROW), *[np.frombuffer(bytes(r[0]), ROW) for r in self.waiting.get()], *new])
        held = held[np.lexsort((held["value"], held["at"]))]
        n = int(np.searchsorted(held["at"], upto))
        state, wake = self.now.get() if self.now.exists() else None, None
        for lo in range(0, max(n, 1), PACK):
            hi = min(lo + PACK, n)
            # what the next row's time tells, the last rows may be told already
            until = int(held["at"][hi]) if hi < n else upto
            state, out, wake = self.fold(state or (None, None, None), held[lo:hi].tolist(), until)
            yield pd.DataFrame([(key[0], *r) for r in out], columns=[self.key, *self.columns]).astype({c: "datetime64[ns]" for c in self.columns[:2]})
        if state is None:
            self.now.clear()
        else:
            self.now.update(state)
        later = held[n:]
        if len(later):
            self.waiting.put([(later[i : i + PACK].tobytes(),) for i in range(0, len(later), PACK)])
        else:
            self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        times = [t for t in (wake, int(later["at"][0]) + 1 if len(later) else None) if t is not None]
        if times:
            self.handle.registerTimer(max(min(times), upto + 1))

    def close(self) -> None:
        pass


def ms(t: int) -> pd.Timestamp:
    return pd.Timestamp(t, unit="ms")


class HoldAlerts(InOrder):
    """State: since when the key stands above the threshold, whether it has fired, its peak."""

    columns = ("since", "fires_at", "peak")

    def __init__(self, key: str, threshold: float, hold: float):
        self.key, self.threshold, self.hold = key, threshold, int(hold * 1000)

    def fold(self, state: tuple, due: list, upto: int) -> tuple:
        since, fired, peak = state
        out = []

        def fire(t: int) -> None:
            nonlocal fired
            if since is not None and not fired and t > since + self.hold:
                out.append((ms(since), ms(since + self.hold), peak))
                fired = 1

        for t, v in due:
            fire(t)
            if v > self.threshold:
                since, fired, peak = (t, 0, v) if since is None else (since, fired, peak if t > since + self.hold else max(peak, v))
            else:
                since = fired = peak = None
        fire(upto)
        wake = since + self.hold + 1 if since is not None and not fired else None
        return (since, fired, peak) if since is not None else None, out, wake


class Silences(InOrder):
    """State: the last row's time, whether its silence was told, and how many rows there were."""

    columns = ("last_seen", "silent_at", "n")

    def __init__(self, key: str, after: float):
        self.key, self.after = key, int(after * 1000)

    def fold(self, state: tuple, due: list, upto: int) -> tuple:
        last, told, n = state
        n, out = int(n or 0), []

        def tell(t: int) -> None:
            nonlocal told
            if last is not None and not told and t > last + self.after:
                out.append((ms(last), ms(last + self.after), n))
                told = 1

        for t, _ in due:
            tell(t)
            last, told, n = t, 0, n + 1
        tell(upto)
        return (last, told, float(n)) if last is not None else None, out, last + self.after + 1 if last is not None and not told else None


def _run(events: DataFrame, key: str, value: str, watermark: str, processor: InOrder, columns: str) -> DataFrame:
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "ts", F.col(value).cast("double").alias("value")).where(f"`{key}` is not null and ts is not null and value is not null")
    return rows.withWatermark("ts", watermark).groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {columns}", "Append", "eventTime")


def hold_alerts(events: DataFrame, key: str, value: str, threshold: float, hold: float, watermark: str) -> DataFrame:
    """key, since, fires_at, peak: each time a key has stood above ``threshold`` for more than ``hold`` seconds.

    ``peak`` is the highest value up to the firing.  The alert fires when the
    watermark passes its time, new event or not.
    """
    return _run(events, key, value, watermark, HoldAlerts(key, threshold, hold), ALERTS)


def silences(events: DataFrame, key: str, after: float, watermark: str) -> DataFrame:
    """key, last_seen, silent_at, n: each time a key was silent for more than ``after`` seconds; n counts its rows so far."""
    return _run(events.withColumn("__one", F.lit(1)), key, "__one", watermark, Silences(key, after), SILENCES)


# ---- the same over a table


def _millis(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def hold_alerts_of(events: DataFrame, key: str, value: str, threshold: float, hold: float, until: Column | None = None) -> DataFrame:
    """``hold_alerts`` of all rows of a table; ``until`` (milliseconds) is the watermark, by default behind everything."""
    rows = events.where(f"`{key}` is not null and ts is not null and `{value}` is not null").select(key, _millis("ts").alias("at"), F.col(value).cast("double").alias("value"))
    w = W.partitionBy(key).orderBy("at", "value")
    rows = rows.withColumn("above", F.col("value") > threshold)
    rows = rows.withColumn("streak", F.sum((~F.col("above")).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    # a streak is what follows a sample that is not above; the next such sample ends it
    each = rows.groupBy(key, "streak").agg(F.min(F.when(F.col("above"), F.col("at"))).alias("since"))
    ends = rows.where("not above").groupBy(key, (F.col("streak") - 1).alias("streak")).agg(F.min("at").alias("end"))
    due = F.col("since") + int(hold * 1000)
    last = F.lit(1 << 62) if until is None else until
    alerts = each.where("since is not null").join(ends, [key, "streak"], "left").where(F.least(F.coalesce("end", last), last) > due)
    peak = rows.where("above").join(alerts.select(key, "streak", due.alias("due")), [key, "streak"]).where("at <= due").groupBy(key, "streak").agg(F.max("value").alias("peak"))
    return alerts.join(peak, [key, "streak"]).select(key, F.timestamp_millis("since").alias("since"), F.timestamp_millis(due).alias("fires_at"), "peak")


def silences_of(events: DataFrame, key: str, after: float, until: Column | None = None) -> DataFrame:
    """``silences`` of all rows of a table."""
    rows = events.where(f"`{key}` is not null and ts is not null").select(key, _millis("ts").alias("at"))
    w = W.partitionBy(key).orderBy("at")
    rows = rows.select(key, "at", F.lead("at").over(w).alias("next"), F.row_number().over(w).cast("long").alias("n"))
    due = F.col("at") + int(after * 1000)
    last = F.lit(1 << 62) if until is None else until
    return rows.where(F.least(F.coalesce("next", last), last) > due).select(key, F.timestamp_millis("at").alias("last_seen"), F.timestamp_millis(due).alias("silent_at"), "n")


# ---- repeated events, and events that belong together


def deduplicated(events: DataFrame, key: str, watermark: str) -> DataFrame:
    """Each key once, however often it comes within the watermark; the state forgets it after that."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def completions(started: DataFrame, completed: DataFrame, key: str, within: str, watermark: str) -> DataFrame:
    """key, started_at, completed_at of each start with the ends of its key up to ``within`` later; null where none came.

    On a stream a start without an end is told once the watermarks have passed
    the time by which it could have come.
    """
    a = started.select(F.col(key), F.col("ts").alias("started_at")).withWatermark("started_at", watermark)
    b = completed.select(F.col(key).alias("__k"), F.col("ts").alias("completed_at")).withWatermark("completed_at", watermark)
    on = (F.col(key) == F.col("__k")) & (F.col("completed_at") >= F.col("started_at")) & (F.col("completed_at") <= F.col("started_at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on, "left_outer").select(key, "started_at", "completed_at")
