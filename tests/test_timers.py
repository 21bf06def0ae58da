"""Streams with timers, late and repeated rows against the same over a table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairnspark.streaming import events as ev, timers

SCHEMA = "event_id long, ts timestamp, key string, value double"
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    timers.use_rocksdb(spark)
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def rows_of(seed, n=160):
    """Three keys, one value a second and key, each up to 20 s late in arrival."""
    rng = random.Random(seed)
    out = []
    for key in "abc":
        at, high = 0, False
        for _ in range(n // 3):
            at += rng.choice([1, 1, 2, 3, 30])
            high = rng.random() < (0.85 if high else 0.3)
            out.append((at + rng.random() * 20, (len(out), START + dt.timedelta(seconds=at), key, rng.uniform(6, 9) if high else rng.uniform(1, 4))))
    return [r for _, r in sorted(out)]


def batches(spark, folder, rows, n):
    """One file a micro-batch, and one at the end that moves the watermark past everything."""
    size = -(-len(rows) // n)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    for i in range(2):
        spark.createDataFrame([(-1 - i, START + dt.timedelta(hours=5 + i), "end", 0.0)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def streamed(spark, tmp_path, make, rows, n=6):
    folder = str(tmp_path / "in")
    batches(spark, folder, rows, n)
    stream = ev.read_events(spark, folder, SCHEMA, files_per_trigger=1)
    return ev.run_available(make(stream), str(tmp_path / "out"), str(tmp_path / "ck")).where("key != 'end'")


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_fire_on_time(spark, tmp_path, seed):
    rows = rows_of(seed)
    got = streamed(spark, tmp_path, lambda s: timers.hold_alerts(s, "key", "value", 5.0, 6, "25 seconds"), rows)
    want = timers.hold_alerts_of(spark.createDataFrame(rows, SCHEMA), "key", "value", 5.0, 6)
    key = lambda df: sorted((r.key, r.since, r.fires_at, round(r.peak, 6)) for r in df.collect())
    assert key(got) == key(want) and len(key(want)) > 3


def test_alerts_by_hand(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, at(0), "a", 9.0), (2, at(5), "a", 7.0), (3, at(10), "a", 1.0), (4, at(20), "a", 6.0), (5, at(30), "a", 8.0), (6, at(31), "a", 2.0), (7, at(0), "b", 9.0), (8, None, "b", 1.0), (9, at(1), None, 9.0)]
    out = timers.hold_alerts_of(spark.createDataFrame(rows, SCHEMA), "key", "value", 5.0, 10)
    # a sample at the very end of the hold that is not above stops it; b never ends
    assert sorted((r.key, r.since.second, r.fires_at.second, r.peak) for r in out.collect()) == [("a", 20, 30, 8.0), ("b", 0, 10, 9.0)]


def test_silences(spark, tmp_path):
    rows = rows_of(3)
    got = streamed(spark, tmp_path, lambda s: timers.silences(s, "key", 10, "25 seconds"), rows)
    want = timers.silences_of(spark.createDataFrame(rows, SCHEMA), "key", 10)
    key = lambda df: sorted((r.key, r.last_seen, r.silent_at, r.n) for r in df.collect())
    assert key(got) == key(want) and len(key(want)) > 5


def test_repeated_events_count_once(spark, tmp_path):
    rows = rows_of(4)
    again = sorted([*rows, *random.Random(1).sample(rows, 60)], key=lambda r: r[1])
    got = streamed(spark, tmp_path, lambda s: timers.deduplicated(s, "event_id", "60 seconds"), again)
    assert sorted(r.event_id for r in got.collect()) == sorted(r[0] for r in rows)


def test_a_restart_in_mid_stream(spark, tmp_path):
    """Half of the files, a stop, the rest: the table is that of one run."""
    rows = rows_of(5)
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    make = lambda: timers.hold_alerts(ev.read_events(spark, folder, SCHEMA, 1), "key", "value", 5.0, 6, "25 seconds")
    for i in range(0, 80, 20):
        spark.createDataFrame(rows[i : i + 20], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    ev.run_available(make(), out, ck)
    batches(spark, folder, rows[80:], 3)
    got = ev.run_available(make(), out, ck).where("key != 'end'")
    want = timers.hold_alerts_of(spark.createDataFrame(rows, SCHEMA), "key", "value", 5.0, 6)
    key = lambda df: sorted((r.key, r.since, r.fires_at) for r in df.collect())
    assert key(got) == key(want)


def test_starts_with_and_without_an_end(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    start = [(1, at(0), "a", 0.0), (2, at(10), "b", 0.0), (3, at(20), "c", 0.0)]
    end = [(4, at(5), "a", 0.0), (5, at(100), "b", 0.0), (6, at(7), "a", 0.0)]
    stream = {}
    for name, rows in (("start", start), ("end", end)):
        folder = str(tmp_path / name)
        batches(spark, folder, rows, 2)
        stream[name] = ev.read_events(spark, folder, SCHEMA, 1)
    make = lambda a, b: timers.completions(a, b, "key", "30 seconds", "20 seconds")
    got = ev.run_available(make(stream["start"], stream["end"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    want = make(spark.createDataFrame(start, SCHEMA), spark.createDataFrame(end, SCHEMA))
    key = lambda df: sorted((r.key, r.started_at, str(r.completed_at)) for r in df.where(F.col("key") != "end").collect())
    assert key(got) == key(want) and [k[0] for k in key(want)] == ["a", "a", "b", "c"]
