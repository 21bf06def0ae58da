"""Ranges of metrics against sums over all samples of each range."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairnspark.streaming import range_vectors as rv

START = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)
SCHEMA = "job string, code string, ts timestamp, value double"


def samples(seed=1, n=250):
    """Counters of three series with resets, gaps of days, equal times and nulls."""
    rng, rows = random.Random(seed), []
    for job, code in (("api-a", "200"), ("api-b", "500"), ("web", None)):
        at, value = rng.randrange(500), 0.0
        for _ in range(n):
            at += rng.choice([10, 60, 200, 900, 90_000 if rng.random() < 0.1 else 5])
            value = float(rng.randrange(3)) if rng.random() < 0.08 else value + rng.randrange(20)
            rows.append((job, code, START + dt.timedelta(seconds=at), value))
    return [*rows, ("web", None, None, 5.0), ("web", None, START, None)]


def by_hand(rows, length, width=300):
    """{(job, until): (n, total, increase)}"""
    series = {}
    for job, _, ts, v in rows:
        if ts is not None and v is not None:
            series.setdefault(job, []).append((int(ts.timestamp()), v))
    out = {}
    for job, s in series.items():
        s.sort()
        inc = [0.0] + [b - a if b >= a else b for (_, a), (_, b) in zip(s, s[1:], strict=False)]
        for until in {t // width * width + width for t, _ in s}:
            inside = [i for i, (t, _) in enumerate(s) if until - length <= t < until]
            out[job, until] = (len(inside), sum(s[i][1] for i in inside), sum(inc[i] for i in inside))
    return out


@pytest.mark.parametrize("length", [300, 3600, 30 * 86_400])
def test_ranges_by_hand(spark, length):
    rows = samples()
    parts = rv.buckets(spark.createDataFrame(rows, SCHEMA).repartition(4), ["job", "code"], counter=True)
    got = {(r.job, r.until): (r.n, r.total, r.increase) for r in rv.over_range(parts, ["job", "code"], length).collect()}
    assert got == {k: pytest.approx(v) for k, v in by_hand(rows, length).items()}
    rates = {(r.job, r.until): r.value for r in rv.rate(parts, ["job", "code"], length).collect()}
    assert rates == {k: pytest.approx(v[2] / length) for k, v in by_hand(rows, length).items()}


def test_resets_and_first_samples(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [("a", "x", at(s), v) for s, v in ((0, 7.0), (10, 9.0), (20, 2.0), (100_000, 5.0), (100_000, 4.0))]
    out = rv.increases(spark.createDataFrame(rows, SCHEMA), ["job", "code"]).orderBy("ts", "value").collect()
    assert [r.increase for r in out] == [0, 2, 2, 2, 1]


def test_batches_of_buckets_add_up(spark):
    """Buckets of two batches, kept and appended, give what all samples give."""
    rows = [r for r in samples(3) if r[2] is not None]
    keys = ["job", "code"]
    cut = START + dt.timedelta(seconds=300 * 60)
    every = rv.buckets(spark.createDataFrame(rows, SCHEMA), keys)
    parts = [rv.buckets(spark.createDataFrame([r for r in rows if (r[2] < cut) == first], SCHEMA), keys) for first in (True, False)]
    key = lambda df: sorted((r.job, r.until, round(r.value, 6)) for r in rv.avg_over_time(df, keys, 86_400).collect())
    assert key(parts[0].unionByName(parts[1])) == key(every)


def test_matchers_sums_and_ratios(spark):
    df = spark.createDataFrame(samples(), SCHEMA)
    jobs = lambda **m: sorted({r.job for r in rv.matching(df, **m).select("job").collect()})
    assert jobs(job=("=~", "api.*")) == ["api-a", "api-b"] and jobs(job=("!~", "api-.")) == ["web"] and jobs(job=("=~", "api")) == []
    assert jobs(code=("=", "")) == ["web"] and jobs(code=("!=", "200")) == ["api-b", "web"]
    keys = ["job", "code"]
    parts = rv.buckets(df, keys, counter=True).cache()
    every = rv.summed(rv.rate(parts, keys, 3600))
    bad = rv.summed(rv.rate(parts.where("code = '500'"), keys, 3600))
    got = {r.until: r.value for r in rv.ratio(bad, every, []).collect()}
    hand = by_hand(samples(), 3600)
    for until, value in got.items():
        total = sum(v[2] for (_, u), v in hand.items() if u == until)
        assert value == pytest.approx(hand["api-b", until][2] / total)
    assert got and all(0 <= v <= 1 for v in got.values())


def test_holding(spark):
    rows = [("a", t, v) for t, v in ((0, 9.0), (300, 9.0), (600, 8.0), (900, 1.0), (1200, 7.0), (1500, 7.0), (2400, 7.0))] + [("b", 0, 1.0)]
    df = spark.createDataFrame(rows, "job string, until long, value double")
    assert sorted((r.job, r.until) for r in rv.holding(df, ["job"], 5, 600).collect()) == [("a", 600), ("a", 2400)]
    assert rv.holding(df.limit(0), ["job"], F.lit(5.0), 600).count() == 0
    with pytest.raises(ValueError):
        rv.over_range(df, ["job"], 301)
