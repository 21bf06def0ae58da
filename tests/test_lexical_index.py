"""The stored lexical index against a full scan."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cairnspark.operators import lexical, lexical_index as li

TOPICS = [[a + b for b in ("ation", "ism", "ery", "ling", "ster")] for a in ("grav", "mech", "fish", "cloud", "port")]


def corpus(n, seed=1):
    """Documents by topic, some words everywhere; null and empty texts, copies."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(TOPICS[i * len(TOPICS) // n], k=rng.randrange(1, 30)) + ["the", "and"] * rng.randrange(1, 4)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows[3], rows[4], rows[5], rows[6] = (3, None), (4, ""), (5, "a b"), (6, rows[7][1])
    return rows


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, content string").repartition(4, "doc_id").sortWithinPartitions("doc_id")


def scan(df, query, k):
    best = lexical.bm25(lexical.tokenized(df), query).orderBy(F.desc("score"), "doc_id").limit(k).collect()
    return [(r.doc_id, r.score) for r in best]


def found(spark, path, queries, k, **kw):
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    out = {i: [] for i in range(len(queries))}
    for r in li.search(asked, path, k, **kw).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.doc_id, r.score))
    return out


QUERIES = ["fishery the", "mechanism mechanism gravation", "the and", "nowhere", "", "cloudling portster cloudling the"]


@pytest.mark.parametrize("bits,first", [(3, 1), (10, 16)])
def test_search_equals_a_scan(spark, tmp_path, monkeypatch, bits, first):
    monkeypatch.setattr(li, "SEGMENT_BITS", bits)
    rows, path = corpus(400), str(tmp_path / "i")
    for part in (rows[:250], rows[250:390], rows[390:]):
        li.append(docs(spark, part), path)
    got = found(spark, path, QUERIES, 7, first=first)
    for i, q in enumerate(QUERIES):
        assert got[i] == [(d, pytest.approx(s, abs=2e-6)) for d, s in scan(docs(spark, rows), q, 7)], q


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(li, "SEGMENT_BITS", 3)
    rows, path = corpus(1200, 5), str(tmp_path / "i")
    li.append(docs(spark, rows), path)
    read, scores_in = [], li.scores_in
    monkeypatch.setattr(li, "scores_in", lambda qw, path, wanted: read.append(wanted.count()) or scores_in(qw, path, wanted))
    got = found(spark, path, ["fishery fishling the"], 5, first=4)[0]
    assert [d for d, _ in got] == [d for d, _ in scan(docs(spark, rows), "fishery fishling the", 5)]
    blocks = spark.read.parquet(f"{path}/blocks").select("segment").distinct().count()
    assert sum(read) < blocks / 3


def test_a_batch_is_added_without_reading_the_others(spark, tmp_path):
    rows, path = corpus(200), str(tmp_path / "i")
    li.append(docs(spark, rows[:150]), path)
    before = {f: os.stat(f"{path}/{part}/{f}").st_mtime for part in ("blocks", "docs", "terms") for f in os.listdir(f"{path}/{part}") if f.startswith("part")}
    for part in ("blocks", "docs", "terms"):
        os.rename(f"{path}/{part}", f"{path}/{part}-away")
    li.append(docs(spark, rows[150:]), path)
    for part in ("blocks", "docs", "terms"):
        for f in os.listdir(f"{path}/{part}-away"):
            if "part-" in f:
                os.rename(f"{path}/{part}-away/{f}", f"{path}/{part}/{f}")
    assert {f: os.stat(f"{path}/{part}/{f}").st_mtime for part in ("blocks", "docs", "terms") for f in os.listdir(f"{path}/{part}") if f in before} == before
    assert found(spark, path, ["fishery the"], 9)[0] == [(d, pytest.approx(s, abs=2e-6)) for d, s in scan(docs(spark, rows), "fishery the", 9)]
    assert li.totals(spark, path).docs == 200


def test_a_batch_that_broke_off_does_not_count(spark, tmp_path, monkeypatch):
    rows, path = corpus(120), str(tmp_path / "i")
    li.append(docs(spark, rows[:100]), path)
    half = spark.read.parquet(f"{path}/blocks").withColumn("batch", F.lit(1))
    half.write.mode("append").parquet(f"{path}/blocks")
    assert found(spark, path, ["fishery the"], 9)[0] == [(d, pytest.approx(s, abs=2e-6)) for d, s in scan(docs(spark, rows[:100]), "fishery the", 9)]


def test_scores_of_some_documents(spark, tmp_path):
    rows, path = corpus(300), str(tmp_path / "i")
    li.append(docs(spark, rows), path)
    all_scores = dict(scan(docs(spark, rows), "fishery the", 1000))
    some = [3, 150, 151, 299, 12345]
    got = li.scores_of(spark.createDataFrame([(i,) for i in some], "doc_id long"), "fishery the", path).collect()
    assert {r.doc_id: r.score for r in got} == {i: pytest.approx(all_scores[i], abs=2e-6) for i in some if i in all_scores}


def test_only_the_querys_terms_are_read(spark, tmp_path):
    path = str(tmp_path / "i")
    li.append(docs(spark, corpus(300)), path)
    qw = li.query_weights(spark.createDataFrame([(0, "fishery the")], "query_id long, query string"), path)
    plan = li.bounds(qw, path)._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan.split("PushedFilters")[1] and "docs" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_an_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "i")
    li.append(docs(spark, corpus(10)).limit(0), path)
    assert found(spark, path, ["fishery"], 5) == {0: []}
    li.append(docs(spark, corpus(20)), path)
    assert [d for d, _ in found(spark, path, ["the"], 3)[0]] == [d for d, _ in scan(docs(spark, corpus(20)), "the", 3)]
