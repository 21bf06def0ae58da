"""What a stored index costs to make: each row's work is done once, where the row lies."""

from pyspark.sql import functions as F

from cairnspark.operators import embedding
from cairnspark.operators import lexical_index as li
from cairnspark.operators import vector_index as vi


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sampled_vectors_are_scaled_by_arrays(spark, tmp_path, monkeypatch):
    """A norm inside a lambda was made once a dimension; and the sample was one task's."""
    seen, keep = [], vi.materialize
    monkeypatch.setattr(vi, "materialize", lambda df: seen.append(df) or keep(df))
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(200)]
    vi.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), str(tmp_path / "i"), sample=150)
    assert "MapInArrow" in plan(seen[0]) and "lambda" not in plan(seen[0]) and seen[0].rdd.getNumPartitions() == 4
    assert seen[0].count() == 150 and vi.stored(spark, str(tmp_path / "i")).count() == 200


def test_embedding_is_made_by_arrays(spark):
    d = spark.createDataFrame([("error vector ast",), (None,), ("",)], "t string").select(embedding.keyword_embedding(F.col("t")).alias("v"))
    assert "ArrowEvalPython" in plan(d)
    one, none, empty = (r.v for r in d.collect())
    assert len(one) == len(none) == len(empty) == embedding.DIM and set(none) == {None}
    assert abs(sum(x * x for x in one) - 1) < 1e-9


def test_blocks_are_counted_in_their_segment(spark):
    """Postings crossed the network row by row; now only blocks do, with the same content."""
    rows = [(5, ["b", "a", "b"], 0), (2, ["a"], 0), (9, [], 0), (7, ["é", "a", "é", "é"], 1), (-3, [], 2)]
    t = spark.createDataFrame(rows, "doc long, tokens array<string>, segment long").withColumn("len", F.size("tokens")).coalesce(1)
    got = li.segment_blocks(t)
    assert "Aggregate" not in plan(got) and "RepartitionBy" not in plan(got)
    p = F.sort_array(F.collect_list(F.struct("doc", "tf", "len")))
    want = li.postings(t).groupBy("term", "segment").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), p.alias("p"))
    want = want.select("term", "segment", "n", "max_tf", "min_len", F.col("p.doc").alias("docs"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
