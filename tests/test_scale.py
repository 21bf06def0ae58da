"""Steps that must not be one task's, or hold a whole batch."""

from pyspark.sql import functions as F

from cairnspark.plans import rust_queries, search_queries

SMOKE = "/root/testdata/sf0.001"


def test_generated_sources_are_dealt_to_all_cores(spark):
    """part is one file, so what is made from it was one task's work."""
    for made in (rust_queries.sources(spark, SMOKE), search_queries._sources(spark, SMOKE)):
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_matches_are_followed_once_a_case(spark, monkeypatch):
    """Forty copies of one of two files: one case reaches Python, all links come out."""
    from cairnspark.operators import near_clones as N

    body = "fn first(a: u32) -> u32 {\n" + "".join(f"    let v{i} = call{i}(a, {i});\n" for i in range(12)) + "}\n"
    frame = spark.createDataFrame([("a.rs", body + "fn tail() {}\n")] + [(f"b{i:02}.rs", "use x;\n" + body) for i in range(40)], "path string, content string")
    cases = []
    monkeypatch.setattr(N, "spread", lambda df: cases.append(df.count()) or df)
    out = N.near_clones(N.source_tokens(frame), N.Limits(4, 30, 0.70)).collect()
    assert cases[0] < 10 and len({r.file2 for r in out if r.file1 == "a.rs"} - {"a.rs"}) == 40


def test_windows_cross_the_network_once(spark):
    """A document's windows stay in its row; keys and hashes are dealt out once and not counted before that."""
    from cairnspark.operators import clones as C

    words = lambda a, b: [f"w{i}" for i in range(a, b)]
    rows = [(1, words(0, 60)), (3, ["a"] * 30), (4, words(900, 911)), (5, []), (6, None), (8, ["a", "b"] * 15), (9, words(40, 70)), (9, words(0, 20)), (None, words(5, 40)), (None, ["a"] * 13)]
    t = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    old = C.windows(t, 12).groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("hash").alias("distinct_windows"), F.min("hash").alias("least"))
    for some in (t, t.where("doc_id < 9")):
        got = C.document_windows(some, 12)
        assert sorted(map(str, got.collect())) == sorted(map(str, (old if some is t else old.where("doc_id < 9")).collect()))
        assert some is t or "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    for df, most in ((C.fingerprint_stats(C.window_keys(t, 12), "k"), 2), (C.clone_pairs(C.windows(t, 12), 12), 1)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
        assert sum("Exchange hashpartitioning" in x and "Reused" not in x for x in plan.splitlines()) <= most, plan


def test_queries_meet_codes_in_blocks(spark, tmp_path):
    """The arrays of a task are bounded, however many queries there are."""
    import numpy as np

    from cairnspark.operators import quantized as Q

    sizes = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 8))
    path = str(tmp_path / "codes")
    Q.store(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), path)
    bounds = Q._bounds

    def told(q, codes, *rest):
        if len(q) > Q.QUERY_BLOCK or len(codes) > Q.AT_ONCE:
            sizes.add(1)
        return bounds(q, codes, *rest)

    Q._bounds = told
    try:
        got = Q.candidates(spark, x[:1300], np.arange(1300), path, 1, "l2")
    finally:
        Q._bounds = bounds
    assert got.where("query_id = vec_id").count() == 1300 and sizes.value == 0


def test_waiting_rows_are_taken_in_parts():
    """The state keeps packed rows; few are taken at once, and the answer is that of all at once."""
    import numpy as np
    import pandas as pd

    from cairnspark.streaming import timers as T

    class Store:
        def __init__(self):
            self.kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept if self.kept is not None else iter([])

        def put(self, x):
            self.kept = x

        update = put

        def clear(self):
            self.kept = None

    class Handle:
        getListState = getValueState = lambda self, *a: Store()
        listTimers = lambda self: []
        registerTimer = lambda self, t: None

    class At:
        def __init__(self, t):
            self.getCurrentWatermarkInMs = lambda: t

    rng = np.random.default_rng(4)
    n = 3000
    rows = pd.DataFrame({"ts": pd.to_datetime(rng.permutation(n) * 1000, unit="ms"), "value": (rng.random(n) < 0.9) * 5.0})
    found = []
    for pack in (n, 100):
        most = []

        class Told(T.HoldAlerts):
            def fold(self, state, due, upto):
                most.append(len(due))
                return super().fold(state, due, upto)

        p, T.PACK = Told("key", 1.0, 6), pack
        p.init(Handle())
        out = [*p.handleInputRows(("a",), iter([rows]), At(0))]
        assert len(p.waiting.kept) == -(-n // pack) and all(isinstance(r[0], bytes) for r in p.waiting.kept)
        out += [*p.handleExpiredTimer(("a",), At(2_000_000), None), *p.handleExpiredTimer(("a",), At(10_000_000), None)]
        found.append(pd.concat(out).astype(str).values.tolist())
        assert max(most) <= pack
    T.PACK = 65_536
    assert found[0] == found[1] and len(found[0]) > 50


def test_postings_are_counted_in_their_rows(spark):
    """As by grouping, without an exchange; equal documents stay apart."""
    from cairnspark.operators import lexical_index as L

    rows = [(1, ["b", "a", "b", "c", "b"]), (1, ["b", "a"]), (2, ["x"]), (3, []), (None, ["a", "a"])]
    t = spark.createDataFrame(rows, "doc long, tokens array<string>").select("*", F.size("tokens").alias("len"), F.lit(0).cast("long").alias("segment"))
    got = L.postings(t)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(d, len(ts), w, ts.count(w)) for d, ts in rows for w in set(ts)]
    assert sorted(map(str, [(r.doc, r["len"], r.term, r.tf) for r in got.collect()])) == sorted(map(str, want))
