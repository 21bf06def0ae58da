import collections
import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from cairnspark.functions.text import line_table
from cairnspark.operators import clones, graphs, metrics, rules, validators
from cairnspark.operators.ids import dense_ids
from cairnspark.sources import tables
from cairnspark.streaming import events as ev


def test_scan_skips_and_validates(spark, tmp_path):
    for name, data in {"lib.rs": b"fn a() {}", "src/utils.RS": b"fn b() {}", ".git/x.rs": b"", "node_modules/y.js": b"", "target/z.rs": b"", "__pycache__/a.py": b"", "bad.rs": b"\xff\xfe", "empty.py": b"", "README": b"x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r.path.split("/")[-1]: r.valid for r in tables.scan_files(spark, str(tmp_path)).collect()}
    # Spark lists no empty files
    assert got == {"lib.rs": True, "utils.RS": True, "bad.rs": False}


def test_linter_reports(spark):
    item = '{"code":"F401","message":"m","filename":"a.py","location":{"row":3,"column":1}}'
    df = spark.createDataFrame([(f"[{item}]",), (f"{item}\n{item}\n",)], "value string")
    assert [(r.code, r.line) for r in tables.ruff_findings(df).collect()] == [("F401", 3)] * 3
    msg = '{"reason":"compiler-message","message":{"message":"m","level":"warning","code":%s,"spans":[{"file_name":"x.rs","line_start":1,"is_primary":false},{"file_name":"a.rs","line_start":7,"is_primary":true}]}}'
    text = "\n".join([msg % '{"code":"clippy::unwrap_used"}', msg % "null", msg % '{"code":""}', '{"reason":"build-finished"}'])
    assert [(r.code, r.file, r.line) for r in tables.clippy_findings(spark.createDataFrame([(text,)], "value string")).collect()] == [("clippy::unwrap_used", "a.rs", 7)]


def test_encryption(spark):
    df = spark.createDataFrame([(1, {"a": "b"}), (2, {})], "id long, metadata map<string,string>")
    key = "k" * 32
    secret = tables.encrypt_metadata(df, key)
    assert secret.schema["metadata"].dataType.simpleString() == "binary"
    assert sorted(map(tuple, tables.decrypt_metadata(secret, key, "map<string,string>").collect())) == [(1, {"a": "b"}), (2, {})]


def test_dense_ids(spark):
    df = spark.createDataFrame([("hot" if i % 3 else "cold", i) for i in range(500)], "g string, o long")
    got = sorted((r.g, r.row_no) for r in dense_ids(df, "g", "o").collect())
    assert got == sorted([("hot", i) for i in range(333)] + [("cold", i) for i in range(167)])


def brute_cycles(edges):
    nodes, es, out = sorted({x for e in edges for x in e}), set(edges), set()
    for k in range(1, len(nodes) + 1):
        for p in itertools.permutations(nodes, k):
            if p[0] == min(p) and all((a, b) in es for a, b in zip(p, p[1:] + p[:1], strict=True)):
                out.add(p)
    return out


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3)], [(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1), (4, 4), (3, 2)], [(1, 2), (2, 3), (3, 4), (4, 1), (1, 3), (5, 6)]])
def test_cycles(spark, edges):
    got = {tuple(r.path) for r in graphs.cycles(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute_cycles(edges)


def test_snapshot_diff(spark):
    f = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    old, new = f([("a", "1"), ("b", "1"), ("c", "1")]), f([("a", "1"), ("b", "2"), ("d", "1")])
    assert sorted(map(tuple, graphs.snapshot_diff(old, new).collect())) == [("b", "modified"), ("c", "removed"), ("d", "added")]
    assert {r.change for r in graphs.snapshot_diff(f([]), new).collect()} == {"added"}
    assert {r.change for r in graphs.snapshot_diff(old, f([])).collect()} == {"removed"}


def test_nearest_ancestor(spark):
    p = spark.createDataFrame([("a/b/c.rs",), ("a/x.rs",), ("z.rs",)], "path string")
    o = spark.createDataFrame([("a",), ("a/b",)], "owner string")
    assert sorted((r.path, r.owner) for r in graphs.nearest_ancestor(p, o).collect()) == [("a/b/c.rs", "a/b"), ("a/x.rs", "a"), ("z.rs", None)]


def test_lexer():
    got = [(t, k) for t, _, _, k in clones.lex('let x = "a b"; // gone\n/* gone */ y1 += 2.5')]
    assert got == [("let", "identifier"), ("x", "identifier"), ("=", "operator"), ('"a b"', "literal"), (";", "punctuation"), ("y1", "identifier"), ("+", "operator"), ("=", "operator"), ("2.5", "literal")]


def test_clones(spark):
    body = [f"t{i}" for i in range(30)]
    df = spark.createDataFrame([("a", ["x", *body]), ("b", [*body, "y"]), ("c", ["z"] * 5), ("d", [])], "doc_id string, tokens array<string>")
    pairs = clones.clone_pairs(clones.windows(df, 10), 10)
    merged = clones.suppress_overlaps(clones.merge_clones(pairs, 10)).collect()
    assert [(r.file1, r.start1, r.file2, r.start2, r.n_tokens) for r in merged] == [("a", 1, "b", 0, 30)]


RUST = """use std::sync::Mutex;
pub fn Bad_Name(x: u32) -> u32 {
    for i in 0..10 {
        if i > 1 {
            call(x.clone());
        }
        more(x.clone());
    }
    last(x.clone());
    let y = thing.unwrap();
    // thing.unwrap()
    x
}
#[cfg(test)]
mod tests {
    fn t() { z.unwrap(); }
}
"""


def test_validators(spark):
    f = spark.createDataFrame([("src/lib.rs", RUST)], "file string, content string")
    got = sorted((r.id, r.line) for r in validators.validate(f).collect())
    assert ("QUAL001", 10) in got and ("QUAL001", 11) not in got and ("QUAL001", 16) not in got
    assert ("NAME002", 2) in got and ("ASYNC003", 1) in got and ("DOC002", 2) in got
    # inside the loop only, also after the inner block has closed
    assert [line for i, line in got if i == "PERF001"] == [5, 7]


def test_block_table():
    rows = "impl A {\n    fn a(&self) {\n        match x {\n            1 => 2,\n            _ => 3,\n        }\n    }\n    fn b(&self) {}\n}\nstruct S {\n    a: u32,\n    pub b: u32,\n}".split("\n")
    assert validators.block_table(rows) == [("impl", "A", 1, 9, 2), ("fn", "a", 2, 7, 0), ("match", "x", 3, 6, 2), ("fn", "b", 8, 8, 0), ("struct", "S", 10, 13, 2)]


FUNCTIONS = """//! Module.
/// Documented.
pub fn many(a: u32, b: Vec<(u8, u8)>, c: u32, d: &str, e: u32, f: u32) -> u32 {
    a + 1
}
fn few(&self, a: u32) {}
fn fixed() -> bool { true }
fn go(&self, x: u32) -> u32 {
    self.inner.go(x)
}
fn talk() {
    info!("x");
}
fn deep() {
    if a {
        for b in c {
            while d {
                if e {
                    f();
                }
            }
        }
    }
}
#[cfg(test)]
mod tests {
    #[test]
    fn checks_nothing() {
        let x = 1;
    }
    /// Fine.
    #[test]
    fn test_fine() { assert_eq!(1, 1); }
    #[test]
    fn test_notes() {
        // later
    }
}
"""


def test_function_rules(spark):
    f = spark.createDataFrame([("a/src/BadName.rs", FUNCTIONS), ("a/utils.rs", "//! U\n" + "pub fn a() {}\n" * 4)], "file string, content string")
    got = collections.Counter((r.id, r.line) for r in validators.validate(f, ["functions", "files", "paths", "utilities"]).where("file like '%BadName.rs'").collect())
    assert got == collections.Counter({("KISS002", 3): 1, ("IMPL001", 6): 1, ("IMPL002", 7): 1, ("IMPL003", 8): 1, ("IMPL004", 11): 1, ("KISS004", 18): 1, ("TEST003", 28): 1, ("TEST004", 28): 1,
                                       ("TST004", 28): 1, ("TEST007", 35): 1, ("TST004", 35): 1, ("TEST001", 25): 1, ("NAME004", 1): 1})
    assert [r.id for r in validators.validate(f, ["utilities"]).collect()] == ["VIS003"]


def test_reports(spark):
    rows = [("A1", "quality", "error", "f", 1, "m"), ("A2", "quality", "info", "f", 2, "m")]
    v = spark.createDataFrame(rows, validators.FINDING)
    assert validators.totals(v).first().asDict() == {"total": 2, "errors": 1, "warnings": 0, "infos": 1, "passed": False}
    assert [r.annotation for r in validators.ci_annotations(v).collect()] == ["::error file=f,line=1::[A1] m"]
    assert validators.totals(v.limit(0)).first().passed


def test_function_metrics():
    src = "def f(a, b):\n    # note\n    if a and b:\n        for i in b:\n            if i:\n                return i\n    return 0\n"
    (name, start, end, cyclo, cogn, *_, nargs, nexits, nesting) = metrics.function_metrics_of(src)[0]
    assert (name, start, end, cyclo, cogn, nargs, nexits, nesting) == ("f", 1, 7, 5, 7, 2, 2, 3)
    assert metrics.function_metrics_of("") == []


def test_rules(spark):
    facts = rules.facts(spark.createDataFrame([("fn main() {}",), ("pub fn helper() -> Result<(), Error> { Ok(()) }",)], "content string"))
    run = lambda e: [(r.id, r.category) for r in rules.expression_rules(facts, [{"id": "R", "expression": e}]).collect()]
    assert run("file_count > 1") == [("R", "quality")] and run("file_count > 5 || has_tests") == []
    assert run("drop table x") == [("R", "configuration")] and run("file_count > unknown") == [("R", "configuration")]
    assert [rules.route(r) for r in ({"engine": "x"}, {"rule": "when a then b"}, {"expression": "a"}, {"condition": {}})] == ["x", "grl", "expression", "conditions"]
    with pytest.raises(ValueError):
        rules.condition({"field": "a", "operator": "~", "value": 1})


def test_rule_catalogue(spark, tmp_path):
    (tmp_path / "t.yml").write_text("_template: base\ncategory: quality\nseverity: ${level}\n")
    (tmp_path / "r.yml").write_text("_extends: base\nid: Q1\nexpression: file_count > 1\n")
    (r,) = rules.load_rules(spark, str(tmp_path), {"level": "error"}).collect()
    assert (r.id, r.category, r.severity, r.engine) == ("Q1", "quality", "error", "expression")
    (tmp_path / "bad.yml").write_text("id: Q2\n")
    with pytest.raises(ValueError):
        rules.load_rules(spark, str(tmp_path))


T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), k, ok, float(i)) for i, (s, k, ok) in enumerate(rows)], "event_id long, ts timestamp, key string, ok boolean, value double")


def test_health(spark):
    rows = [(i, "a", False) for i in range(5)] + [(0, "b", True), (1, "b", False), (2, "b", False), (0, "c", False), (1, "c", True), (0, "d", False)]
    f = frame(spark, rows)
    states = ev.health(f, "key", "ok", ["ts", "event_id"])
    assert {r.key: r.state for r in states.collect()} == {"a": "unhealthy", "b": "degraded", "c": "healthy", "d": "healthy"}
    pick = lambda *a: [r.key for r in ev.select_provider(states, "key", *a).collect()]
    assert pick(["b"], []) == ["b"] and pick(["a"], []) == ["c"] and pick([], ["c", "d"]) == ["b"] and pick([], ["a", "b", "c", "d"]) == []


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, f"k{s % 3}", s % 4 > 1) for s in range(0, 300, 7)]
    f = frame(spark, rows)
    f.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ev.read_events(spark, str(tmp_path / "in"), "event_id long, ts timestamp, key string, ok boolean, value double")
    out = ev.run_available(ev.stream_debounced(stream, 40, "key"), str(tmp_path / "out"), str(tmp_path / "ck"))
    batch = ev.debounced(f, 40, "key")
    assert sorted((r.key, r.ts) for r in out.collect()) == sorted((r.key, r.ts) for r in batch.collect())

    def last(batch_df, _):
        batch_df.write.mode("append").parquet(str(tmp_path / "health"))

    q = ev.stream_health(stream, "key", "ok").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).foreachBatch(last).start()
    q.awaitTermination()
    want = {r.key: (r.failures, r.state) for r in ev.health(f, "key", "ok", ["ts", "event_id"]).collect()}
    assert {r.key: (r.failures, r.state) for r in spark.read.parquet(str(tmp_path / "health")).collect()} == want


def test_windows_on_a_stream(spark, tmp_path):
    f = frame(spark, [(s, "k", True) for s in range(0, 600, 30)])
    f.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))
    q = ev.windowed(stream, "2 minutes", "key").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, ev.windowed(f, "2 minutes", "key").collect()))
    assert sorted(map(tuple, spark.sql("select * from w").collect())) == want


def test_decode_drops_bad_payloads(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("nonsense",), (None,)], "value string")
    assert [tuple(r) for r in ev.decode(df, "a int").collect()] == [(1,)]


def test_cache_fold(spark):
    rows = [("x", "set", 1.0, 0, 1), ("x", "delete", None, 5, 2), ("y", "set", 1.0, 0, 3), ("y", "set", 2.0, 9, 4), ("z", "set", 1.0, -500, 5)]
    ops = spark.createDataFrame([(k, a, v, T0 + dt.timedelta(seconds=s), n) for k, a, v, s, n in rows], "key string, kind string, value double, ts timestamp, seq long")
    out = ev.cache_fold(ops, "key", ["seq"], 300, F.lit(T0 + dt.timedelta(seconds=10)))
    assert [tuple(r) for r in out.collect()] == [("y", 2.0)]


def test_line_metrics(spark):
    f = spark.createDataFrame([("a", "x\n\n// c\ny\n")], "file string, content string")
    assert metrics.line_metrics(line_table(f), "file").first().asDict() == {"file": "a", "sloc": 4, "blank": 1, "cloc": 1, "ploc": 2, "longest": 4}


def test_debounce_counts_from_the_last_sync(spark):
    """Events every 30 seconds with a wait of 60: a sync at 0, 60, 120; a burst apart starts anew."""
    rows = [(i, "k", 30 * i) for i in range(6)] + [(10, "k", 1000), (11, "k", 1001), (12, "j", 5), (13, "j", 64), (14, "j", 65)]
    f = spark.createDataFrame(rows, "event_id long, key string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted((r.key, r.t) for r in ev.debounced(f, 60, "key").collect())
    assert got == [("j", 5), ("j", 65), ("k", 0), ("k", 60), ("k", 120), ("k", 1000)]


def test_long_cycles(spark):
    edges = [(i, (i + 1) % 12) for i in range(12)] + [(20, 21), (21, 22)]
    [row] = graphs.cycles(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert row.length == 12 and list(row.path) == list(range(12))


@pytest.mark.parametrize("n", [0, 2])
def test_top_k_takes_one_query(spark, n):
    from cairnspark.operators.vector_search import top_k

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="one query"):
        top_k(vectors, vectors.limit(n), 1).collect()


def test_exact_quantiles_and_held_spans(spark):
    import random

    import numpy as np

    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.expovariate(0.1), rng.randrange(20_000)) for i in range(3000)] + [(9000, "one", 5.0, 1), (9001, "a", None, 2)]
    f = spark.createDataFrame(rows, "event_id long, key string, value double, t long").withColumn("ts", F.timestamp_seconds("t"))
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r.key: r.quantile for r in ev.exact_quantile(f, "value", p, "key", width=3.0).collect()}
        assert got == {k: pytest.approx(np.quantile([v for _, x, v, _ in rows if x == k and v is not None], p)) for k in ("a", "b", "one")}
    got = {r.event_id for r in ev.held(f, "value", 2.0, 30, "key", span=100).collect()}
    low = lambda k, t: min(v for _, x, v, u in rows if x == k and t - 30 <= u <= t and v is not None)
    assert got == {i for i, k, v, t in rows if v is not None and low(k, t) > 2.0}


def test_globs_without_an_include():
    from cairnspark.operators.filters import matches_any

    assert "true" not in str(matches_any(F.lit("a.rs"), [])).lower() and "true" not in str(matches_any(F.lit("a.rs"), ["!b*"])).lower()


def test_recall_of_random_projections(spark):
    """Approximate neighbours against exact ones on the driver's vectors: recall at 10 of 0.9 or more."""
    import os

    import numpy as np

    from cairnspark.operators.vector_search import approximate_top_k

    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    e = spark.read.parquet(path).select("vec_id", "embedding")
    rows = e.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    hit = 0
    for q in range(0, 400, 50):
        d = np.linalg.norm(x - x[q], axis=1)
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hit += len(best & {r.vec_id for r in approximate_top_k(e, x[q].tolist(), 10).collect()})
    assert hit >= 0.9 * 80, hit / 80
