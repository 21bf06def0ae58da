import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnspark.functions import text as T
from cairnspark.operators import chunking, embedding, filters, lexical, vector_search

VECTORS = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, [-1.0, 0.0, 2.0])]


@pytest.fixture
def vectors(spark):
    return spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")


def test_top_k_ties_zero_and_ragged(vectors):
    rows = [(r.vec_id, r.score) for r in vector_search.top_k(vectors, [1.0, 0.0], 10).collect()]
    # equal scores by id, a zero vector 0, a shorter vector as if filled with zeros
    assert rows[:3] == [(1, 1.0), (3, 1.0), (5, 1.0)]
    assert dict(rows)[4] == 0.0 and dict(rows)[2] == 0.5
    assert math.isclose(dict(rows)[6], (1 - 1 / math.sqrt(5)) / 2, abs_tol=1e-6)
    assert vector_search.top_k(vectors, [1.0, 0.0], 0).count() == 0


def test_batch_equals_single(vectors):
    batch = vector_search.batch_top_k(vectors, vectors, 3, shard_rows=2).collect()
    for vid, v in VECTORS:
        single = [(r.vec_id, r.score) for r in vector_search.top_k(vectors, v, 3).collect()]
        assert [(r.vec_id, r.score) for r in sorted(batch, key=lambda r: r.rank) if r.query_id == vid] == single


def test_tokens(spark):
    row = spark.range(1).select(T.tokens(F.lit('fn hello_world() { println!("Hello, World!"); }')).alias("t")).first()
    assert row.t == ["hello", "world", "println", "hello", "world"]


def test_lines(spark):
    df = spark.createDataFrame([("a\nb\n",), ("a\r\nb",), ("",), (None,), ("\n",)], "t string")
    assert [r[0] for r in df.select(T.lines(F.col("t"))).collect()] == [["a", "b"], ["a", "b"], [], [], [""]]


@pytest.fixture
def docs(spark):
    rows = [(1, "error handling of domain errors"), (2, "cache and cache and cache"), (3, "nothing of note"), (4, ""), (5, None)]
    return lexical.tokenized(spark.createDataFrame(rows, "doc_id long, content string"))


def test_bm25_orders_by_frequency(docs):
    s = {r.doc_id: r.score for r in lexical.bm25(docs, "cache error").collect()}
    assert set(s) == {1, 2} and all(v > 0 for v in s.values())
    twice = {r.doc_id: r.score for r in lexical.bm25(docs, "cache cache").collect()}
    once = {r.doc_id: r.score for r in lexical.bm25(docs, "cache").collect()}
    assert math.isclose(twice[2], 2 * once[2], abs_tol=1e-5)
    assert lexical.bm25(docs, "of a").count() == 0


def test_hybrid_keeps_candidates_and_limit(spark, docs):
    c = spark.createDataFrame([(1, 0.5), (3, 0.6), (9, 0.1)], "doc_id long, semantic double")
    rows = lexical.hybrid_rerank(c, lexical.bm25(docs, "error"), 2).collect()
    assert [r.doc_id for r in rows] == [1, 3]
    assert rows[1].hybrid == pytest.approx(0.36)


def test_first_by_key(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 5, None)], "key string, seq int, v string")
    assert sorted((r.key, r.v) for r in lexical.first_by_key(df, "key", "seq").collect()) == [("k", "a"), ("l", None)]


SAMPLES = {
    "embedding.rs": "embedding provider that embeds text into a vector of fixed dimension",
    "vector_store.rs": "vector_store collection search insert",
    "handlers.rs": "request handler response route",
    "cache.rs": "cache with redis and moka, entries expire by ttl",
    "di.rs": "container dependency inject bootstrap",
    "error.rs": "error result thiserror anyhow fail",
    "chunking.rs": "chunk split parse ast tree_sitter",
}
GOLDEN = [
    ("embedding provider implementation vectors", "embedding.rs"),
    ("vector store search collection insert", "vector_store.rs"),
    ("protocol handler request response", "handlers.rs"),
    ("caching redis moka performance", "cache.rs"),
    ("dependency injection container bootstrap", "di.rs"),
    ("error handling domain errors thiserror", "error.rs"),
    ("code chunk text split parse", "chunking.rs"),
]


def test_golden_queries(spark):
    rows = [(i, n, t) for i, (n, t) in enumerate(SAMPLES.items())]
    d = spark.createDataFrame(rows, "vec_id long, file string, text string").withColumn("embedding", embedding.keyword_embedding(F.col("text"))).cache()
    for query, file in GOLDEN:
        q = spark.createDataFrame([(query,)], "text string").select(embedding.keyword_embedding(F.col("text")).alias("embedding"))
        assert file in [r.file for r in vector_search.top_k(d, q, 5).collect()]


def test_embedding_has_length_one(spark):
    df = spark.createDataFrame([("cache redis",), ("",), ("ünïcode 😀",)], "t string").select(embedding.keyword_embedding(F.col("t")).alias("v"))
    for r in df.collect():
        assert len(r.v) == 384 and math.isclose(sum(x * x for x in r.v), 1, rel_tol=1e-9)


def test_chunks_cover_and_number(spark):
    text = "\n".join(f"line number {i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None)], "id long, content string")
    rows = chunking.chunk_by_lines(df).orderBy("id", "chunk_no").collect()
    assert [(r.id, r.chunk_no, r.start_line, r.end_line) for r in rows] == [(1, 0, 0, 14), (1, 1, 15, 29), (1, 2, 30, 39)]


def test_pattern_blocks_close_on_braces():
    import re

    code = "use x;\nfn long_name() {\n    body();\n}\n\nfn other_name_here() {\n}\ntail"
    got = chunking.pattern_blocks(code, [re.compile(r"^fn ")])
    assert [(a, b) for a, b, _ in got] == [(1, 3), (5, 7)]


def test_dispatch_uses_structure_then_lines(spark):
    py = "def first_function(a, b):\n    return a + b + 1\n\n\ndef second_function(c):\n    return c * 2 + 17\n"
    rows = [("a.py", py), ("b.py", "x = 1  # nothing to cut but a line\n"), ("c.txt", "plain text of more than twenty bytes"), ("d.py", "def broken(: a line of the file\n")]
    out = chunking.chunk_dispatch(spark.createDataFrame(rows, "path string, content string")).collect()
    assert sorted((r.path, r.chunker) for r in out) == [("a.py", "structure")] * 2 + [("b.py", "lines"), ("c.txt", "lines"), ("d.py", "structure")]


def test_dispatch_survives_what_the_parser_gives_up_on(spark):
    """Nesting too deep for the parser raises MemoryError, not SyntaxError; braces are counted once a line."""
    deep = "def first_function(a):\n    return a\nx = " + "not " * 20_000 + "1\n"
    with pytest.raises(MemoryError):
        chunking.python_nodes(deep)
    frame = spark.createDataFrame([("a.py", deep), ("b.py", "def second_function(b):\n    return b + 1\n")], "path string, content string")
    assert sorted((r.path, r.chunker, r.start_line) for r in chunking.chunk_dispatch(frame).collect()) == [("a.py", "structure", 0), ("b.py", "structure", 0)]
    assert {r.path for r in chunking.ast_nodes(frame).collect()} == {"b.py"}


def test_python_output_comes_in_bounded_frames():
    """A batch's tokens and blocks are never held whole."""
    from cairnspark.functions import batches

    made = 0

    def rows():
        nonlocal made
        for i in range(3 * batches.ROWS):
            made += 1
            yield (i, "x")

    sizes = []
    for f in batches.in_frames(rows(), ["n", "t"]):
        sizes.append(len(f))
        assert made == sum(sizes)
    assert sizes == [batches.ROWS] * 3
    assert [len(f) for f in batches.in_frames(((i, "x" * batches.CHARS) for i in range(3)), ["n", "t"])] == [1, 1, 1]


def test_block_patterns_by_language(spark):
    """A file of each language with two blocks after a line of its own."""
    two = lambda a, b, tail="{\n    some_statement();\n}": f"one line that opens nothing\n{a} {tail}\n{b} {tail}\n"
    rows = {
        "a.go": two("func First()", "type Second struct"), "a.js": two("function first()", "class Second"), "a.rs": two("pub fn first()", "impl Second"),
        "a.java": two("public class First", "private void second()"), "a.ts": two("export function first()", "interface Second"), "a.c": two("int first(int x)", "static void second(void)"),
        "a.cpp": two("class First", "int second(int x)"), "a.cs": two("  public class First", "  private int Second()"), "a.php": two("function first()", "class Second"),
        "a.swift": two("func first()", "protocol Second"), "a.kt": two("fun first()", "data class Second(x)"), "a.rb": two("def first_method", "module SecondPart", "\n  some_statement\nend"),
        "broken.py": "x = (\ndef first_function(a):\n    return a\nclass SecondClass:\n    pass\n",
    }
    out = chunking.chunk_dispatch(spark.createDataFrame(list(rows.items()), "path string, content string")).collect()
    got = {}
    for r in out:
        got.setdefault(r.path, []).append((r.start_line, r.chunker))
    assert {k: len(v) for k, v in got.items()} == dict.fromkeys(rows, 2) and all(c == "structure" for v in got.values() for _, c in v)
    assert sorted(got["a.c"]) == [(1, "structure"), (4, "structure")] and sorted(s for s, _ in got["broken.py"]) == [1, 3]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b1", "src", "tests", "x.rs", "y.py"]), min_size=1, max_size=4))
def test_globs(parts):
    import re

    path = "/".join(parts)
    assert bool(re.match(filters.glob_regex("**"), path))
    assert bool(re.match(filters.glob_regex("**/*.rs"), path)) == path.endswith(".rs")
    assert bool(re.match(filters.glob_regex("src/*"), path)) == (len(parts) == 2 and parts[0] == "src")


def test_arguments():
    filters.SearchArgs("find me", filters=filters.SearchFilters(min_score=0.3))
    for bad in (lambda: filters.SearchArgs(""), lambda: filters.SearchArgs("x", limit=0), lambda: filters.SearchArgs("x", collection="a b"),
                lambda: filters.SearchArgs("<script>"), lambda: filters.SearchFilters(min_score=2), lambda: filters.check_path("../x"), lambda: filters.check_path("/etc/passwd")):
        with pytest.raises(ValueError):
            bad()
