"""Registered queries: sources, chunks, search, browse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import browse, chunking, embedding, filters, ids, lexical, lexical_index, quantized, vector_index, vector_search
from ..sources import tables
from ..sources.scratch import materialize, scratch_path
from .views import CHUNKS, EXT_OF, FILES, LINES, TOK, TOKENS, files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Words of the registered lexical queries.
QUERY = "the that with from this, que des und"


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_SUPPORTED = "('rs','py','js','ts','java','cpp','c','go')"


@register(f"WITH {FILES} SELECT path, {EXT_OF} AS ext FROM files WHERE {EXT_OF} IN {_SUPPORTED}")
def filter_supported_ext(spark, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(tables.supported(F.col("path"))).select("path", tables.extension(F.col("path")).alias("ext"))


@register(f"""WITH {CHUNKS}, ok AS (SELECT doc_id FROM files WHERE {EXT_OF} IN {_SUPPORTED})
SELECT (SELECT count(*) FROM ok) AS files_processed, (SELECT count(*) FROM chunks WHERE doc_id IN (SELECT doc_id FROM ok)) AS chunks_created,
       (SELECT count(*) FROM files) - (SELECT count(*) FROM ok) AS files_skipped""")
def index_stats(spark, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("doc_id", "content", tables.supported(F.col("path")).alias("ok"))
    made = chunking.chunk_by_lines(f.where("ok")).agg(F.count(F.lit(1)).alias("chunks_created"))
    return f.agg(F.count_if("ok").alias("files_processed"), F.count_if(~F.col("ok")).alias("files_skipped")).join(made, F.lit(True)).select("files_processed", "chunks_created", "files_skipped")


@register(f"WITH {FILES} SELECT path FROM files WHERE NOT contains(path, 'src1/') AND NOT contains(path, '/tests/') AND NOT contains(path, '.md')")
def scan_excludes(spark, sf_dir: str) -> DataFrame:
    return browse.without_substrings(files(spark, sf_dir), "path", ["src1/", "/tests/", ".md"]).select("path")


@register(f"WITH {FILES} SELECT path, contains(path, '_test.rs') OR contains(path, '/tests/') AS is_test FROM files")
def is_test_path(spark, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", browse.is_test_path(F.col("path")).alias("is_test"))


@register("SELECT lang AS collection, count(*) AS n, sum(n_chars)::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def write_read_roundtrip(spark, sf_dir: str) -> DataFrame:
    d = tables.table(spark, sf_dir, "documents").withColumnRenamed("lang", "collection")
    path = scratch_path(spark)
    tables.write_collection(d, path)
    back = spark.read.schema(d.schema).parquet(path)
    return back.groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


@register("SELECT doc_id, lang || '_' || (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS id FROM documents")
def assign_ids(spark, sf_dir: str) -> DataFrame:
    d = ids.dense_ids(tables.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")
    return d.select("doc_id", F.concat("lang", F.lit("_"), F.col("row_no").cast("string")).alias("id"))


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def parse_json_findings(spark, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k bigint").alias("p")).where("p.k is not null").select("event_id", "p.k")


@register("SELECT c_custkey, lower(replace(replace(c_name, '#', '-'), '-', '_')) AS name FROM customer")
def normalize_collection_name(spark, sf_dir: str) -> DataFrame:
    c = tables.table(spark, sf_dir, "customer")
    return c.select("c_custkey", T.collection_name(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("name"))


@register(f"WITH {LINES} SELECT doc_id, array_to_string(ls[1:10], chr(10)) AS preview FROM bodies")
def preview_lines(spark, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", browse.preview(F.col("content")).alias("preview"))


@register(f"""WITH {FILES} SELECT path, CASE {EXT_OF} WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go'
  WHEN 'java' THEN 'java' WHEN 'cpp' THEN 'cpp' WHEN 'ts' THEN 'typescript' ELSE 'unknown' END AS language FROM files""")
def language_detect(spark, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", "language")


@register(f"WITH {CHUNKS} SELECT doc_id, chunk_no, start_line, end_line, md5(content) AS content_md5 FROM chunks")
def chunk_generic(spark, sf_dir: str) -> DataFrame:
    c = chunking.chunk_by_lines(files(spark, sf_dir).select("doc_id", "content"))
    return c.select("doc_id", "chunk_no", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"))


_STARTS = (r"^The ", r"^An", r"^De[rs]? ", r"^Th")


@register(f"""WITH {LINES}, marked AS (SELECT *, sum(CASE WHEN regexp_matches(trim(line), '^The |^An|^De[rs]? |^Th') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM lines),
 blocks AS (SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line, trim(string_agg(line, chr(10) ORDER BY line_no), ' ' || chr(9) || chr(10) || chr(13)) AS content
    FROM marked WHERE block > 0 GROUP BY doc_id, block)
SELECT doc_id, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, md5(content) AS content_md5 FROM blocks WHERE strlen(content) >= 20""")
def chunk_pattern(spark, sf_dir: str) -> DataFrame:
    c = chunking.chunk_by_pattern(files(spark, sf_dir), _STARTS)
    return c.select("doc_id", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@register(f"""WITH {CHUNKS}, p AS (SELECT doc_id, start_line, CASE WHEN strlen(content) >= 40 AND end_line - start_line + 1 >= 2 THEN 10 WHEN strlen(content) >= 25 THEN 5 ELSE 1 END AS priority FROM chunks),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, start_line) AS position FROM p)
SELECT doc_id, start_line, priority, position FROM r WHERE position <= 50""")
def chunk_topn(spark, sf_dir: str) -> DataFrame:
    c = chunking.chunk_by_lines(files(spark, sf_dir).select("doc_id", "content"))
    p = chunking.priority_of(F.col("content"), F.col("end_line") - F.col("start_line") + 1)
    return chunking.best_chunks(c, "doc_id", p).select("doc_id", "start_line", "priority", "position")


@register(f"""WITH {CHUNKS} SELECT c.doc_id, c.start_line, array_to_string(b.ls[greatest(c.start_line - 3, 0) + 1 : least(c.start_line + 3, len(b.ls) - 1) + 1], chr(10)) AS context
FROM chunks c JOIN bodies b USING (doc_id)""")
def context_lines(spark, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("doc_id", "content")
    return chunking.with_context(chunking.chunk_by_lines(f), f, "doc_id")


_GROUPS = [(d, ws) for d, ws in embedding.KEYWORDS.items()]
_HITS = "[" + ", ".join("0.8::DOUBLE * (" + " + ".join(f"contains(low, '{w}')::INT" for w in ws) + f") / {len(ws)}" for _, ws in _GROUPS) + "]"
EMBEDDED = f"""low AS (SELECT doc_id, lower(text) AS low, (list_sum(list_transform(string_split(text[:100], ''), lambda c: unicode(c))) % 1000) / 10000.0::DOUBLE AS base FROM documents),
 khit AS (SELECT doc_id, base, {_HITS} AS h FROM low),
 raw AS (SELECT doc_id, list_transform(range(384), lambda i: CASE WHEN i < 300 AND h[i // 30 + 1] > 0 AND greatest(0, least(1, h[i // 30 + 1] + 0.2::DOUBLE * sin(0.1::DOUBLE * (i % 30)))) != 0
     THEN greatest(0, least(1, h[i // 30 + 1] + 0.2::DOUBLE * sin(0.1::DOUBLE * (i % 30)))) ELSE base + 0.1::DOUBLE * abs(sin(0.001::DOUBLE * i)) END) AS v FROM khit),
 emb AS (SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM raw)"""


@register(f"""WITH {EMBEDDED} SELECT doc_id, len(v) AS dims, round(list_sum(list_transform(v, lambda x, i: x * i)), 4) AS weighted, round(v[1], 6) AS v0, round(v[92], 6) AS v91,
 round(v[384], 6) AS v383 FROM emb""")
def embed_keyword(spark, sf_dir: str) -> DataFrame:
    d = tables.table(spark, sf_dir, "documents").select("doc_id", embedding.keyword_embedding(F.col("text")).alias("v"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    at = lambda i: F.round(F.get("v", F.lit(i)), 6)
    return materialize(d).select("doc_id", F.size("v").cast("long").alias("dims"), F.round(weighted, 4).alias("weighted"), at(0).alias("v0"), at(91).alias("v91"), at(383).alias("v383"))


_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_TOP = "ORDER BY score DESC, vec_id LIMIT 10"


def _top(spark, sf_dir: str, metric: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "embeddings")
    return vector_search.top_k(e, e.where("vec_id = 0"), 10, metric).select("vec_id", "label", "score")


@register(f"WITH {_Q} SELECT vec_id, label, round((list_cosine_similarity(v, q) + 1) / 2, 6) AS score FROM e, q {_TOP}")
def vector_topk_cosine01(spark, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "cosine01")


@register(f"WITH {_Q} SELECT vec_id, label, round(list_cosine_similarity(v, q), 6) AS score FROM e, q {_TOP}")
def vector_topk_cosine(spark, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "cosine")


@register(f"WITH {_Q} SELECT vec_id, label, round(1 / (1 + list_distance(v, q)), 6) AS score FROM e, q {_TOP}")
def vector_topk_l2(spark, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "l2")


@register(f"WITH {_Q} SELECT vec_id, label, round(list_inner_product(v, q), 6) AS score FROM e, q {_TOP}")
def vector_topk_dot(spark, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, "dot")


@register()
def vector_ann_lsh(spark, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "embeddings")
    query = [float(x) for x in e.where("vec_id = 0").first().embedding]
    return vector_search.approximate_top_k(e, query, 10).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@register("SELECT vec_id, label, 1.0::DOUBLE AS score FROM embeddings WHERE vec_id IN (1, 5, 7, 42)")
def get_by_ids(spark, sf_dir: str) -> DataFrame:
    return vector_search.by_ids(tables.table(spark, sf_dir, "embeddings"), [1, 5, 7, 42]).select("vec_id", "label", "score")


@register("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def delete_by_ids(spark, sf_dir: str) -> DataFrame:
    gone = tables.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    return vector_search.without_ids(tables.table(spark, sf_dir, "embeddings"), gone).select("vec_id", "label")


@register("SELECT vec_id, label, 1.0::DOUBLE AS score FROM embeddings ORDER BY vec_id LIMIT 100")
def list_vectors(spark, sf_dir: str) -> DataFrame:
    return vector_search.listed(tables.table(spark, sf_dir, "embeddings"), 100).select("vec_id", "label", "score")


@register("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 s AS (SELECT a.vec_id AS query_id, b.vec_id, round((list_cosine_similarity(a.v, b.v) + 1) / 2, 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5""")
def vector_batch_topk(spark, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.batch_top_k(e, e.where("vec_id % 50 = 0"), 5)


_BATCH = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 s AS (SELECT a.vec_id AS query_id, b.vec_id, round({score}, 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0{where}),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= {k}"""
_COS01 = "(list_cosine_similarity(a.v, b.v) + 1) / 2"


def _index(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    e = tables.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), scratch_path(spark)


@register(_BATCH.format(score=_COS01, where="", k=5))
def vector_index_topk(spark, sf_dir: str) -> DataFrame:
    """From the stored index, until its bound is met: exact."""
    e, asked, path = _index(spark, sf_dir)
    vector_index.build(e, path)
    return vector_index.search(asked, path, 5)


@register(_BATCH.format(score="1 / (1 + list_distance(a.v, b.v))", where="", k=10))
def vector_index_l2(spark, sf_dir: str) -> DataFrame:
    e, asked, path = _index(spark, sf_dir)
    vector_index.build(e, path, "l2")
    return vector_index.search(asked, path, 10)


@register(_BATCH.format(score=_COS01, where=" AND b.vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)", k=5))
def vector_index_updates(spark, sf_dir: str) -> DataFrame:
    """Two thirds of the vectors, then the others in a second batch, then deletions."""
    e, asked, path = _index(spark, sf_dir)
    vector_index.build(e.where("vec_id % 3 != 0"), path)
    vector_index.insert(e.where("vec_id % 3 = 0"), path)
    vector_index.delete(tables.table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id")), path)
    return vector_index.search(asked, path, 5)


@register(_BATCH.format(score="1 / (1 + list_distance(a.v, b.v))", where="", k=10))
def vector_quantized_l2(spark, sf_dir: str) -> DataFrame:
    """From one byte a dimension, and the full vectors of what its bounds leave: exact."""
    e, asked, path = _index(spark, sf_dir)
    quantized.store(e, path)
    return quantized.search(asked, path, 10, "l2")


@register(_BATCH.format(score="list_cosine_similarity(a.v, b.v)", where="", k=5))
def vector_quantized_cosine(spark, sf_dir: str) -> DataFrame:
    e, asked, path = _index(spark, sf_dir)
    quantized.store(e, path)
    return quantized.search(asked, path, 5)


def _tok(spark, sf_dir: str) -> DataFrame:
    return lexical.tokenized(tables.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@register(f"WITH {TOK} SELECT doc_id, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM tok")
def tokenize(spark, sf_dir: str) -> DataFrame:
    return _tok(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens_md5"))


@register(f"WITH {TOK} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM tok) GROUP BY 1")
def bm25_df(spark, sf_dir: str) -> DataFrame:
    return lexical.document_frequency(_tok(spark, sf_dir))


@register(f"WITH {TOK} SELECT count(*) AS total_docs, sum(len(tokens))::BIGINT AS total_tokens, round(avg(len(tokens)), 6) AS avg_doc_len FROM tok")
def bm25_stats(spark, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(_tok(spark, sf_dir)).withColumn("avg_doc_len", F.round("avg_doc_len", 6))


BM25 = TOK + f""", qt AS (SELECT term, count(*) AS times FROM (SELECT unnest({TOKENS.format("'" + QUERY + "'")}) AS term) GROUP BY 1),
 st AS (SELECT count(*) AS n, avg(len(tokens)) AS al FROM tok),
 hit AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
 dfs AS (SELECT term, count(*) AS df FROM hit GROUP BY 1),
 bm AS (SELECT doc_id, round(sum(times * (CASE WHEN n <= 1 THEN 1 ELSE ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al))), 6) AS score
   FROM hit JOIN dfs USING (term) JOIN qt USING (term), st GROUP BY 1)"""


@register(f"WITH {BM25} SELECT doc_id, score FROM bm")
def bm25_scores(spark, sf_dir: str) -> DataFrame:
    return lexical.bm25(_tok(spark, sf_dir), QUERY)


@register(f"WITH {BM25} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf_dir: str) -> DataFrame:
    return lexical.bm25(_tok(spark, sf_dir), QUERY).orderBy(F.desc("score"), "doc_id").limit(10)


def _lexical_index(spark, sf_dir: str) -> str:
    """Two batches: a third of the documents comes later."""
    d, path = tables.table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark)
    lexical_index.append(d.where("doc_id % 3 != 0"), path, text="text")
    lexical_index.append(d.where("doc_id % 3 = 0"), path, text="text")
    return path


@register(f"WITH {BM25} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def lexical_index_topk(spark, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(0, QUERY)], "query_id long, query string")
    return lexical_index.search(asked, _lexical_index(spark, sf_dir), 10).select("doc_id", "score", "rank")


@register(f"""WITH {TOK}, qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
 st AS (SELECT count(*) AS n, avg(len(tokens)) AS al FROM tok),
 hit AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
 dfs AS (SELECT term, count(*) AS df FROM hit GROUP BY 1),
 bm AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al))), 6) AS score
   FROM hit JOIN dfs USING (term) JOIN qt USING (term), st GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5""")
def lexical_index_batch(spark, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a query: which documents hold it?"""
    asked = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query"))
    return lexical_index.search(asked, _lexical_index(spark, sf_dir), 5)


@register("SELECT key, doc_id, n_chars FROM (SELECT source || ':' || lang AS key, doc_id, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def hybrid_dedup(spark, sf_dir: str) -> DataFrame:
    d = tables.table(spark, sf_dir, "documents").select(F.concat("source", F.lit(":"), "lang").alias("key"), "doc_id", "n_chars")
    return lexical.first_by_key(d, "key", "doc_id")


@register(f"""WITH {BM25}, {EMBEDDED}, qlow AS (SELECT 0),
 sem AS (SELECT d.doc_id, round((list_cosine_similarity(d.v, q.v) + 1) / 2, 6) AS semantic FROM emb d, (SELECT v FROM emb WHERE doc_id = 0) q ORDER BY semantic DESC, d.doc_id LIMIT 50)
SELECT doc_id, semantic, coalesce(score, 0) AS bm25,
  round(0.4::DOUBLE * (CASE WHEN coalesce(score, 0) > 0 THEN 1 / (1 + exp(-score)) ELSE 0 END) + 0.6::DOUBLE * semantic, 6) AS hybrid
FROM sem LEFT JOIN bm USING (doc_id) ORDER BY hybrid DESC, doc_id LIMIT 10""")
def hybrid_search(spark, sf_dir: str) -> DataFrame:
    """Documents like document 0, re-ranked by BM25."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    v = materialize(d.select(F.col("doc_id").alias("vec_id"), embedding.keyword_embedding(F.col("text")).alias("embedding")))
    near = vector_search.top_k(v, v.where("vec_id = 0"), 50).select(F.col("vec_id").alias("doc_id"), F.col("score").alias("semantic"))
    return lexical.hybrid_rerank(near, lexical.bm25(lexical.tokenized(d, "text"), QUERY), 10)


@register(ORACLES["hybrid_search"])
def hybrid_search_indexed(spark, sf_dir: str) -> DataFrame:
    """The same answer from stored indexes: what is searched for is one row of each, the corpus is not read again."""
    d, path = tables.table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark)
    # made once: the index reads its vectors several times
    vector_index.build(materialize(d.select(F.col("doc_id").alias("vec_id"), embedding.keyword_embedding(F.col("text")).alias("embedding"))), path)
    words = _lexical_index(spark, sf_dir)
    asked = vector_index.stored(spark, path).where("vec_id = 0").select(F.lit(0).cast("long").alias("query_id"), "embedding")
    near = vector_index.search(asked, path, 50).select(F.col("vec_id").alias("doc_id"), F.col("score").alias("semantic"))
    return lexical.hybrid_rerank(near, lexical_index.scores_of(near.select("doc_id"), QUERY, words), 10)


@register(f"WITH {TOK} SELECT lang AS collection, count(*) AS chunks, sum(len(tokens))::BIGINT AS tokens, round(avg(len(tokens)), 6) AS avg_len FROM tok JOIN documents USING (doc_id) GROUP BY 1")
def hybrid_stats(spark, sf_dir: str) -> DataFrame:
    d = lexical.tokenized(tables.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text")
    n = F.size("tokens").cast("long")
    return d.groupBy(F.col("lang").alias("collection")).agg(F.count(F.lit(1)).alias("chunks"), F.sum(n).alias("tokens"), F.round(F.avg(n), 6).alias("avg_len"))


@register(f"""WITH {FILES}, {_Q}, s AS (SELECT f.path, round((list_cosine_similarity(v, q) + 1) / 2, 6) AS score, f.lang FROM e JOIN files f ON f.doc_id = e.vec_id, q)
SELECT path, score FROM s WHERE {EXT_OF} IN ('py', 'rs', 'md') AND lang IN ('en', 'fr') AND NOT regexp_matches(path, '^[^/]*/tests/.*$') AND score >= 0.4 ORDER BY score DESC, path LIMIT 20""")
def search_filtered(spark, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "embeddings")
    f = files(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "path", "lang")
    want = filters.SearchFilters(extensions=("py", "rs", "md"), languages=("en", "fr"), exclude=("*/tests/**",), min_score=0.4)
    one = F.broadcast(e.where("vec_id = 0").select(F.first("embedding").alias("q")))  # one row
    s = e.join(one, F.lit(True)).select("vec_id", F.round(vector_search.METRICS["cosine01"](F.col("embedding"), F.col("q")), 6).alias("score"))
    return s.join(f, "vec_id").where(want.column(language="lang")).orderBy(F.desc("score"), "path").limit(20).select("path", "score")


@register("SELECT lang AS collection, count(*) AS vector_count, count(DISTINCT source) AS file_count FROM documents GROUP BY 1")
def list_collections(spark, sf_dir: str) -> DataFrame:
    return browse.collections(tables.table(spark, sf_dir, "documents"), "lang", "source")


@register("""SELECT source AS path, count(*) AS chunk_count, min_by(lang, doc_id) AS language FROM documents GROUP BY 1 ORDER BY 1 LIMIT 100""")
def list_file_paths(spark, sf_dir: str) -> DataFrame:
    return browse.file_list(tables.table(spark, sf_dir, "documents"), "source", "lang", "doc_id", 100)


@register(f"WITH {CHUNKS} SELECT start_line, start_line + greatest(len(string_split(content, chr(10))), 1) - 1 AS end_line, md5(content) AS content_md5 FROM chunks WHERE doc_id = 0")
def get_chunks_by_file(spark, sf_dir: str) -> DataFrame:
    c = chunking.chunk_by_lines(files(spark, sf_dir).where("doc_id = 0").select("doc_id", "content"))
    return browse.file_chunks(c).select("start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@register("SELECT c_custkey, regexp_matches(c_name, '^[A-Za-z0-9_-]{1,100}$') AS valid FROM customer")
def validate_collection_name(spark, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "customer").select("c_custkey", filters.valid_collection(F.col("c_name")).alias("valid"))


@register(f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(path, '^(?:.*/)?src/[^/]*\\.(?:rs|py)$') AND NOT regexp_matches(path, '^src1[^/]*/.*$')")
def glob_filter(spark, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.where(filters.matches_globs(F.col("path"), ["**/src/*.{rs,py}", "!src1*/**"])).select("path")


@register("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS start_line, coalesce(json_extract_string(props, '$.language'), 'unknown') AS language FROM events")
def json_project(spark, sf_dir: str) -> DataFrame:
    return browse.metadata_row(tables.table(spark, sf_dir, "events"), "props", "k").select("event_id", "start_line", "language")


@register("SELECT count(*) AS total, round(avg(n_chars), 4) AS avg_size, max(n_chars) AS largest, count(DISTINCT source) AS files, count(DISTINCT lang) AS languages FROM documents")
def repo_stats(spark, sf_dir: str) -> DataFrame:
    d = tables.table(spark, sf_dir, "documents")
    return d.agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("n_chars"), 4).alias("avg_size"), F.max("n_chars").alias("largest"), F.count_distinct("source").alias("files"), F.count_distinct("lang").alias("languages"))


@register(f"""WITH {_Q}, s AS (SELECT vec_id, round((list_cosine_similarity(v, q) + 1) / 2, 6) AS score FROM e, q {_TOP})
SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s""")
def rank_results(spark, sf_dir: str) -> DataFrame:
    return lexical.ranked(_top(spark, sf_dir, "cosine01").select("vec_id", "score"), F.desc("score"), "vec_id")


@register()
def scan_files(spark, sf_dir: str) -> DataFrame:
    """The tables' own files, found by the source-tree scanner."""
    f = tables.scan_files(spark, sf_dir, extensions=("parquet",))
    return f.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "size")


@register("SELECT event_id, props FROM events")
def encrypt_roundtrip(spark, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("metadata"))
    key = "0123456789abcdef0123456789abcdef"
    back = tables.decrypt_metadata(tables.encrypt_metadata(e, key), key, "map<string,bigint>")
    return back.select("event_id", F.concat(F.lit('{"k": '), F.col("metadata.k").cast("string"), F.lit("}")).alias("props"))


@register()
def chunk_dispatch(spark, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("path", "content")
    return chunking.chunk_dispatch(f).select("path", "chunker", "start_line", "end_line")


@register()
def ast_nodes(spark, sf_dir: str) -> DataFrame:
    return chunking.ast_nodes(_sources(spark, sf_dir)).select("path", "node_id", "parent_id", "depth", "kind", "name", "start_line", "end_line")


@register()
def ast_query(spark, sf_dir: str) -> DataFrame:
    nodes = materialize(chunking.ast_nodes(_sources(spark, sf_dir)))
    return chunking.query_nodes(nodes, "FunctionDef", name_like="^f[0-9]+$", child="Return").select("path", "name", "start_line")


def _sources(spark, sf_dir: str) -> DataFrame:
    """Python source made of every part: no driver table holds code."""
    p = tables.spread(tables.table(spark, sf_dir, "part"))
    body = F.format_string("def f%d(size: int) -> float:\n    if size > %d:\n        return %s\n    return size * 2\n", F.col("p_partkey"), F.col("p_size"), F.round("p_retailprice", 2).cast("string"))
    return p.select(F.concat(F.lit("parts/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), body.alias("content"))
