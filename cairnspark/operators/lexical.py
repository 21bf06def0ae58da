"""Lexical and hybrid search: tokens, corpus statistics, BM25, re-ranking.

Postings (document, term, tf) are the shared table; a query touches only its own
terms, which are pushed into them before any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75
LEXICAL_WEIGHT, SEMANTIC_WEIGHT = 0.4, 0.6


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``.

    An aggregate, so that a hot key is reduced in every task before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, "r.*")


def tokenized(docs: DataFrame, text: str = "content") -> DataFrame:
    """``docs`` with ``tokens`` in place of the text; a null text has none."""
    found = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
    return docs.select(*[c for c in docs.columns if c != text], found.alias("tokens"))


def postings(tok: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, tf, doc_len."""
    t = tok.select(key, F.size("tokens").cast("long").alias("doc_len"), F.explode("tokens").alias("term"))
    return t.groupBy(key, "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tok: DataFrame) -> DataFrame:
    return tok.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(tok: DataFrame) -> DataFrame:
    """One row: total_docs, total_tokens, avg_doc_len."""
    n = F.size("tokens").cast("long")
    return tok.agg(F.count(F.lit(1)).alias("total_docs"), F.coalesce(F.sum(n), F.lit(0)).alias("total_tokens"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_doc_len"))


def idf(df: Column, n: Column) -> Column:
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.ln(1 + (n - df + 0.5) / (df + 0.5)))


def query_terms(spark, query: str) -> list[str]:
    """Tokens of a query, repeats kept (each counts)."""
    return spark.range(1).select(tokens(F.lit(query)).alias("t")).first().t


def bm25(tok: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """key, score of the documents that hold a term of the query."""
    terms = query_terms(tok.sparkSession, query)
    weights: dict[str, int] = {}
    for t in terms:
        weights[t] = weights.get(t, 0) + 1
    if not weights:
        return tok.select(key, F.lit(0.0).alias("score")).limit(0)
    times = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    held = tok.select(key, F.size("tokens").cast("long").alias("doc_len"), F.filter("tokens", lambda x: x.isin(list(weights))).alias("tokens"))
    hit = held.where(F.size("tokens") > 0).select(key, "doc_len", F.explode("tokens").alias("term")).groupBy(key, "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    # at most one row a query term, and one row: both bounded by the query
    seen = F.broadcast(hit.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    stats = F.broadcast(corpus_stats(tok))
    j = hit.join(seen, "term").join(stats, F.lit(True))
    tf = F.col("tf").cast("double")
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_doc_len")))
    part = F.get(F.array(times[F.col("term")]), F.lit(0)) * idf(F.col("df"), F.col("total_docs")) * weight
    return j.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def hybrid_rerank(candidates: DataFrame, lexical: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """Re-rank semantic candidates (key, semantic) with BM25 scores (key, score).

    Re-ranks, adds nothing: a candidate without lexical score keeps its weighted
    semantic one.
    """
    s = F.coalesce("score", F.lit(0.0))
    squash = F.when(s > 0, 1 / (1 + F.exp(-s))).otherwise(F.lit(0.0))
    out = candidates.join(lexical.select(key, "score"), key, "left")
    mixed = F.round(LEXICAL_WEIGHT * squash + SEMANTIC_WEIGHT * F.col("semantic"), 6)
    return out.select(*candidates.columns, F.round(s, 6).alias("bm25"), mixed.alias("hybrid")).orderBy(F.desc("hybrid"), key).limit(limit)


def ranked(df: DataFrame, *order) -> DataFrame:
    """``rank`` 1..n over an already limited result."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))
