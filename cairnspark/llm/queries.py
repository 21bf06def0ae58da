"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, context_tree, hamming, langid, linededup, mixing, neardup, passages, pieces, prefix_trie, quality, token_counts, url_filter
from .common import materialize, table


def model_file(name: str = "piece_bpe_32k.model") -> str:
    """Path of an installed public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def model_bytes(name: str) -> bytes:
    with open(model_file(name), "rb") as f:
        return f.read()


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.page_labels(pages, table(spark, sf_dir, "labels")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op3_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.topk_hamming(codes, codes.where("vec_id % 50 = 0"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, round_trip (the ids decode to the text)."""
    out = pieces.encode(table(spark, sf_dir, "documents"), pieces.load_pieces(model_file()))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed_lines, n_removed_chunks, md5 of the text that stays."""
    out = linededup.strip_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed_lines", "n_removed_chunks", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, sorted by the position of its first copy."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    out = out.withColumn("position", F.round("position", 9))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than a context of 2048)."""
    name = "word_bpe_49k.json"
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), name, model_bytes(name))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of byte-level BPE and SentencePiece tokens, as a digest, and their links."""
    files = alignment.Tokenizers(model_bytes("byte_bpe_50k.json"), model_bytes("piece_bpe_32k.model"))
    out = alignment.align(table(spark, sf_dir, "documents"), files)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations, with a digest of those that end at each."""
    turns = prefix_trie.rebuilt(materialize(prefix_trie.turns_of(table(spark, sf_dir, "conversations"))))
    named = materialize(prefix_trie.named(turns))
    nodes = prefix_trie.prefix_nodes(named).join(prefix_trie.member_digests(prefix_trie.members(named)), "node", "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_quality_rules, op3_hamming_topk, op4_language_id, op5_lm_score,
        op6_sentencepiece, op7_line_dedup, op8_mixing, op9_substring_dedup, op10_minhash_near_dedup,
        op11_token_counts, op12_token_alignment, op13_prefix_trie,
    )
}
