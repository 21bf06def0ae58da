"""A corpus pipeline of five operators: language ID, line dedup, MinHash
near-dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept, and
returns the columns of documents; the last returns token ids.  Stages are
written as Parquet and read again, so each starts from files that outlive any
executor.  SQL cannot express language ID's vectors nor the piece lattice, so
there is no ORACLE_SQL; tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import langid, linededup, mixing, neardup, pieces
from cairnspark.llm.common import materialize, table
from cairnspark.llm.queries import model_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; those without letters, and those
    like no learned language, go."""
    return langid.keep_identified(docs, langid.learn(langid.train_fold(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated chunks of lines; every document stays."""
    return linededup.strip_repeats(docs).drop("n_removed_lines", "n_removed_chunks")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.without_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_pieces of every row."""
    out = pieces.encode(docs, pieces.load_pieces(model_file()))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
