"""Browsing collections: lists, counts, chunks of a file, previews, metadata rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines

PREVIEW_LINES = 10


def without_substrings(df: DataFrame, path: str, parts: list[str]) -> DataFrame:
    return df.where(~reduce(lambda a, b: a | b, [F.contains(F.col(path), F.lit(p)) for p in parts], F.lit(False)))


def is_test_path(path: Column) -> Column:
    return F.contains(path, F.lit("_test.rs")) | F.contains(path, F.lit("/tests/"))


def preview(text: Column) -> Column:
    return F.array_join(F.slice(lines(text), 1, PREVIEW_LINES), "\n")


def collections(rows: DataFrame, collection: str, file: str) -> DataFrame:
    """collection, vector_count, file_count."""
    return rows.groupBy(F.col(collection).alias("collection")).agg(F.count(F.lit(1)).alias("vector_count"), F.count_distinct(file).alias("file_count"))


def file_list(rows: DataFrame, file: str, language: str, order: str, limit: int) -> DataFrame:
    """path, chunk_count and the first row's language, by path."""
    out = rows.groupBy(F.col(file).alias("path")).agg(F.count(F.lit(1)).alias("chunk_count"), F.min_by(language, order).alias("language"))
    return out.orderBy("path").limit(limit)


def file_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks by start line, the end line counted from the content."""
    n = F.greatest(F.size(F.split("content", "\n")), F.lit(1))
    return chunks.withColumn("end_line", F.col("start_line") + n - 1).orderBy("start_line")


def metadata_row(df: DataFrame, metadata: str, line_key: str = "start_line") -> DataFrame:
    """``df`` with start_line (0 if absent) and language ("unknown") from a JSON column."""
    m = F.try_parse_json(metadata)
    return df.withColumn("start_line", F.coalesce(F.try_variant_get(m, f"$.{line_key}", "bigint"), F.lit(0))).withColumn("language", F.coalesce(F.try_variant_get(m, "$.language", "string"), F.lit("unknown")))
