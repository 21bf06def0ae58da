"""The engine's relations over the driver's tables, and their SQL twins.

``documents`` stand for source files.  They carry no paths of their own, so a
path is made from source and doc_id, with an extension by doc_id's remainder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_table
from ..operators.chunking import language_of
from ..sources.tables import table

EXTENSIONS = ("rs", "py", "js", "go", "java", "txt", "PY", "cpp", "md", "ts")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, content, language, source, lang."""
    d = table(spark, sf_dir, "documents")
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    folder = F.when(F.col("doc_id") % 7 == 0, "/tests/").otherwise("/src/")
    stem = F.when(F.col("doc_id") % 11 == 0, "_test").otherwise("")
    path = F.concat("source", folder, F.lit("f"), F.col("doc_id").cast("string"), stem, F.lit("."), ext)
    out = d.select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("content"), "source", "lang")
    return out.withColumn("language", language_of(F.col("path")))


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, line."""
    return line_table(files(spark, sf_dir).select("doc_id", "content"))


_EXT = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"
FILES = f"""files AS (
  SELECT doc_id, source || CASE WHEN doc_id % 7 = 0 THEN '/tests/' ELSE '/src/' END || 'f' || doc_id
         || CASE WHEN doc_id % 11 = 0 THEN '_test' ELSE '' END || '.' || ({_EXT})[doc_id % {len(EXTENSIONS)} + 1] AS path,
         coalesce(text, '') AS content, source, lang FROM documents)"""
EXT_OF = r"lower(regexp_extract(path, '\.([^./]+)$', 1))"
LINES = FILES + """, bodies AS (
  SELECT doc_id, CASE WHEN content = '' THEN []::VARCHAR[] ELSE
    list_transform(string_split(CASE WHEN right(content, 1) = chr(10) THEN content[:-2] ELSE content END, chr(10)),
                   lambda x: regexp_replace(x, '\\r$', '')) END AS ls FROM files),
lines AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM bodies)"""
TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
CHUNKS = LINES + f""", windows AS (
  SELECT doc_id, line_no // 15 AS chunk_no, min(line_no) AS start_line, max(line_no) AS end_line,
         {TRIM.format("string_agg(line, chr(10) ORDER BY line_no)")} AS content FROM lines GROUP BY 1, 2),
chunks AS (SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(start_line AS BIGINT) AS start_line,
                  CAST(end_line AS BIGINT) AS end_line, content FROM windows WHERE strlen(content) >= 20)"""
TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: strlen(x) >= 3)"
TOK = f"tok AS (SELECT doc_id, {TOKENS.format(chr(34) + 'text' + chr(34))} AS tokens FROM documents)"
