"""Column functions on text: lines, tokens, trimming, case predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TOKEN_BYTES = 3


def lines(text: Column) -> Column:
    """Lines of a text: split at ``\\n``, one trailing ``\\r`` cut from each; a final
    line feed opens no further line, an empty or null text has no lines."""
    body = F.when(F.endswith(text, F.lit("\n")), F.length(text) - 1).otherwise(F.length(text))
    parts = F.transform(F.split(F.substring(text, F.lit(1), body), "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(F.length(text) > 0, parts).otherwise(F.array().cast("array<string>"))


def line_table(files: DataFrame, text: str = "content") -> DataFrame:
    """One row a line: the other columns, ``line_no`` (0-based) and ``line``."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(lines(F.col(text))).alias("line_no", "line"))


def trim(col: Column) -> Column:
    """Trim Unicode white space from both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Search tokens: lower case, split at all but letters and digits, at least three bytes."""
    parts = F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.filter(parts, lambda x: F.octet_length(x) >= MIN_TOKEN_BYTES)


def is_snake_case(name: Column) -> Column:
    return name.rlike("^[a-z_][a-z0-9_]*$")


def is_screaming_case(name: Column) -> Column:
    return name.rlike("^[A-Z_][A-Z0-9_]*$")


def is_camel_case(name: Column) -> Column:
    return name.rlike("^[A-Z][A-Za-z0-9]*$") & name.rlike("[a-z]")


def collection_name(name: Column) -> Column:
    """A collection's physical name: dashes become underscores, lower case."""
    return F.lower(F.replace(name, F.lit("-"), F.lit("_")))
