"""Helpers shared by the training-data operators: column picking, word
splitting, scratch tables in the cluster's shared folder, and integer hashes
that DuckDB can repeat."""

from __future__ import annotations

import re
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Used where a session of one machine (master local) names no ``spark.checkpoint.dir``.
DEFAULT_SCRATCH = "/tmp/checkpoints"


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast to the given types, in the given order.

    An exact name wins over one that differs in case, the first of equal names
    wins, and a missing column becomes nulls; so extra columns with clashing
    names do no harm.
    """
    names = df.columns
    plain = df.toDF(*[f"__c{i}" for i in range(len(names))])
    out = []
    for name, kind in types.items():
        there = any(n.lower() == name.lower() for n in names)
        col = F.col(f"__c{place_of(names, name)}") if there else F.lit(None)
        out.append(col.cast(kind).alias(name))
    return plain.select(*out)


def place_of(names: list[str], name: str) -> int:
    """Where ``pick`` finds a column: an exact name wins over one that differs in case, the first of equal ones wins."""
    found = [i for i, n in enumerate(names) if n == name] or [i for i, n in enumerate(names) if n.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name} among {names}")
    return found[0]


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(col: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value written as text, modulo ``n``; null stays null."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def py_crc_mod(value: int | None, n: int) -> int | None:
    return None if value is None else zlib.crc32(str(value).encode()) % n


def md5_int(col: Column, digits: int = 12) -> Column:
    """The first hex digits of md5 as a non-negative long (12 digits: 48 bits)."""
    return F.conv(F.substring(F.md5(col.cast("binary")), 1, digits), 16, 10).cast("long")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the session's shared checkpoint folder.

    Executors on several machines share no local folder, so without that setting a cluster raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = DEFAULT_SCRATCH
    return f"{root.rstrip('/')}/cairnspark/{uuid.uuid4().hex}"


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and makes what
    several later branches read identical for all of them.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: join_few broadcasts up to so many rows of a few numbers each (some 20 MB in an executor).
FEW_ROWS = 250_000


def join_few(large: DataFrame, few: DataFrame, on: str, limit: int = FEW_ROWS) -> DataFrame:
    """Inner join of a large side with a stored table that may be small.

    ``few`` is counted; up to ``limit`` rows it is broadcast, so that the large
    side stays where it is, and beyond that Spark shuffles both.
    """
    return large.join(F.broadcast(few) if few.count() <= limit else few, on)
