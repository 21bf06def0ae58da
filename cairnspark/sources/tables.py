"""Sources: parquet tables, source trees, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Skipped directories and supported extensions of the indexer.
SKIPPED_DIRS = (".git", "node_modules", "target", "__pycache__")
SUPPORTED = ("rs", "py", "js", "ts", "java", "cpp", "c", "go")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores, for a small table that much is made from: one file of it is one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def extension(path: Column) -> Column:
    """Lower-case extension, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def supported(path: Column) -> Column:
    return extension(path).isin(*SUPPORTED)


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = SUPPORTED) -> DataFrame:
    """path, modified_at, size, content, valid of the files below ``root``.

    Listing and reading are Spark's; skipped directories and extensions are
    filters on the path, which prune before content is read.  A file that is not
    UTF-8 has null content and valid = false; Spark lists no empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    skip = "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS)
    # from the root on: a skipped name above it does not count
    below = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    files = files.where(~below.rlike(f"{'/'.join(['', *root.strip('/').split('/')])}/(.*/)?({skip})/"))
    if extensions is not None:
        files = files.where(extension(F.col("path")).isin(*extensions))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), text.alias("content"), text.isNotNull().alias("valid"))


def write_collection(df: DataFrame, path: str, by: str = "collection", max_records: int = 10_000, mode: str = "errorifexists") -> None:
    """A collection on disk: partitioned by name, shards of bounded size."""
    df.write.mode(mode).option("maxRecordsPerFile", max_records).partitionBy(by).parquet(path)


def encrypt_metadata(df: DataFrame, key: str, metadata: str = "metadata") -> DataFrame:
    """Replace a struct or map column by its AES-GCM encrypted JSON, binary."""
    return df.withColumn(metadata, F.aes_encrypt(F.to_json(metadata), F.lit(key), F.lit("GCM")))


def decrypt_metadata(df: DataFrame, key: str, schema: str, metadata: str = "metadata") -> DataFrame:
    plain = F.aes_decrypt(F.col(metadata), F.lit(key), F.lit("GCM")).cast("string")
    return df.withColumn(metadata, F.from_json(plain, schema))


def ruff_findings(reports: DataFrame, column: str = "value") -> DataFrame:
    """code, file, line, message of reports that hold a JSON array or one object a line."""
    item = "struct<code:string,message:string,filename:string,location:struct<row:bigint,column:bigint>>"
    rows = F.when(F.ltrim(column).startswith("["), F.from_json(column, f"array<{item}>")).otherwise(
        F.transform(F.filter(F.split(column, "\n"), lambda x: F.length(F.trim(x)) > 0), lambda x: F.from_json(x, item))
    )
    return reports.select(F.inline(rows)).select("code", F.col("filename").alias("file"), F.col("location.row").alias("line"), "message")


def clippy_findings(reports: DataFrame, column: str = "value") -> DataFrame:
    """code, file, line, message of compiler messages with a code and a primary span."""
    item = (
        "struct<reason:string,message:struct<message:string,level:string,code:struct<code:string>,"
        "spans:array<struct<file_name:string,line_start:bigint,is_primary:boolean>>>>"
    )
    line = reports.select(F.explode(F.split(column, "\n")).alias("x")).where("length(trim(x)) > 0").select(F.from_json("x", item).alias("r"))
    span = F.get(F.filter("r.message.spans", lambda s: s["is_primary"]), F.lit(0))
    rows = line.where("r.reason = 'compiler-message' and length(r.message.code.code) > 0").withColumn("s", span).where("s is not null")
    return rows.select(F.col("r.message.code.code").alias("code"), F.col("s.file_name").alias("file"), F.col("s.line_start").alias("line"), F.col("r.message.message").alias("message"))
